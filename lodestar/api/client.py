"""A client over a collection of documents: search, suggestions, pages, crawled input, statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import passages, quality, requests, shaping
from ..operators import extraction, graph, maintenance, ranking, search, vectors
from ..storage import settle
from .plugins import Plugins, Point


@dataclass
class Client:
    """docs: doc_id, text, lang, source, title, url, domain, crawled_at. Every call builds one plan over the whole collection, or over an index, a path or a segments.Index. profile names the weights of the ranking signals; an unknown one is the default."""

    spark: SparkSession
    docs: DataFrame
    now: float
    plugins: Plugins | None = None
    authority: DataFrame | None = None
    trust: DataFrame | None = None
    index: object = None
    profile: str = "default"

    def _run(self, point: Point, df: DataFrame) -> DataFrame:
        return self.plugins.run(point, df) if self.plugins else df

    @property
    def weights(self) -> dict[str, float]:
        return requests.PROFILES.get(self.profile, requests.PROFILES["default"])

    def _ranked(self, docs: DataFrame, q: DataFrame, limit: int, filters: dict, explain: bool = False) -> DataFrame:
        tokens_of = self.plugins.tokenizer if self.plugins else None
        return search.ranked(docs, q, limit, self.now, self.authority, self.trust, self.index, search.keep(**filters) if filters else None, self.weights, tokens_of, explain)

    def search(self, queries: str | list[str], limit: int = 10, offset: int = 0, **filters) -> DataFrame:
        """query_id, query, rank, doc_id, url, title, snippet, combined of every query; filters are those of operators.search.keep."""
        asked = [queries] if isinstance(queries, str) else queries
        q = self._run(Point.PRE_SEARCH, self.spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
        docs = self._run(Point.PRE_RANK, self.docs)
        hits = self._ranked(docs, q, limit + offset, filters)
        hits = self._run(Point.POST_RANK, hits)
        if self.plugins:
            hits = hits.withColumn("combined", self.plugins.score(F.col("combined")))
        page = hits.filter(F.col("rank") > offset).join(q, "query_id").join(docs.select("doc_id", "title", "text"), "doc_id")
        shown = page.select("query_id", "query", (F.col("rank") - offset).alias("rank"), "doc_id", "url", "title", F.substring("text", 1, 300).alias("snippet"), "combined")
        return self._run(Point.POST_SEARCH, shown)

    def suggest(self, typed: str, limit: int = 10) -> DataFrame:
        return search.suggest(self.docs, typed, limit)

    def fetch_page(self, url: str) -> DataFrame:
        """page: a document of the collection with what a reader should know of it; no row for an unknown address."""
        found = self.docs.filter(F.col("url") == url).limit(1)
        return found.select("url", shaping.fetched_text(F.col("title"), F.col("url"), F.col("text"), F.col("crawled_at"), self.now).alias("page"))

    def crawl(self, pages: DataFrame) -> DataFrame:
        """Takes fetched pages (page_id, url, html) in: text, outcome of each, and new documents for the collection."""
        pages = self._run(Point.PRE_CRAWL, pages)
        made = pages.select("page_id", "url", quality.visible(F.col("html")).alias("text"), extraction.meta_tags(F.col("html"))["title"].alias("title")).withColumn("text_hash", F.sha2("text", 256))
        made = self._run(Point.PRE_INDEX, self._run(Point.POST_CRAWL, made))
        known = self.docs.select("url", F.sha2("text", 256).alias("text_hash"))
        return self._run(Point.POST_INDEX, maintenance.ingested(made, known, "page_id"))

    def links(self, pages: DataFrame) -> DataFrame:
        return graph.links(pages)

    def explain(self, query: str, limit: int = 10) -> DataFrame:
        """The weighted parts of the results' scores, before any scorer of a plugin: the signals that ranked them."""
        q = self._run(Point.PRE_SEARCH, self.spark.createDataFrame([(0, query)], "query_id long, query string"))
        hits = self._ranked(self._run(Point.PRE_RANK, self.docs), q, limit, {}, True)
        return hits.select("rank", "doc_id", "combined", *[c.alias(n) for n, c in shaping.explanation({n: F.col(f"signals.{n}") for n in self.weights}, self.weights).items()])

    def chunks(self, query: str, limit: int = 5, size: int = 500) -> DataFrame:
        """The results' texts in pieces, as a model reads them."""
        hits = self.search(query, limit).join(self.docs.select("doc_id", "text"), "doc_id")
        return hits.select("rank", "url", F.posexplode(passages.chunks(F.col("text"), size)).alias("chunk", "body"))

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n_docs"), F.count_distinct("domain").alias("domains"), F.max("crawled_at").alias("latest"))

    def diversified(self, query: str, limit: int = 10) -> DataFrame:
        hits = self.search(query, limit).withColumn("domain", F.regexp_extract("url", "://([^/]*)", 1))
        return ranking.diversify(hits.select("query_id", "rank", "domain", "doc_id"))


@dataclass(frozen=True)
class Document:
    """A retrieved document as frameworks for language models pass it on."""

    content: str
    metadata: dict
    score: float


class Retriever:
    """Documents for a query, under the method names that common frameworks call: invoke, retrieve and run."""

    def __init__(self, client: Client, limit: int = 5):
        self.client, self.limit = client, limit

    def invoke(self, query: str, **given) -> list[Document]:
        limit = given.pop("limit", self.limit)
        rows = self.client.search(query, limit, **given).orderBy("rank").collect()  # limit rows
        return [Document(r["snippet"], {"url": r["url"], "title": r["title"], "doc_id": r["doc_id"]}, r["combined"]) for r in rows]

    def get_relevant_documents(self, query: str) -> list[Document]:
        return self.invoke(query)

    def retrieve(self, query: str) -> list[Document]:
        return self.invoke(query)

    def run(self, query: str, top_k: int | None = None) -> dict[str, list[Document]]:
        return {"documents": self.invoke(query, limit=top_k or self.limit)}


def summary_rejection(trust: float, n_chars: int, running: int, pending: int, idle: float, least_trust: float = 0.3, most_chars: int = 100000, capacity: int = 2, queue: int = 10, cooldown: float = 1.0) -> str | None:
    """Why a peer's request for a summary is refused, the first reason in order; None lets it through. Generation itself is the caller's."""
    reasons = [("untrusted", trust < least_trust), ("too_long", n_chars > most_chars or n_chars <= 0 or math.isnan(n_chars)), ("busy", running >= capacity), ("queue_full", pending >= queue), ("cooldown", idle < cooldown)]
    return next((name for name, refused in reasons if refused), None)


class VectorStore:
    """Vectors (vec_id, embedding) under keys, added to, deleted and searched."""

    #: Changes after which the vectors are written anew, so that no plan grows with them.
    CHANGES = 8

    def __init__(self, rows: DataFrame):
        self.vectors, self._changes = rows.select("vec_id", "embedding"), 0

    def _changed(self, rows: DataFrame) -> None:
        self._changes += 1
        self.vectors = settle(rows) if self._changes % self.CHANGES == 0 else rows

    def add(self, rows: DataFrame) -> None:
        """Adds rows; one of a known key takes the old one's place."""
        new = rows.select("vec_id", "embedding")
        self._changed(self.vectors.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Deletes the vectors of keys (vec_id); unknown ones do nothing."""
        self._changed(self.vectors.join(keys.select("vec_id"), "vec_id", "left_anti"))

    def search(self, probes: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
        """query_id, doc_id, score, rank: the nearest to each probe (query_id, probe)."""
        return vectors.nearest(self.vectors, probes, k, least)

    def count(self) -> int:
        return self.vectors.count()
