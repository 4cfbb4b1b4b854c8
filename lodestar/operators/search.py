"""Keyword, vector and hybrid search of many queries over many documents at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..storage import settle


def postings(docs: DataFrame, terms: DataFrame | None = None, tokens_of: Callable = text.index_tokens) -> DataFrame:
    """doc_id, term, tf and len over title and text; only of the given terms if there are any. tokens_of is the tokenizer.

    The terms filter the exploded tokens before they are shuffled. Then every document also
    has one row of a null term, from which the corpus is counted in the same pass.
    """
    tokens = tokens_of(F.concat_ws(" ", "title", "text"))
    rows = docs.select("doc_id", tokens.alias("tokens"))
    if terms is None:
        rows = rows.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    rows = rows.select("doc_id", F.size("tokens").alias("len"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([(None,)], "term string"))
    rows = rows.join(wanted.withColumnRenamed("term", "w"), F.col("term").eqNullSafe(F.col("w")), "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def corpus(found: DataFrame) -> DataFrame:
    """One row, n_docs and avg_len, from the rows of a null term."""
    return found.filter("term is null").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def query_terms(queries: DataFrame, tokens_of: Callable = text.index_tokens) -> DataFrame:
    """query_id, term, times and the query's number of distinct terms."""
    t = queries.select("query_id", F.explode(tokens_of(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return t.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


#: Terms of queries up to which they go to the postings, which are not moved then.
FEW = 1 << 16


def _few(terms: DataFrame) -> DataFrame:
    """terms, settled, and broadcast if they are few."""
    terms = settle(terms)
    return F.broadcast(terms) if terms.limit(FEW + 1).count() <= FEW else terms


def scored(found: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, doc_id, score from postings of the terms of queries and the one row of corpus statistics."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, 1e-6).otherwise(idf)
    tf = F.col("tf")
    gain = weight * tf * (scores.K1 + 1) / (tf + scores.K1 * (1 - scores.B + scores.B * F.col("len") / F.col("avg_len")))
    rows = found.join(_few(terms.join(df, "term")), "term").crossJoin(F.broadcast(stats))  # one row
    return rows.groupBy("query_id", "doc_id").agg(F.sum(gain * F.col("times")).alias("score"), F.count("*").alias("held"), F.first("n_terms").alias("n_terms")).filter("held = n_terms").select("query_id", "doc_id", "score")


def bm25(docs: DataFrame, queries: DataFrame, tokens_of: Callable = text.index_tokens) -> DataFrame:
    """query_id, doc_id, score of the documents that hold all terms of a query; a repeated term counts as often.

    The texts are read once: the postings of the query terms, few against the texts, are
    settled. For many calls over one collection, build an index.
    """
    terms = query_terms(queries, tokens_of)
    every = settle(postings(docs, terms, tokens_of))
    return scored(every.filter("term is not null"), terms, corpus(every))


def _counted(held: DataFrame) -> DataFrame:
    """doc_id, len, term, tf of rows (doc_id, tokens) in order of doc_id; rows of one doc_id in a task are one document, whose len is that of the longest row."""
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        done: list[tuple] = []  # (doc_id, len, counts), of which the last may go on
        for b in batches:
            of = b.schema.field(0).type
            for i, tokens in zip(b.column(0), b.column(1), strict=True):
                i, tokens = i.as_py(), tokens.as_py() or []
                if done and done[-1][0] == i:
                    done[-1] = (i, max(done[-1][1], len(tokens)), done[-1][2] + Counter(tokens))
                    continue
                if len(done) >= 64:
                    yield packed(done, of)
                    done = []
                done.append((i, len(tokens), Counter(tokens)))
        if done:
            yield packed(done, of)

    def packed(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        own = pa.array(np.repeat(np.arange(len(done)), [len(c) for _, _, c in done]))
        ids, lens = pa.array([i for i, _, _ in done], of), pa.array([n for _, n, _ in done], pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(own), lens.take(own), pa.array([t for _, _, c in done for t in c], pa.string()), pa.array([n for _, _, c in done for n in c.values()], pa.int64())], ["doc_id", "len", "term", "tf"])

    return held.mapInArrow(run, f"doc_id {kind}, len int, term string, tf long")


def build_index(docs: DataFrame, path: str, buckets: int = 64, slices: int = 8) -> None:
    """Writes the postings of docs by bucket of the term, and the corpus statistics.

    Texts, which are smaller than their postings, are dealt by document, to `slices` tasks at
    least; each writes its part of every bucket. So a term of all documents is no task of its
    own, neither here nor when it is read. Rows of one doc_id count as one document.
    """
    n = max(slices, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("whole")).repartition(n, "doc_id").sortWithinPartitions("doc_id")
    posts = _counted(dealt.select("doc_id", text.index_tokens(F.col("whole")).alias("tokens"))).withColumn("bucket", bucket_of(buckets))
    posts.sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    lengths = docs.select(F.size(text.index_tokens(F.concat_ws(" ", "title", "text"))).alias("len"))
    lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/corpus")


def bucket_of(buckets: int) -> Column:
    """The bucket of the column term."""
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def bm25_indexed(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """bm25() from an index: only the buckets of the query terms are read, at most as many as there are."""
    stats = spark.read.parquet(f"{path}/corpus")
    buckets = stats.first()["buckets"]
    terms = query_terms(queries)
    wanted = [r["b"] for r in terms.select(bucket_of(buckets).alias("b")).distinct().collect()]  # buckets
    found = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(wanted)).drop("bucket").join(_few(terms.select("term").distinct()), "term", "left_semi")
    return scored(found, terms, stats.select("n_docs", "avg_len"))


def keep(language: str | None = None, date_from: float | None = None, date_to: float | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """The condition of a search's filters on documents; dates count on both ends, scores stay those of the whole corpus."""
    out = F.lit(True)
    if language:
        out = out & (F.col("lang") == language)
    if date_from is not None:
        out = out & (F.col("crawled_at") >= date_from)
    if date_to is not None:
        out = out & (F.col("crawled_at") <= date_to)
    if include:
        out = out & F.col("domain").isin(include)
    if exclude:
        out = out & ~F.col("domain").isin(exclude)
    return out


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 10000) -> DataFrame:
    """Rows offset to offset + limit in an order; the limit is held between 1 and most."""
    return rows.orderBy(*order).offset(max(0, min(offset, 10000))).limit(max(1, min(limit, most)))


def top_k(rows: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of every query_id with their rank; Spark cuts each partition to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie))).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, limit: int, now: float, authority: DataFrame | None = None, trust: DataFrame | None = None, index=None, wanted: Column | None = None, weights: dict[str, float] | None = None, tokens_of: Callable | None = None, explain: bool = False) -> DataFrame:
    """Two-stage search: 2 * limit candidates by BM25, re-ranked by the combined score.

    authority (domain, authority) and trust (peer, trust) are joined to the candidates alone;
    a domain without authority has 0, a peer without trust, or any without a table, one half.
    index is the path of an index of docs, or a segments.Index of them; wanted, a filter such as keep() gives, counts before the cut.
    weights are those of the signals, scores.WEIGHTS by default; tokens_of is a tokenizer in place of the index's own, so no index is read. explain adds the signals.
    """
    hits = bm25(docs, queries, tokens_of) if tokens_of else bm25(docs, queries) if index is None else bm25_indexed(docs.sparkSession, index, queries) if isinstance(index, str) else index.bm25(queries)
    if wanted is not None:
        hits = hits.join(docs.filter(wanted).select("doc_id"), "doc_id", "left_semi")
    best = top_k(hits.withColumn("r6", F.round("score", 6)), 2 * limit, "r6").withColumnRenamed("rank", "bm25_rank")
    rows = best.join(queries, "query_id").join(docs.select("doc_id", "title", "url", "crawled_at", "source"), "doc_id")
    if authority is not None:
        rows = rows.withColumn("_d", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))).join(authority.withColumnRenamed("domain", "_d"), "_d", "left")
    if trust is not None:
        rows = rows.join(trust.withColumnRenamed("peer", "source"), "source", "left")
    q = text.ascii_tokens(F.col("query"))
    signals = {
        "bm25": scores.normal_bm25(F.col("score"), F.max("score").over(Window.partitionBy("query_id"))),
        "freshness": scores.freshness(F.col("crawled_at"), now),
        "trust": F.lit(scores.LOCAL_TRUST) if trust is None else F.coalesce("trust", F.lit(scores.LOCAL_TRUST)),
        "authority": F.lit(0.0) if authority is None else F.coalesce("authority", F.lit(0.0)),
        "title": scores.token_share(q, text.ascii_tokens(F.col("title"))),
        "url": scores.path_share(q, F.col("url")),
    }
    rows = rows.withColumns({f"_{n}": c for n, c in signals.items()})
    signals = {n: F.col(f"_{n}") for n in signals}
    rows = rows.withColumn("combined", F.round(scores.combined(weights, **signals), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "bm25_rank"))).filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "url", "combined", *([F.struct(*[c.alias(n) for n, c in signals.items()]).alias("signals")] if explain else []))


def rrf(text_hits: DataFrame, vector_hits: DataFrame, k: int = 60, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank)."""
    a = text_hits.select("query_id", "doc_id", F.col("rank").alias("fts_rank"))
    b = vector_hits.select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full")
    part = lambda r, w: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    source = F.when(F.col("vector_rank").isNull(), "fts").when(F.col("fts_rank").isNull(), "vector").otherwise("hybrid")
    return both.select("query_id", "doc_id", source.alias("source"), F.round(part("fts_rank", text_weight) + part("vector_rank", vector_weight), 6).alias("combined_score"))


def suggest(docs: DataFrame, typed: str, limit: int = 10) -> DataFrame:
    """Distinct titles that contain the typed text, wildcards removed, most recent first."""
    part = F.lower(F.lit(typed.replace("%", "").replace("_", "")[:100]))
    hits = docs.filter(F.contains(F.lower("title"), part) & (F.col("title") != "")).groupBy("title").agg(F.max("crawled_at").alias("crawled_at"))
    return hits.orderBy(F.desc("crawled_at"), "title").limit(max(1, min(50, limit)))


def shared_pairs(rows: DataFrame, terms: str) -> DataFrame:
    """term_a, term_b (term_a < term_b), times: the pairs of terms that at least two rows' sets hold, nothing bounded.

    Terms of a single row are in no such pair; without them the pairs are exact and fewer.
    """
    # In one select the numbers would be given after the explode.
    held = rows.select(F.monotonically_increasing_id().alias("row"), terms).select("row", F.explode(terms).alias("term"))
    often = held.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").select("term")
    # The terms of a row meet in a join, which keeps none of its sets in an array and may be split where a row is long.
    kept = settle(held.join(often, "term", "left_semi").select("row", "term"))
    a, b = kept.select("row", F.col("term").alias("term_a")), kept.select("row", F.col("term").alias("term_b"))
    pairs = a.join(b, "row").filter("term_a < term_b")
    return pairs.groupBy("term_a", "term_b").agg(F.count("*").alias("times")).filter("times > 1")
