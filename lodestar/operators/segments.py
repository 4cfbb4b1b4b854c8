"""A search index that changes: segments of postings, marks on what is gone, merges by size.

    manifest/000000007.json       the segments of version 7: a reader sees one version, a writer makes the next
    postings/segment=ID/bucket=B  doc_id, term, tf, len, dealt by term
    docs/segment=ID               doc_id, len
    dead/mark=ID/segment=ID       doc_id, len of documents that a later version replaced or deleted

Nothing that is written is changed. A document lives in one segment at most, as adding it
marks its older version dead, so segments can be merged in any order.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text
from . import search

_POSTINGS = "doc_id long, term string, tf long, len int, segment string, bucket int"
_IDS = "doc_id long, len int, segment string"


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class Index:
    """An index in a folder that all executors share.

    Documents have doc_id, title and text. buckets and slices are how terms and, within a
    bucket, documents are dealt to files; `fan` segments of one size class make one of the
    next, so a document is rewritten about log(size) times, and a search reads about fan
    segments a class.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slices: int = 8, fan: int = 4):
        self.spark, self.path, self.slices, self.fan = spark, path.rstrip("/"), slices, max(2, fan)
        if not self.versions():
            self._commit({"version": 0, "buckets": buckets, "segments": {}, "marks": []})

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in storage.names(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, the last whole one by default; what a writer that died has left of one is passed over."""
        read = lambda at: json.loads(storage.read_text(self.spark, f"{self.path}/manifest/{at:09d}.json"))
        if version is not None:
            return read(version)
        have = self.versions()
        for at in reversed(have):
            try:
                return read(at) | {"version": have[-1]}
            except ValueError:
                continue
        raise ValueError(f"{self.path} has no whole version")

    def _whole(self, version: int) -> bool:
        try:
            return bool(self.state(version))
        except ValueError:
            return False

    def _commit(self, state: dict) -> None:
        if not storage.write_new(self.spark, f"{self.path}/manifest/{state['version']:09d}.json", json.dumps(state)):
            raise Conflict(f"version {state['version']} is there already")

    # Changes

    def add(self, docs: DataFrame) -> None:
        """Adds documents; those whose doc_id is there replace what is there.

        Repeated rows of a doc_id are one document, that of the greatest title and text.
        A null doc_id is refused, as nothing could name the document again.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "text")
        ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
        odd = ids.orderBy(F.asc_nulls_first("doc_id")).limit(1).collect()
        if odd and odd[0]["doc_id"] is None:
            raise ValueError("a document without doc_id cannot be indexed")
        if odd:
            rows = rows.groupBy("doc_id").agg(F.max(F.struct("title", "text")).alias("d")).select("doc_id", "d.*")
        lengths = rows.select("doc_id", F.size(text.index_tokens(F.concat_ws(" ", "title", "text"))).alias("len"))
        state = self.state()
        name = self._write(search.postings(rows).select("doc_id", "term", "tf", "len"), lengths, state["buckets"])
        added = self._docs([name])
        self._mark(state, added.select("doc_id"))
        total = added.agg(F.count("*").alias("n"), F.sum("len").alias("l")).first()
        if total["n"]:
            state["segments"][name] = {"docs": total["n"], "length": total["l"], "dead": 0, "dead_length": 0}
        self._commit(state | {"version": state["version"] + 1})

    def delete(self, ids: DataFrame) -> None:
        """Marks documents (doc_id) as gone; a merge leaves them out for good. Ids that are not there do nothing."""
        state = self.state()
        self._mark(state, ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
        self._commit(state | {"version": state["version"] + 1})

    def merge(self) -> int:
        """Merges segments of one size class while `fan` of them are there, and rewrites those of which half is dead; the number of merges."""
        done = 0
        while True:
            state, classes = self.state(), defaultdict(list)
            for name, s in state["segments"].items():
                classes[int(math.log(max(1, s["docs"] - s["dead"]), self.fan))].append(name)
            full = next((sorted(names) for _, names in sorted(classes.items()) if len(names) >= self.fan), None)
            full = full or next(([name] for name, s in sorted(state["segments"].items()) if 2 * s["dead"] >= s["docs"]), None)
            if full is None:
                return done
            self._merge(state, full)
            done += 1

    def optimize(self) -> None:
        """One segment of all that lives."""
        state = self.state()
        if len(state["segments"]) > 1 or any(s["dead"] for s in state["segments"].values()):
            self._merge(state, sorted(state["segments"]))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files of no version but the last `keep`, and those versions; the number of folders deleted. No one may write meanwhile."""
        versions = self.versions()
        versions = [v for v in versions if self._whole(v)]
        states = [self.state(v) for v in versions[-max(1, keep) :]]
        used = {f"segment={n}" for s in states for n in s["segments"]} | {f"mark={m}" for s in states for m in s["marks"]}
        gone = 0
        for kind in ("postings", "docs", "dead"):
            for name in storage.names(self.spark, f"{self.path}/{kind}"):
                if "=" in name and name not in used:
                    storage.delete(self.spark, f"{self.path}/{kind}/{name}")
                    gone += 1
        for v in versions[: -max(1, keep)]:
            storage.delete(self.spark, f"{self.path}/manifest/{v:09d}.json")
        return gone

    def _write(self, postings: DataFrame, lengths: DataFrame, buckets: int) -> str:
        """A new segment; a bucket's rows go to `slices` tasks by document, so that a term of all documents is no task of its own."""
        name = f"s{uuid.uuid4().hex}"
        dealt = postings.withColumn("bucket", search.bucket_of(buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.slices)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings/segment={name}")
        lengths.write.option("compression", "zstd").parquet(f"{self.path}/docs/segment={name}")
        return name

    def _mark(self, state: dict, ids: DataFrame) -> None:
        """Marks the living documents of these ids dead, in the state as well."""
        if not state["segments"]:
            return
        mark = f"m{uuid.uuid4().hex}"
        hit = self._alive(self._docs(list(state["segments"])), state, list(state["segments"])).join(ids, "doc_id", "left_semi")
        hit.write.partitionBy("segment").option("compression", "zstd").parquet(f"{self.path}/dead/mark={mark}")
        counts = self._dead([mark]).groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("l")).collect()  # a row a segment
        for r in counts:
            s = state["segments"][r["segment"]]
            s["dead"], s["dead_length"] = s["dead"] + r["n"], s["dead_length"] + r["l"]
        if counts:
            state["marks"].append(mark)

    def _merge(self, state: dict, names: list[str]) -> None:
        postings = self._alive(self._read("postings", names, _POSTINGS), state, names).select("doc_id", "term", "tf", "len")
        name = self._write(postings, self._alive(self._docs(names), state, names).select("doc_id", "len"), state["buckets"])
        old = [state["segments"].pop(n) for n in names]
        docs, length = sum(s["docs"] - s["dead"] for s in old), sum(s["length"] - s["dead_length"] for s in old)
        if docs:
            state["segments"][name] = {"docs": docs, "length": length, "dead": 0, "dead_length": 0}
        if not any(s["dead"] for s in state["segments"].values()):
            state["marks"] = []
        self._commit(state | {"version": state["version"] + 1})

    # Reading

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/segment={n}" for n in names]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _docs(self, names: list[str]) -> DataFrame:
        return self._read("docs", names, _IDS)

    def _dead(self, marks: list[str]) -> DataFrame:
        paths = [f"{self.path}/dead/mark={m}" for m in marks]
        return self.spark.read.schema(_IDS + ", mark string").option("basePath", f"{self.path}/dead").parquet(*paths).drop("mark")

    def _alive(self, rows: DataFrame, state: dict, names: list[str]) -> DataFrame:
        """rows of segments without those of dead documents; no join where none of them has any."""
        hit = [n for n in names if state["segments"][n]["dead"]]
        if not hit:
            return rows
        dead = self._dead(state["marks"]).filter(F.col("segment").isin(hit)).select("segment", "doc_id")
        return rows.join(dead, ["segment", "doc_id"], "left_anti")

    def bm25(self, queries: DataFrame, version: int | None = None) -> DataFrame:
        """search.bm25() over the living documents: the buckets of the query terms are read in every segment, the corpus is known from the manifest."""
        state = self.state(version)
        names, terms = list(state["segments"]), search.query_terms(queries)
        wanted = [r["b"] for r in terms.select(search.bucket_of(state["buckets"]).alias("b")).distinct().collect()]  # buckets
        found = self._read("postings", names, _POSTINGS).filter(F.col("bucket").isin(wanted)).join(terms.select("term").distinct(), "term", "left_semi")
        total = [sum(s[k] - s[d] for s in state["segments"].values()) for k, d in (("docs", "dead"), ("length", "dead_length"))]
        stats = self.spark.createDataFrame([(total[0], total[1] / max(1, total[0]))], "n_docs long, avg_len double")
        return search.scored(self._alive(found, state, names).select("doc_id", "term", "tf", "len"), terms, stats)

    def ids(self, version: int | None = None) -> DataFrame:
        """doc_id, len of the living documents."""
        state = self.state(version)
        return self._alive(self._docs(list(state["segments"])), state, list(state["segments"])).select("doc_id", "len")
