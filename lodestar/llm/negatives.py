"""Hard negatives by a norm-bucketed search.

Candidates are sorted by norm, longest first, and cut into buckets. An inner product is at
most the product of the two norms, so a bucket whose longest vector cannot reach a
window's lower limit, or the k-th best score found for it so far, is not read for it. A
slice is a run of buckets; slices that cannot matter get no question at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import deal, settle, tasks

#: Every component becomes the floor of itself times this.
SCALE = 256.0
#: Positives of an anchor, negatives of a positive, and the share of the positive's score, in hundredths, that a negative must have.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
#: Vectors of a bucket, which are scored at once, and of a slice at most.
BUCKET, SLICE = 1024, 1 << 18
#: Anchors that one task holds for a slice, and windows that are scored at once.
GROUP, STEP = 1 << 14, 512

LOW, HIGH = -(2**63) + 1, 2**63 - 1
#: For norms and their products are rounded.
_SLACK = 1 + 1e-9
#: Largest component as an integer: beyond it no score fits a long, and it counts as this.
_MOST = 2**62


def _prepare(batches):
    """(uid, vec_id, label, list) to (uid, vec_id, label, dim, v, norm) of the rows that take part."""
    for b in batches:
        kept, dims, packed, norms = [], [], [], []
        for k, v in enumerate(b.column(3).to_pylist()):
            if v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(x * SCALE), -float(_MOST), float(_MOST))
            small = not len(x) or np.abs(x).max() < 2**15
            kept.append(k)
            dims.append(len(x))
            packed.append(x.astype(np.int16 if small else np.int64).tobytes())
            norms.append(float(np.sqrt((x * x).sum())))
        rows = b.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(dims, pa.int32()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64())], ["uid", "vec_id", "label", "dim", "v", "norm"])


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length; float64 where all are small, else int64."""
    if all(len(v) == 2 * dim for v in packed):
        return np.frombuffer(b"".join(packed), np.int16).reshape(len(packed), dim).astype(np.float64)
    return np.stack([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.int64).astype(np.int64) for v in packed])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs: exact, and those that no long can hold as its end."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0
    if most(a) * most(b) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def _buckets(batches):
    """Rows sorted by length and falling norm to buckets: the partition is the slice."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        dims = b.column(3).to_numpy()
        edges = np.flatnonzero(np.append(True, dims[1:] != dims[:-1])) if len(dims) else []
        for s, e in zip(edges, [*edges[1:], len(dims)], strict=True):
            for i in range(s, e, BUCKET):
                rows, dim = b.slice(i, min(BUCKET, e - i)), int(dims[s])
                m = _matrix(rows.column(4).to_pylist(), dim)
                v = m.astype(np.int16 if m.dtype == np.float64 else np.int64).tobytes()
                ids = [rows.column(c).to_numpy().astype(np.int64).tobytes() for c in range(3)]
                norms = rows.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([float(norms.max())]), *(pa.array([x], pa.binary()) for x in (*ids, v))],
                    ["slice", "bucket", "dim", "top", "uids", "ids", "labels", "v"],
                )
                n += 1


class _Held:
    """The windows that a task answers from one slice, and what it has found for each."""

    def __init__(self, rows: list[tuple], dim: int, same: bool, k: int):
        rows.sort(key=lambda r: r[:2])
        self.same, self.k, self.dim = same, k, dim
        self.uid, self.w, self.label, self.lo, self.hi, self.least = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2, 5, 6, 7))
        self.norm = np.array([r[4] for r in rows], np.float64)
        first = np.flatnonzero(np.append(True, self.uid[1:] != self.uid[:-1]))
        self.anchor = np.cumsum(np.append(True, self.uid[1:] != self.uid[:-1])) - 1
        self.v = _matrix([rows[i][3] for i in first], dim)
        self.score = np.full((len(rows), k), LOW, np.int64)
        self.found = np.full((len(rows), k), HIGH, np.int64)
        self.held = np.zeros(len(rows), np.int64)

    def read(self, top: float, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, packed: bytes) -> None:
        """One bucket, for the windows that it can still matter to."""
        need = np.maximum(self.lo, self.least)
        live = np.flatnonzero((self.norm * top * _SLACK >= need) & (self.lo <= self.hi))
        if not len(live):
            return
        size = len(packed) // len(ids)
        m = _matrix([packed[i * size : (i + 1) * size] for i in range(len(ids))], self.dim)
        for s in range(0, len(live), STEP):
            at = live[s : s + STEP]
            one, back = np.unique(self.anchor[at], return_inverse=True)
            scores = _scores(self.v[one], m)[back]
            fit = (scores >= need[at][:, None]) & (scores <= self.hi[at][:, None])
            other = self.label[at][:, None] == labels[None, :]
            fit &= other & (self.uid[at][:, None] != uids[None, :]) if self.same else ~other
            i, j = np.nonzero(fit)
            if len(i):
                self._add(at, i, scores[i, j], ids[j])

    def _add(self, at: np.ndarray, i: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        touched = np.unique(i)
        old = np.repeat(touched, self.held[at[touched]])
        kept = np.arange(self.k)[None, :] < self.held[at[touched]][:, None]
        row = np.concatenate([old, i])
        score = np.concatenate([self.score[at[touched]][kept], score])
        found = np.concatenate([self.found[at[touched]][kept], found])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        row, score, found, place = row[best], score[best], found[best], place[best]
        self.score[at[row], place], self.found[at[row], place] = score, found
        np.maximum.at(self.held, at[row], place + 1)
        full = at[touched][self.held[at[touched]] == self.k]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])

    def answers(self):
        i, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(self.uid[i]), pa.array(self.w[i].astype(np.int32)), pa.array(self.found[i, place]), pa.array(self.score[i, place])], ["uid", "w", "found", "score"])


def _search(same: bool, k: int):
    """Windows, then buckets of a slice from the longest vectors on, to the best k of every window there."""

    def run(batches):
        key, rows, held = None, [], None
        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                now = c["dim"][r], c["slice"][r], c["grp"][r]
                if now != key:
                    if held is not None:
                        yield from held.answers()
                    key, rows, held = now, [], None
                if c["role"][r] == 0:
                    rows.append((c["uid"][r], c["w"][r], c["label"][r], c["v"][r], c["norm"][r], c["lo"][r], c["hi"][r], c["least"][r]))
                elif rows:
                    held = held or _Held(rows, now[0], same, k)
                    held.read(c["norm"][r], *(np.frombuffer(c[n][r], np.int64) for n in ("uids", "ids", "labels")), c["v"][r])
        if held is not None:
            yield from held.answers()

    return run


def _answers(asks: DataFrame, buckets: DataFrame, tops: list, groups: int, same: bool, k: int) -> DataFrame:
    """uid, w, found, score: the best k of every slice for asks (uid, w, label, dim, v, norm, lo, hi, least)."""
    spark = asks.sparkSession
    by_dim: dict[int, tuple] = {d: (np.array([t["slice"] for t in tops if t["dim"] == d], np.int32), np.array([t["top"] for t in tops if t["dim"] == d])) for d in {t["dim"] for t in tops}}

    def spread(batches):
        for b in batches:
            dim, norm = b.column("dim").to_numpy(), b.column("norm").to_numpy()
            need = np.maximum(b.column("lo").to_numpy(), b.column("least").to_numpy())
            row, where = [], []
            for i, d in enumerate(dim.tolist()):
                slices, longest = by_dim.get(d, (np.zeros(0, np.int32), np.zeros(0)))
                there = slices[norm[i] * longest * _SLACK >= need[i]]
                row.append(np.full(len(there), i))
                where.append(there)
            if row:
                rows = b.take(pa.array(np.concatenate(row).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where), pa.int32()), *rows.columns], ["slice", *rows.schema.names])

    schema = "uid long, w int, label long, dim int, v binary, norm double, lo long, hi long, least long"
    asked = asks.select([c.split()[0] for c in schema.split(", ")]).mapInArrow(spread, f"slice int, {schema}").withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    meet = asked.select("dim", "slice", "grp").distinct()
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    side = asked.select("dim", "slice", "grp", F.lit(0).alias("role"), F.lit(0).cast("long").alias("bucket"), "uid", "w", "label", "v", "norm", "lo", "hi", "least", *none("binary", "uids", "ids", "labels"))
    other = buckets.join(meet, ["dim", "slice"]).select("dim", "slice", "grp", F.lit(1).alias("role"), "bucket", *none("long", "uid"), *none("int", "w"), *none("long", "label"), "v", F.col("top").alias("norm"), *none("long", "lo", "hi", "least"), "uids", "ids", "labels")
    n = tasks(spark)
    both = deal(side.unionByName(other).withColumn("part", F.pmod(F.col("slice") * groups + F.col("grp"), F.lit(n)).cast("int")), n).sortWithinPartitions("dim", "slice", "grp", "role", "bucket").drop("part")
    return both.mapInArrow(_search(same, k), "uid long, w int, found long, score long")


def best(asks: DataFrame, buckets: DataFrame, same: bool, k: int) -> DataFrame:
    """uid, w, found, score, rank: the k best candidates of every window, of the asking row's label or of others, settled.

    The slices of the longest vectors answer first; their k-th scores then keep windows
    from slices that cannot better them. What is collected is one row a slice.
    """
    asks = settle(asks)
    groups = max(1, -(-asks.count() // GROUP))
    tops = buckets.groupBy("dim", "slice").agg(F.max("top").alias("top")).collect()
    longest = {d: max((t for t in tops if t["dim"] == d), key=lambda t: (t["top"], -t["slice"]))["slice"] for d in {t["dim"] for t in tops}}
    early = [t for t in tops if longest[t["dim"]] == t["slice"]]
    late = [t for t in tops if longest[t["dim"]] != t["slice"]]
    by = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "found")
    cut = lambda hits: settle(hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k))
    first = cut(_answers(asks, buckets, early, groups, same, k))
    if not late:
        return first
    least = first.filter(F.col("rank") == k).select("uid", "w", F.col("score").alias("kth"))
    again = asks.join(least, ["uid", "w"], "left").withColumn("least", F.greatest("least", "kth")).drop("kth")
    return cut(first.drop("rank").unionByName(_answers(again, buckets, late, groups, same, k)))


def hard_negatives(vectors: DataFrame, every: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key `every` divides. An anchor's positives are the best
    other rows of its label by integer inner product, ties by smaller key; a positive's
    negatives the best rows of other labels whose score is at least `share` hundredths of
    the positive's and not above it. Fewer, where there are fewer; no row for a positive
    without negatives.

    Rows with a null key, label or vector, or with a null or non-finite component take no
    part, and an empty table gives none. Vectors of different lengths never meet; empty
    ones score 0. Repeated rows are rows of their own: each copy of an anchor asks, and is
    another row for its copies. Scores beyond a long count as its end. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    ready = settle(rows.filter("vec_id is not null and label is not null and e is not null").mapInArrow(_prepare, "uid long, vec_id long, label long, dim int, v binary, norm double"))
    slices = max(tasks(spark), -(-ready.count() // SLICE))
    order = ["dim", F.desc("norm"), "uid"]
    sliced = ready.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    buckets = settle(sliced.mapInArrow(_buckets, "slice int, bucket long, dim int, top double, uids binary, ids binary, labels binary, v binary"))
    anchors = ready.filter(F.col("vec_id") % every == 0)
    bound = lambda x: F.lit(x).cast("long")
    near = best(anchors.withColumns({"w": F.lit(0), "lo": bound(LOW), "hi": bound(HIGH), "least": bound(LOW)}).drop("vec_id"), buckets, True, positives)
    # A window of a negative score is empty. The limit is the score times share, divided by 100 and rounded up, in two parts, so that nothing overflows.
    score = F.col("score")
    low = F.expr(f"score div 100 * {share} + (score % 100 * {share} + 99) div 100")
    windows = near.filter("score >= 0").select("uid", F.col("rank").alias("w"), low.cast("long").alias("lo"), score.alias("hi"), bound(LOW).alias("least"))
    found = best(anchors.drop("vec_id").join(windows, "uid"), buckets, False, negatives)
    pairs = near.select("uid", F.col("rank").alias("w"), F.col("found").alias("positive_id"), score.alias("positive_score"))
    named = found.select("uid", "w", "rank", F.col("found").alias("negative_id"), score.alias("negative_score")).join(pairs, ["uid", "w"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP11_SQL = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM good a, good c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
