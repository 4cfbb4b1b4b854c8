"""Exact nearest vectors by cosine: pivots keep what cannot be near from being compared.

The angle between unit vectors obeys the triangle inequality: a vector whose angle to a
pivot is t and a probe whose angle to it is p are at least |p - t| apart. Vectors are dealt
to their nearest pivot and sorted by t in blocks, so a bound for a block needs its least and
largest t alone. A probe first reads the blocks of its nearest pivot; the k-th best score there
then rules pivots and blocks out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle

#: Vectors of a block, pivots at most, and the sample that they are chosen from.
BLOCK, PIVOTS, SAMPLE = 1024, 64, 4096
#: Probes that a task holds for one run of blocks.
HELD = 4096
#: Angles are rounded, and scores are compared after four digits.
_SLACK, _ROUND = 1e-7, 0.5e-4 + 1e-9


def _units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, dim, v: vectors that have a direction, as packed unit vectors."""

    def run(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, np.float64) if i is not None and v and None not in v else np.zeros(0)
                norm = np.sqrt(x @ x) if len(x) else 0.0
                if norm > 0 and np.isfinite(norm):
                    ids.append(i)
                    dims.append(len(x))
                    out.append((x / norm).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "v"])

    return rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "id long, dim int, v binary")


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _pivots(units: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For every length of vectors, pivots that lie far from each other, from a bounded sample by hash."""
    sample = units.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("dim", "v").toArrow()
    out, dims = {}, np.array(sample.column("dim").to_pylist(), int)
    packed = sample.column("v").to_pylist()
    for dim in sorted(set(dims.tolist())):
        x = _matrix([packed[i] for i in np.flatnonzero(dims == dim)], dim)
        chosen, far = [0], _angles(x, x[:1])[:, 0]
        while len(chosen) < min(most, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _angles(x, x[chosen[-1:]])[:, 0])
        out[dim] = x[chosen]
    return out


def _placed(pivots: dict[int, np.ndarray]):
    """(id, dim, v) to (dim, pivot, angle, id, v); a length that the sample has not seen has one pivot, the first axis."""

    def run(batches):
        for b in batches:
            dims = np.array(b.column(1).to_pylist(), int)
            pivot, angle = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            packed = b.column(2).to_pylist()
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                t = _angles(_matrix([packed[i] for i in at], dim), pivots.get(dim, np.eye(1, dim)))
                pivot[at], angle[at] = t.argmin(1), t.min(1)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(pivot), pa.array(angle), b.column(0), b.column(2)], ["dim", "pivot", "angle", "id", "v"])

    return run


def _blocks(batches):
    """Sorted rows to blocks of one pivot, with their slice (the partition), angles, ids and vectors."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in range(2)], 1)
        edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else []
        for s, e in zip(edges, [*edges[1:], len(key)], strict=True):
            for i in range(int(s), int(e), BLOCK):
                rows = b.slice(i, min(BLOCK, int(e) - i))
                angle = rows.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(key[s, 0])], pa.int32()), pa.array([int(key[s, 1])], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([float(angle.min())]), pa.array([float(angle.max())]), pa.array([rows.column(3).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(rows.column(4).to_pylist())], pa.binary())],
                    ["dim", "pivot", "slice", "block", "lo", "hi", "ids", "v"],
                )
                n += 1


def _apart(p: np.ndarray, lo, hi) -> np.ndarray:
    """The least angle between probes at p from a pivot and vectors at lo to hi."""
    return np.maximum(0, np.maximum(p - hi, lo - p) - _SLACK)


def _spread(pivots: dict[int, np.ndarray], slices: dict[int, np.ndarray], first: bool):
    """Probes (id, dim, v, kth) to the slices (pivot, slice, lo, hi) that may hold one of their best: those nearest by the bound first, later those left that the k-th score lets in."""

    def run(batches):
        for b in batches:
            row, where, angle = [], [], []
            for i, (dim, v, kth) in enumerate(zip(b.column("dim").to_pylist(), b.column("v").to_pylist(), b.column("kth").to_pylist(), strict=True)):
                have = slices.get(dim)
                if have is None:
                    continue
                p = _angles(np.frombuffer(v)[None, :], pivots.get(dim, np.eye(1, dim)))[0][have[:, 0].astype(int)]
                bound = _apart(p, have[:, 2], have[:, 3])
                nearest = p == p.min()
                take = np.flatnonzero(nearest if first else ~nearest & (np.cos(bound) >= kth - _ROUND))
                row.append(np.full(len(take), i))
                where.append(take)
                angle.append(p[take])
            if row:
                rows = b.take(pa.array(np.concatenate(row).astype(np.int64)))
                dims = np.array(rows.column("dim").to_pylist(), int)
                at = np.concatenate(where)
                found = np.array([slices[d][k, :2] for d, k in zip(dims.tolist(), at.tolist(), strict=True)], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.concatenate(angle)), *rows.columns], ["pivot", "slice", "angle", *rows.schema.names])

    return run


def _search(k: int, least: float, counted: bool):
    """Probes, then blocks of one pivot and slice in order of angle, to the k best for each probe; counted gives the pairs of blocks and probes read and there instead."""

    def run(batches):
        key, held, read, there = None, [], 0, 0
        state = None

        def answers():
            if state is not None:
                ids, _, _, score, found = state
                i, j = np.nonzero(score > -np.inf)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(found[i, j]), pa.array(score[i, j])], ["query_id", "doc_id", "score"])

        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            for r in range(b.num_rows):
                now = c["dim"][r], c["pivot"][r], c["slice"][r], c["grp"][r]
                if now != key:
                    if not counted:
                        yield from answers()
                    key, held, state = now, [], None
                if c["role"][r] == 0:
                    held.append((c["id"][r], c["angle"][r], c["kth"][r], c["v"][r]))
                    continue
                if not held:
                    continue
                if state is None:
                    n = len(held)
                    state = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
                    probes = _matrix([h[3] for h in held], key[0])
                ids, angle, kth, score, found = state
                live = np.flatnonzero(np.cos(_apart(angle, c["lo"][r], c["hi"][r])) >= np.maximum(np.maximum(kth, score[:, -1]), least) - _ROUND)
                read, there = read + len(live), there + len(ids)
                if not len(live):
                    continue
                others = np.frombuffer(c["ids"][r], np.int64)
                near = np.round(probes[live] @ np.frombuffer(c["v"][r]).reshape(len(others), -1).T, 4)
                near[ids[live][:, None] == others[None, :]] = -np.inf
                near[near < least] = -np.inf
                both = np.concatenate([score[live], near], 1)
                names = np.concatenate([found[live], np.broadcast_to(others, near.shape)], 1)
                cut = min(k, both.shape[1])
                # Ties at the cut go by id, so all that reach it are sorted.
                edge = -np.partition(-both, cut - 1, axis=1)[:, cut - 1]
                for i, at in enumerate(live.tolist()):
                    pick = np.flatnonzero((both[i] >= edge[i]) & (both[i] > -np.inf))
                    pick = pick[np.lexsort((names[i, pick], -both[i, pick]))][:k]
                    score[at, : len(pick)], found[at, : len(pick)] = both[i, pick], names[i, pick]
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([there], pa.int64()), pa.array([0.0])], ["query_id", "doc_id", "score"])
        else:
            yield from answers()

    return run


def nearest(vectors: DataFrame, probes: DataFrame, k: int, least: float = 0.0, most_pivots: int = PIVOTS, read: list | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest vectors (vec_id, embedding) by cosine, rounded to four digits, to each probe (query_id, probe), ties by smaller id, itself excluded.

    Every vector that could be among them is compared, so the result is exact; vectors
    without a direction (null, zero or not finite) are near nothing, and lengths do not mix.
    Neither side is broadcast: vectors are dealt by pivot in slices, and probes go to the
    slices that their bounds leave, in groups of about HELD. read gets the pairs of probes
    and blocks compared, and those there are.
    """
    from .search import top_k

    spark = vectors.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = settle(_units(vectors, "vec_id", "embedding"))
    asked = settle(_units(probes, "query_id", "probe"))
    pivots = _pivots(units, most_pivots)
    order = ["dim", "pivot", "angle", "id"]
    placed = units.mapInArrow(_placed(pivots), "dim int, pivot int, angle double, id long, v binary").repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = settle(placed.mapInArrow(_blocks, "dim int, pivot int, slice int, block long, lo double, hi double, ids binary, v binary"))
    # A row a pivot and partition; a pivot's vectors lie in consecutive partitions.
    heads = blocks.groupBy("dim", "pivot", "slice").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    slices = {d: np.array([[r["pivot"], r["slice"], r["lo"], r["hi"]] for r in sorted(heads) if r["dim"] == d], float) for d in {r["dim"] for r in heads}}
    groups = max(1, -(-asked.count() // HELD))

    def answers(rows: DataFrame, first: bool, counted: bool = False) -> DataFrame:
        spread = rows.select("id", "dim", "v", "kth").mapInArrow(_spread(pivots, slices, first), "pivot int, slice int, angle double, id long, dim int, v binary, kth double").withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
        side = spread.select("dim", "pivot", "slice", "grp", F.lit(0).alias("role"), F.lit(0).cast("long").alias("block"), "id", "angle", "kth", "v", *none("double", "lo", "hi"), *none("binary", "ids"))
        meet = spread.select("dim", "pivot", "slice", "grp").distinct()
        other = blocks.join(meet, ["dim", "pivot", "slice"]).select("dim", "pivot", "slice", "grp", F.lit(1).alias("role"), "block", *none("long", "id"), *none("double", "angle", "kth"), "v", "lo", "hi", "ids")
        both = side.unionByName(other).repartition(n, "dim", "pivot", "slice", "grp").sortWithinPartitions("dim", "pivot", "slice", "grp", "role", "block")
        return both.mapInArrow(_search(k, least, counted), "query_id long, doc_id long, score double")

    none_yet = asked.withColumn("kth", F.lit(float("-inf")))
    early = settle(top_k(answers(none_yet, True), k))
    kth = early.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
    known = asked.join(kth, "id", "left").withColumn("kth", F.coalesce("found", F.lit(float("-inf")))).drop("found")
    if read is not None:
        counts = [answers(rows, first, True).agg(F.sum("query_id"), F.sum("doc_id")).first() for rows, first in ((none_yet, True), (known, False))]
        read += [sum(c[0] or 0 for c in counts), asked.count() * blocks.count()]
    return top_k(early.drop("rank").unionByName(answers(known, False)), k)
