"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors whose cosine is c apart by at most 2 - 2c in squared distance. Rotated and
split into blocks with budgets that sum to that, in proportion to the blocks' energy,
any such pair is within budget in some block. Each block is range-joined on a grid over
its two leading coordinates; the pairs in budget are verified in full and counted in the
first block that finds them, so no pair is ever written. Only a spanning forest of the
links found leaves a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import settle, tasks
from .graph import components

COSINE = 0.9
BLOCKS = 4
#: Vectors on which the rotation is fitted; it changes speed, not results.
SAMPLE = 4096
#: Vectors of a grid cell that are one side of a comparison; larger cells are dealt to several tasks.
HOME = 8192
#: Rows of a cell compared at once with as many others.
STEP = 2048
_AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))
_SLACK = 1e-6


class Grid:
    """Rotation, blocks, their budgets and the cell width of each."""

    def __init__(self, sample: np.ndarray, cosine: float):
        self.dim = dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        values, axes = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(dim, dim) + np.eye(dim) * 1e-9)
        self.rotation = axes[:, np.argsort(-values, kind="stable")]
        energy = np.sort(values)[::-1]
        edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        share = np.array([energy[b].sum() for b in self.blocks])
        self.budget = (2 - 2 * cosine) * share / share.sum() * (1 + _SLACK) + 1e-9
        self.width = np.sqrt(self.budget) * (1 + _SLACK)
        self.cosine = cosine
        # Coordinates of unit vectors lie in [-1, 1], which bounds the cells.
        self.across = np.ceil(2 / self.width).astype(int) + 3

    def turn(self, v: np.ndarray) -> np.ndarray:
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        return unit @ self.rotation

    def cells(self, turned: np.ndarray, k: int) -> np.ndarray:
        """Grid coordinates in block k."""
        first = self.blocks[k].start
        x = turned[:, first : min(first + 2, self.blocks[k].stop)]
        c = np.floor((x + 1) / self.width[k]).astype(int) + 1
        return c if c.shape[1] == 2 else np.column_stack([c, np.ones(len(c), int)])


def _floats(column, dim: int) -> np.ndarray:
    """Packed vectors of one length as a matrix."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.float32 if len(flat) == 4 * dim * len(column) else np.float64).reshape(len(column), -1).astype(np.float64)


def _prepare(kind: type):
    """Vectors (vec_id, list) to their components of a kind, packed, a fingerprint and their length.

    Components are scaled by a power of two, so that no square overflows or vanishes; the cosine stays as it is.
    """

    def run(batches):
        for b in batches:
            ids, packed, prints, dims = b.column(0), [], [], []
            for i, v in zip(ids.to_pylist(), b.column(1).to_pylist(), strict=True):
                x = None if i is None or not v or any(c is None for c in v) else np.array(v, np.float64)
                good = x is not None and np.isfinite(x).all() and (x != 0).any()
                if good:
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype(kind)
                packed.append(x.tobytes() if good else None)
                prints.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary()), pa.array(prints, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "v", "f", "dim"])

    return run


def _compare(grid: Grid):
    """Rows (block, cell, salt, role, id, w, v), sorted, home vectors of a cell first, to links per vector and forest edges."""

    def links(k, home, other, same):
        """Pairs (i, j) of rows that link and whose first block within budget is k."""
        hx, ox = home["turned"][:, grid.blocks[k]].astype(np.float32), other["turned"][:, grid.blocks[k]].astype(np.float32)
        found, oo = [], (ox * ox).sum(1)[None, :]
        for s in range(0, len(hx), STEP):
            x = hx[s : s + STEP]
            i, j = np.nonzero((x * x).sum(1)[:, None] + oo - 2 * (x @ ox.T) <= grid.budget[k] + 1e-5)
            found.append(np.stack([i + s, j]))
        i, j = np.concatenate(found, 1)
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        out_i, out_j = [], []
        for s in range(0, len(i), 1 << 17):
            a, b = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
            x, y = home["v"][a], other["v"][b]
            near = np.einsum("ij,ij->i", x, y) >= grid.cosine * (home["norm"][a] * other["norm"][b])
            a, b = a[near], b[near]
            gap = (home["turned"][a] - other["turned"][b]) ** 2
            first = np.stack([gap[:, blk].sum(1) <= grid.budget[m] for m, blk in enumerate(grid.blocks)], 1).argmax(1)
            mine = first == k
            out_i.append(a[mine])
            out_j.append(b[mine])
        return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)

    def emit(home, other, i, j, same):
        ids = home["id"] if same else np.concatenate([home["id"], other["id"]])
        at = 0 if same else len(home["id"])
        label, rows = np.arange(len(ids)), np.concatenate([i, j + at])
        while True:
            low = np.minimum(label[i], label[j + at])
            new = label.copy()
            np.minimum.at(new, rows, np.concatenate([low, low]))
            new = new[new]
            if (new == label).all():
                break
            label = new
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i, other["w"][j])
        np.add.at(n, j + at, home["w"][i])
        have, edge = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
        return [(ids[have], None, n[have]), (ids[label[edge]], ids[edge], None)]

    def pack(found):
        for a, b, n in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.nulls(len(a), pa.int64()) if n is None else pa.array(n)], ["a", "b", "n"])

    def load(rows):
        v = _floats(rows.column("v"), grid.dim)
        return {"id": rows.column("id").to_numpy(), "w": rows.column("w").to_numpy(), "v": v, "norm": np.sqrt(np.einsum("ij,ij->i", v, v)), "turned": grid.turn(v).astype(np.float32).astype(np.float64)}

    def run(batches):
        key, home = None, None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            role = b.column(3).to_numpy()
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1) | (role[1:] != role[:-1])))
            for s, e in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                if tuple(keys[s]) != key:
                    key, home = tuple(keys[s]), None
                for q in range(s, e, STEP):
                    part = load(b.slice(q, min(STEP, e - q)))
                    k = int(key[0])
                    if home is not None:
                        i, j = links(k, home, part, False)
                        yield from pack(emit(home, part, i, j, False)) if len(i) else ()
                    if role[s] == 0:
                        i, j = links(k, part, part, True)
                        yield from pack(emit(part, part, i, j, True)) if len(i) else ()
                        home = part if home is None else {c: np.concatenate([home[c], part[c]]) for c in home}

    return run


def _join(reps: DataFrame, cosine: float, dim: int) -> DataFrame:
    """(a, null, n): n weighted links of a found in one place; (a, b, null): an edge of the forest. reps: id, w, v of one length."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    grid = Grid(_floats(sample.combine_chunks() if sample.num_chunks != 1 else sample.chunk(0), dim), cosine)

    def count(batches):
        for b in batches:
            turned = grid.turn(_floats(b.column(0), dim)).astype(np.float32).astype(np.float64)
            for k in range(len(grid.blocks)):
                c = grid.cells(turned, k)
                cell, n = np.unique(c[:, 0] * grid.across[k] + c[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k), pa.int32()), pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["k", "cell", "n"])

    # The grid bounds these rows: cells of [-1, 1] squared, for each block.
    counted = reps.select("v").mapInArrow(count, "k int, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).collect()
    salts = {(r["k"], r["cell"]): -(-r["n"] // HOME) for r in counted}

    def spread(batches):
        for b in batches:
            v = _floats(b.column(2), dim)
            turned = grid.turn(v).astype(np.float32).astype(np.float64)
            ids = b.column(0).to_numpy()
            luck = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for k in range(len(grid.blocks)):
                c = grid.cells(turned, k)
                row, cell, salt, role = [], [], [], []
                for i, (x, y) in enumerate(c.tolist()):
                    home = x * int(grid.across[k]) + y
                    n = salts[k, home]
                    s = int(luck[i]) % n
                    for t in range(s, n):
                        row.append(i)
                        cell.append(home)
                        salt.append(t)
                        role.append(int(t > s))
                    for dx, dy in _AHEAD:
                        there = (x + dx) * int(grid.across[k]) + y + dy
                        for t in range(salts.get((k, there), 0)):
                            row.append(i)
                            cell.append(there)
                            salt.append(t)
                            role.append(1)
                row = np.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k), pa.int32()), pa.array(cell, pa.int64()), pa.array(salt, pa.int32()), pa.array(role, pa.int32()), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], ["k", "cell", "salt", "role", "id", "w", "v"])

    rows = reps.select("id", "w", "v").mapInArrow(spread, "k int, cell long, salt int, role int, id long, w long, v binary")
    dealt = rows.repartition(tasks(reps.sparkSession), "k", "cell", "salt").sortWithinPartitions("k", "cell", "salt", "role")
    return settle(dealt.mapInArrow(_compare(grid), "a long, b long, n long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors link at a cosine of at least `cosine` in double precision. Null, empty and
    zero vectors, vectors with a null or non-finite component, and rows with a null id
    link with nothing. Vectors of different lengths never link. Equal vectors are one in
    the join and count each other; repeated rows do as well. Other columns are not read.
    """
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<float>" if single else "array<double>").alias("e"))
    ready = settle(rows.mapInArrow(_prepare(np.float32 if single else np.float64), "vec_id long, v binary, f binary, dim int"))
    reps = settle(ready.filter("v is not null").groupBy("f").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("dim").alias("dim")))
    found = None
    for row in reps.select("dim").distinct().orderBy("dim").collect():
        one = _join(reps.filter(F.col("dim") == row["dim"]), cosine, row["dim"])
        found = one if found is None else found.unionByName(one)
    if found is None:
        return ready.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("n is not null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    classes = reps.select("f", "id", "w").join(counts, F.col("id") == F.col("c"), "left").join(labels.withColumnRenamed("id", "l"), F.col("id") == F.col("l"), "left")
    known = classes.filter("w > 1 or n is not null").select(F.col("f").alias("g"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = ready.join(known, (F.col("f") == F.col("g")) & F.col("v").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
