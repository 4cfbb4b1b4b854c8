"""Benchmark decontamination by greedy string tiling.

1. Runs of SEED words (seeds) have Karp-Rabin fingerprints. A bit map of the benchmark's,
   of fixed size, tells on the executors which seeds of a document can be in an item.
2. Documents with such seeds, equal texts once, meet the items in a shuffle join. An
   item half covered shares a least number of seeds with a document; with its seeds
   ordered by the documents that have them, one of the rarest, and just these join.
3. Of each pair that met, the longest runs of common words that no earlier tile covers
   are marked one after another; the tiles' share of the item's words is the coverage.
   Tiles may lie in any order, so reordered passages are found as well.
The benchmark may be of any size: nothing of it but the bit map is on the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import frugal, lean_batches, settle, small_side
from ._text import parts, utf8, windows, words

#: Words of a seed, and least words of a tile.
SEED = 4
#: Share of an item's words from which a document is contaminated.
COVERED = 0.5
#: Bytes of documents handled at once.
CHUNK = 1 << 21
#: Bits of the map of the benchmark's seeds, two set by each; a fuller map only lets more seeds through to the join.
MAP_BITS = 24
#: Contaminated texts that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50000


def tiles(length: int, seeds: list[tuple[int, int]]) -> int:
    """Words of an item of some length covered by greedy tiles of at least SEED words; seeds are pairs (doc, item) where SEED words agree."""
    runs = []
    last: dict[int, list[int]] = {}
    for d, i in sorted(seeds):
        run = last.get(d - i)
        if run and d <= run[0] + run[2] - SEED + 1:
            run[2] = d + SEED - run[0]
        else:
            run = last[d - i] = [d, i, SEED]
            runs.append(run)
    heap = [(-n, i, d) for d, i, n in runs]
    heapq.heapify(heap)
    in_doc, in_item = set(), np.zeros(length, bool)
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [not in_item[i + k] and d + k not in in_doc for k in range(n)]
        if all(free):
            in_item[i : i + n] = True
            in_doc.update(range(d, d + n))
            continue
        k = 0
        while k < n:
            if not free[k]:
                k += 1
                continue
            j = k
            while j < n and free[j]:
                j += 1
            if j - k >= SEED:
                heapq.heappush(heap, (k - j, i + k, d + k))
            k = j
    return int(in_item.sum())


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each seed in the map."""
    return (seeds >> np.uint64(64 - MAP_BITS)).astype(np.int64), (seeds & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)


def _seeds(column):
    """(seed, place, row, words) of a column of texts: by row, a text of fewer than SEED words is one seed."""
    data, at = utf8(pc.utf8_lower(column))
    for i, j in parts(at, CHUNK):
        hashes, _, _, offsets = words(data[at[i] : at[j]], at[i : j + 1] - at[i], loose=True)
        seeds, where, rows = windows(hashes, offsets, SEED, whole=True)
        yield i, j, seeds, where - offsets[rows], rows, np.diff(offsets)


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _item_seeds(batches):
    """Items (item, text) to (item, length, seeds, places), packed in order of seed and place."""
    for b in batches:
        for i, j, seeds, where, rows, n in _seeds(b.column(1)):
            at = np.searchsorted(rows, np.arange(j - i + 1))
            order = [np.lexsort((where[x:y], seeds[x:y])) + x for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), _packed([seeds[o] for o in order]), _packed([where[o].astype(np.int32) for o in order])], ["item", "length", "seeds", "places"])


def _map(batches):
    """Items' seeds to the map of their bits."""
    bits = np.zeros(1 << MAP_BITS, bool)
    for b in batches:
        for x in b.column(0).to_pylist():
            for at in _bits(np.frombuffer(x, np.uint64)):
                bits[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _document_seeds(bits: bytes):
    """Documents (a, b, text) to those with seeds in the map: (a, b, seeds, places), packed as those of items."""

    @frugal
    def run(batches):
        known = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for b in batches:
            for i, j, seeds, where, rows, _ in _seeds(b.column(2)):
                first, second = _bits(seeds)
                hit = known[first] & known[second]
                seeds, where, rows = seeds[hit], where[hit], rows[hit]
                if not len(rows):
                    continue
                docs = np.unique(rows)
                at = np.searchsorted(rows, np.append(docs, j - i))
                order = [np.lexsort((where[x:y], seeds[x:y])) + x for x, y in zip(at[:-1], at[1:], strict=True)]
                a, h = (b.column(c).slice(i, j - i).take(pa.array(docs)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([a, h, _packed([seeds[o] for o in order]), _packed([where[o].astype(np.int32) for o in order])], ["a", "b", "seeds", "places"])

    return run


def _one_by_one(names: list[str], each: bool):
    """Rows with packed seeds to one row a seed: all places of items (each), or the distinct seeds of documents."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                lists = [np.frombuffer(x, np.uint64) for x in part.column("seeds").to_pylist()]
                lists = lists if each else [np.unique(x) for x in lists]
                row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([part.column(c).take(row) for c in names] + [pa.array(np.concatenate(lists).view(np.int64))], [*names, "seed"])

    return run


def _cover(batches):
    """Pairs of packed seeds (a, b, item, length, seeds, places, seeds, places) to the item's coverage."""
    for batch in batches:
        shares = []
        for length, s, p, t, q in zip(*(batch.column(c).to_pylist() for c in range(3, 8)), strict=True):
            s, t, p, q = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), np.frombuffer(p, np.int32), np.frombuffer(q, np.int32)
            lo, hi = np.searchsorted(t, s, "left"), np.searchsorted(t, s, "right")
            n = hi - lo
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found = list(zip(q[place].tolist(), np.repeat(p, n).tolist(), strict=True))
            shares.append((tiles(length, found) / length if length >= SEED else float(bool(found))) if length else 0.0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(shares, pa.float64())], ["a", "b", "item", "coverage"])


def coverages(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, item, coverage) of every text (a, b, text) and item (item, text) that it covers to COVERED; a, b stand for the text."""
    held = settle(items.mapInArrow(_item_seeds, "item long, length long, seeds binary, places binary").filter("length > 0"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in held.select("seeds").mapInArrow(_map, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row[0], np.uint8)
    docs = settle(texts.mapInArrow(_document_seeds(bits.tobytes()), "a long, b long, seeds binary, places binary").dropDuplicates(["a", "b"]))
    seeds = docs.select("a", "b", "seeds").mapInArrow(_one_by_one(["a", "b"], False), "a long, b long, seed long")
    held_by = seeds.groupBy("seed").agg(F.count("*").alias("df"))
    places = held.select("item", "length", "seeds").mapInArrow(_one_by_one(["item", "length"], True), "item long, length long, seed long").join(held_by, "seed")
    # A tile has one seed at least for SEED words. Of the seeds that documents have, an item can do without as many of the most frequent as leave it one fewer than that.
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("length") * COVERED) / SEED))
    rare = places.withColumns({"n": F.count("*").over(Window.partitionBy("item")), "rank": F.row_number().over(Window.partitionBy("item").orderBy("df", "seed"))}).filter(F.col("rank") <= F.col("n") - need + 1)
    pairs = seeds.join(rare.select("item", "seed").distinct(), "seed").select("a", "b", "item").distinct()
    both = pairs.join(held.withColumnsRenamed({"seeds": "s", "places": "p"}), "item").join(docs, ["a", "b"]).select("a", "b", "item", "length", "s", "p", "seeds", "places")
    return both.mapInArrow(_cover, "a long, b long, item long, coverage double").filter(F.col("coverage") >= COVERED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with item_id, coverage and contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, in lower case. A
    document is contaminated if its tiles cover COVERED of the words of an item; item_id is the
    best covered one (the smallest at a tie) and coverage its share, or null and 0 for
    a clean document. Null and empty texts are clean; null, empty and repeated items
    count for nothing more, and so do items without an id. An item of fewer than SEED
    words is covered only by a document that consists of it. Repeated documents have a
    result each; an empty benchmark leaves all clean. Clashing columns are replaced.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    lean_batches(docs.sparkSession)
    a, b = F.xxhash64(F.lit(0), F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    found = coverages(docs.filter(F.col(text).isNotNull()).select(a.alias("a"), b.alias("b"), F.col(text).cast("string").alias("text")), items)
    best = settle(found.groupBy("a", "b").agg(F.max(F.struct("coverage", (-F.col("item")).alias("item"))).alias("m")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), (-F.col("m.item")).alias("_item"), F.col("m.coverage").alias("_coverage")))
    out = docs.join(small_side(best, BROADCAST_ROWS), (a == F.col("_a")) & (b == F.col("_b")) & F.col(text).isNotNull(), "left")
    return out.withColumns({"item_id": F.col("_item"), "coverage": F.coalesce("_coverage", F.lit(0.0)), "contaminated": F.col("_item").isNotNull()}).drop("_a", "_b", "_item", "_coverage")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "coverage", "contaminated")
