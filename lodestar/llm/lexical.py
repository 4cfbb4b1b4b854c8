"""Ranked lexical search by the threshold algorithm.

Every term of the items has a list of the documents that hold it, sorted by impact. All
lists are read to the same depth, round after round; every document met there is looked up
in the forward index, which gives its whole scores. What no list has shown yet can score
no more than the impacts at that depth add up to: an item is done once that threshold is
below its k-th score. A document is looked up once, for all items that are not done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import frugal, lean_batches, settle, tasks
from ._text import _LOWER, PIECE, parts, utf8, words

#: Results of an item.
LIMIT = 10
#: Terms of items, repeats across items counted, that are searched for at once: their table goes to every task.
TERMS = 1 << 17
#: Depth of the first round, the factor (as a power of two) from one round to the next, and postings of a block of a list.
DEPTH, GROWTH, BLOCK = 256, 3, 128
#: Cells of the table of documents by items in which a task adds up scores.
CELLS = 1 << 20
#: Bytes of text that are split into terms at once.
TEXT = 1 << 22

_NONE = -(2**63)


def _terms(data: np.ndarray, offsets: np.ndarray):
    return words(data, offsets, lower=True, loose=True)


class Vocabulary:
    """The terms of a set of items by hash; a word is a term if its bytes are."""

    def __init__(self, terms: list[bytes]):
        data, offsets = utf8(pa.array(terms, pa.binary()))
        hashes, start, end, _ = _terms(data, offsets)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.start, self.length, self.data = hashes[self.order], start[self.order], (end - start)[self.order], data

    def find(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 of a word that is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero((self.hashes[at] == hashes) & (self.length[at] == end - start))
        out = np.full(len(hashes), -1, np.int64)
        sizes = end[found] - start[found]
        ends = np.cumsum(sizes)
        i = 0
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
            here, size = found[i:j], sizes[i:j]
            first = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(first, size)
            same = _LOWER[data[np.repeat(start[here], size) + inside]] == self.data[np.repeat(self.start[at[here]], size) + inside]
            good = np.logical_and.reduceat(same, first)
            out[here[good]] = at[here[good]]
            i = j
        return out


def _item_terms(batches):
    """(uid, item_id, text) to (uid, item_id, term), each term once."""
    for b in batches:
        for k in range(b.num_rows):
            data, offsets = utf8(b.column(2).slice(k, 1))
            _, start, end, _ = _terms(data, offsets)
            low = _LOWER[data].tobytes()
            found = sorted({low[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)})
            rows = b.slice(k, 1).take(pa.array([0] * len(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.binary())], ["uid", "item_id", "term"])


def _forward(known: Vocabulary):
    """(uid, doc_id, text) to (uid, doc_id, n, t, f): all terms counted, and the known ones with their frequencies, packed."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            for i, j in parts(offsets, TEXT):
                piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, start, end, count = _terms(piece, at)
                n = np.diff(count)
                term = known.find(piece, hashes, start, end)
                held = np.flatnonzero(term >= 0)
                key, freq = np.unique(np.repeat(np.arange(j - i), n)[held] * len(known.hashes) + term[held], return_counts=True)
                edges = np.searchsorted(key, np.arange(j - i + 1) * len(known.hashes))
                t, f = (key % max(1, len(known.hashes))).astype(np.int32), freq.astype(np.int32)
                pack = lambda x, edges=edges: pa.array([x[p:q].tobytes() for p, q in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pack(t), pack(f)], ["uid", "doc_id", "n", "t", "f"])

    return run


def _flat(batch: pa.RecordBatch):
    """Row, term, frequency and length for every posting of rows of the forward index."""
    t, f = (np.frombuffer(utf8(batch.column(c))[0], np.int32).astype(np.int64) for c in ("t", "f"))
    sizes = np.diff(utf8(batch.column("t"))[1]) // 4
    row = np.repeat(np.arange(batch.num_rows), sizes)
    return row, t, f, batch.column("n").to_numpy()[row]


def impact(f: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term of weight 1 adds to the score, in 64-bit integers."""
    return 1000000000 * f // (1000 * f + 8 * (100 - 90 + 90 * n * docs // terms))


def _document_counts(batches):
    for b in batches:
        t, n = np.unique(_flat(b)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n, pa.int64())], ["t", "df"])


def _postings(docs: int, terms: int, weight: np.ndarray):
    def run(batches):
        for b in batches:
            row, t, f, n = _flat(b)
            keep = weight[t] > 0
            row, t, f, n = row[keep], t[keep], f[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(impact(f, n, docs, terms)), b.column("uid").take(pa.array(row))], ["t", "impact", "uid"])

    return run


def _blocks(batches):
    """Sorted postings to blocks of one term: partition, place in the partition's part of the list, size, largest impact, documents."""
    part, term, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        t, value, uid = (b.column(c).to_numpy() for c in range(3))
        edges = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else []
        out: list[tuple] = []
        for s, e in zip(edges, [*edges[1:], len(t)], strict=True):
            if t[s] != term:
                term, at = int(t[s]), 0
            for i in range(int(s), int(e), BLOCK):
                j = min(int(e), i + BLOCK)
                out.append((term, part, at, j - i, int(value[i]), uid[i:j].tobytes()))
                at += j - i
        if out:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "part", "place", "n", "hi", "uids"])


def _documents(batches):
    """The documents of blocks, those of a batch once."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(utf8(b.column(0))[0], np.int64)))], ["uid"])


def _score(docs: int, terms: int, weight: np.ndarray, first: np.ndarray, items: np.ndarray, of: np.ndarray, least: np.ndarray, k: int):
    """Rows of the forward index to (item, uid, doc_id, score): the best k of a batch that reach the item's k-th score so far.

    items[first[t]:first[t + 1]] are the numbers of the items that hold term t; of names them.
    """

    def run(batches):
        floor = least.copy()
        for whole in batches:
            width = max(1, CELLS // max(1, len(of)))
            for s in range(0, whole.num_rows, width):
                b = whole.slice(s, width)
                row, t, f, n = _flat(b)
                gain = weight[t] * impact(f, n, docs, terms)
                many = first[t + 1] - first[t]
                at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[t], many)
                cell, gain = np.repeat(row, many) * len(of) + items[at], np.repeat(gain, many)
                table = np.zeros(b.num_rows * len(of), np.int64)
                np.add.at(table, cell, gain)
                table = table.reshape(b.num_rows, len(of))
                i, j = np.nonzero((table > 0) & (table >= floor[None, :]))
                if not len(i):
                    continue
                score, ids = table[i, j], b.column("doc_id").fill_null(_NONE).to_numpy()[i]
                order = np.lexsort((b.column("uid").to_numpy()[i], ids, -score, j))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(j)) - np.searchsorted(j, j)
                full = place == k - 1
                floor[j[full]] = np.maximum(floor[j[full]], score[full])
                i, j, score = i[place < k], j[place < k], score[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(of[j]), b.column("uid").take(pa.array(i)), b.column("doc_id").take(pa.array(i)), pa.array(score)], ["item", "uid", "doc_id", "score"])

    return run


def _search(docs: DataFrame, asked: pa.Table, k: int, trace: list | None) -> DataFrame:
    """item, uid, doc_id, score, rank for one block of items; asked has their (uid, term)."""
    spark = docs.sparkSession
    item, term = asked.column("uid").to_numpy(), asked.column("term").combine_chunks().to_pylist()
    spelled = sorted(set(term))
    known = Vocabulary(spelled)
    number = dict(zip(spelled, np.argsort(known.order, kind="stable").tolist(), strict=True))
    t = np.array([number[x] for x in term], np.int64)

    forward = settle(docs.mapInArrow(frugal(_forward(known)), "uid long, doc_id long, n long, t binary, f binary"))
    total = forward.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = int(total["n"]), int(total["l"] or 0)
    df = np.zeros(len(spelled), np.int64)
    counted = forward.mapInArrow(_document_counts, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    lists = forward.mapInArrow(_postings(n_docs, n_terms, weight), "t int, impact long, uid long")
    order = ["t", F.desc("impact"), "uid"]
    lists = settle(lists.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).mapInArrow(_blocks, "t int, part int, place long, n long, hi long, uids binary"))
    # A partition's part of a list begins behind the parts before it; of these sums there are as many as terms and partitions at most.
    sums = lists.groupBy("t", "part").agg(F.sum("n").alias("n"))
    before = settle(sums.select("t", "part", (F.sum("n").over(Window.partitionBy("t").orderBy("part")) - F.col("n")).alias("before")))
    lists = lists.join(F.broadcast(before), ["t", "part"]).withColumn("start", F.col("before") + F.col("place"))

    # The largest impact of a term behind each depth of DEPTH times a power of two.
    level = F.floor(F.log2(F.col("start") / DEPTH) + 1e-9).cast("int")
    behind = lists.filter(F.col("start") >= DEPTH).select("t", "hi", F.explode(F.sequence(F.lit(0), level)).alias("level")).groupBy("t", "level").agg(F.max("hi").alias("hi")).toArrow()
    levels = int(pc.max(behind.column("level")).as_py() or 0) + 2 if behind.num_rows else 1
    deep = np.zeros((levels, len(spelled)), np.int64)
    deep[behind.column("level").to_numpy(), behind.column("t").to_numpy()] = behind.column("hi").to_numpy()
    names, own = np.unique(item, return_inverse=True)
    threshold = np.zeros((levels, len(names)), np.int64)
    for depth in range(levels):
        np.add.at(threshold[depth], own, weight[t] * deep[depth][t])

    live, least, now, came = np.ones(len(names), bool), np.zeros(len(names), np.int64), 0, 0
    top, seen = None, None
    while True:
        asking = live[own] & (weight[t] > 0)
        of = np.flatnonzero(live)
        terms = np.unique(t[asking])
        wanted = spark.createDataFrame(pd.DataFrame({"t": terms.astype(np.int32)}), "t int")
        read = lists.join(F.broadcast(wanted), "t", "left_semi").filter((F.col("start") >= came) & (F.col("start") < DEPTH << now))
        met = read.select("uids").mapInArrow(_documents, "uid long").distinct()
        met = settle(met if seen is None else met.join(seen, "uid", "left_anti"))
        seen = met if seen is None else seen.unionByName(met)
        # The items that hold each term, by number among those that are not done.
        by = np.lexsort((own[asking], t[asking]))
        held, items = t[asking][by], np.searchsorted(of, own[asking][by])
        first = np.searchsorted(held, np.arange(len(spelled) + 1))
        found = forward.join(met, "uid", "left_semi").mapInArrow(frugal(_score(n_docs, n_terms, weight, first, items, names[of], least[of], k)), "item long, uid long, doc_id long, score long")
        found = found if top is None else top.drop("rank").unionByName(found)
        top = settle(found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "uid"))).filter(F.col("rank") <= k))
        kth = top.filter(F.col("rank") == k).select("item", "score").toArrow()
        least[np.searchsorted(names, kth.column("item").to_numpy())] = kth.column("score").to_numpy()
        if trace is not None:
            trace.append((DEPTH << now, len(of), met.count()))
        done = (threshold[now] < least) | (threshold[now] == 0)
        live &= ~done
        if not live.any():
            return top
        # No deeper than where the threshold falls below the k-th score that is known already.
        enough = (threshold < least[None, :]) | (threshold == 0)
        came = DEPTH << now
        now = min(now + GROWTH, int(enough.argmax(0)[live].max()))


def search(docs: DataFrame, items: DataFrame, k: int = LIMIT, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", trace: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for every item, ties by smaller doc_id.

    Terms are runs of ASCII letters and digits and of all other than ASCII characters, with
    A to Z lowered, of whole texts. A null or empty text has none: such an item finds
    nothing, such a document is not counted. Rows with a null doc_id are documents, the
    first of a tie; repeated rows are documents of their own, and so are repeated items.
    Other columns are not read. Items are taken in blocks of about TERMS terms, an item
    whole. trace gets the depth, the items and the documents looked up of each round.
    """
    lean_batches(docs.sparkSession)
    asked = settle(items.select(F.monotonically_increasing_id().alias("uid"), F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).mapInArrow(_item_terms, "uid long, item_id long, term binary"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = -(-asked.count() // TERMS)
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "term").toArrow()
        if part.num_rows:
            found = _search(rows, part, k, trace)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item long, uid long, doc_id long, score long, rank int")
    named = asked.select(F.col("uid").alias("item"), "item_id").distinct()
    return out.drop("uid").join(named, "item").select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = f"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWERED}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS term FROM documents), q AS (SELECT DISTINCT item_id, {_SPLIT} AS term FROM benchmark),
post AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM post GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, corpus),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
 FROM q JOIN post USING (term) JOIN w USING (term) JOIN len USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
