"""Substring dedup by Rabin-Karp hashes of every window of words.

1. Each task hashes every window of its documents and deals the hashes, packed by hash
   range, to the counting tasks.
2. A counting task finds the windows that occur more than once and which of their
   occurrences is not the first, and sends those back by document.
3. The documents, compressed, meet their repeated windows; windows merge into maximal
   removal intervals.
Packed rows hold many windows of one chunk of documents each, so a window, document or
source that holds a third of all rows weighs no more than its bytes. Windows that a sample
shows to be so frequent that even their bytes would crowd one task are not dealt: their first
occurrences, from minima of every chunk, are known to all tasks, which judge them on the spot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import deal, frugal, lean_batches, tasks
from ._text import mix, parts, utf8, windows, words

WINDOW = 20
#: Bytes of documents handled at once.
CHUNK = 1 << 21
#: Occurrences, as estimated from one document in SAMPLE, from which a window is not dealt. So few windows can have as many that they are bounded by the number of tasks.
HOT_ROWS, SAMPLE = 1 << 18, 64
_NULL = -(1 << 63)
_PACKED = "part int, kind int, d binary, h binary, n binary, x binary"


def pack_gaps(values: np.ndarray) -> bytes:
    """Increasing numbers below 2**32 as byte-sized gaps, with escapes."""
    gaps = np.diff(values, prepend=0).astype(np.uint32)
    big = gaps >= 255
    small = np.where(big, 255, gaps).astype(np.uint8)
    return np.uint32(len(small)).tobytes() + small.tobytes() + gaps[big].tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, np.uint32, -1, 4 + n)
    return np.cumsum(gaps)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=8).digest(), "little", signed=True) for i in range(len(offsets) - 1)], np.int64)


def _keys(batch, i: int, j: int) -> np.ndarray:
    return batch.column(0).slice(i, j - i).fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)


def document_part(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return (mix(d.view(np.uint64) ^ mix(h.view(np.uint64))) % np.uint64(n)).astype(np.int32)


def hash_part(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range of the hash: its top 32 bits, scaled."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_part(part: np.ndarray, n: int):
    """(part, rows of it in order)."""
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if edges[p + 1] > edges[p]:
            yield p, order[edges[p] : edges[p + 1]]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kind", "d", "h", "n", "x"])


def _chunk_windows(batches, window: int):
    """Documents with windows by chunk: keys, text hashes, and of every window its hash, row and start in the row."""
    for b in batches:
        data, at = utf8(b.column(1))
        for i, j in parts(at, CHUNK):
            span, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
            hashes, _, _, offsets = words(span, off)
            win, where, rows = windows(hashes, offsets, window)
            if len(win):
                yield _keys(b, i, j), span, off, win, rows, where - offsets[rows]


def _counts(window: int):
    @frugal
    def run(batches):
        for _, _, _, win, _, _ in _chunk_windows(batches, window):
            w, n = np.unique(win, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    return run


def _firsts(window: int, hot: np.ndarray):
    """The first occurrence in each chunk of each of the hot windows."""

    @frugal
    def run(batches):
        for d, _, _, win, rows, local in _chunk_windows(batches, window):
            pick = np.flatnonzero(np.isin(win, hot))
            order = pick[np.lexsort((local[pick], d[rows[pick]], win[pick]))]
            w, first = np.unique(win[order], return_index=True)
            order = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(d[rows[order]]), pa.array(local[order].astype(np.int64))], ["w", "d", "p"])

    return run


def hot_windows(rows: DataFrame, window: int) -> np.ndarray:
    """Hot windows in order, and beside them the doc_id and start of their first occurrence: an array of three rows."""
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(SAMPLE)) == 0)
    least = max(2, HOT_ROWS // SAMPLE)
    found = sample.mapInArrow(_counts(window), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("w").toArrow()
    hot = np.sort(found.column("w").to_numpy().view(np.uint64))
    if not len(hot):
        return np.zeros((3, 0), np.int64)
    first = rows.mapInArrow(_firsts(window, hot), "w long, d long, p long").groupBy("w").agg(F.min(F.struct("d", "p")).alias("m")).select("w", "m.d", "m.p").toArrow()
    out = np.stack([first.column(c).to_numpy() for c in ("w", "d", "p")])
    return out[:, np.argsort(out[0].view(np.uint64))]


def _hash_windows(n_parts: int, window: int, hot: np.ndarray):
    """Documents to packed window hashes: of a chunk and a hash range, the documents, how many windows of each, their starts and hashes. Hot windows that are not the first go by document."""

    @frugal
    def run(batches):
        for keys, span, off, win, rows, local in _chunk_windows(batches, window):
            d, h = keys, text_hashes(span, off)
            out = []
            if hot.shape[1]:
                known = hot[0].view(np.uint64)
                at = np.minimum(np.searchsorted(known, win), len(known) - 1)
                is_hot = known[at] == win
                later = is_hot & ((d[rows] != hot[1][at]) | (local != hot[2][at]))
                for p, pick in by_part(document_part(d[rows[later]], h[rows[later]], n_parts).astype(np.int64), n_parts):
                    r, start = rows[later][pick], local[later][pick]
                    out.append((p, 1, d[r].tobytes(), h[r].tobytes(), None, start.astype(np.uint32).tobytes()))
                win, rows, local = win[~is_hot], rows[~is_hot], local[~is_hot]
            for p, pick in by_part(hash_part(win, n_parts), n_parts):
                docs, first, n = np.unique(rows[pick], return_index=True, return_counts=True)
                start = local[pick] + 0
                gaps = np.diff(start, prepend=0)
                gaps[first] = start[first]
                out.append((p, 0, d[docs].tobytes(), h[docs].tobytes(), n.astype(np.uint32).tobytes() + pack_gaps(np.cumsum(gaps)), win[pick].tobytes()))
            if out:
                yield _table(out)

    return run


def _later(n_parts: int):
    """Packed window hashes of a hash range to packed occurrences that are not the first, dealt by document; rows that are such already pass."""

    @frugal
    def run(batches):
        ds, hs, ps, ws = [], [], [], []
        for b in batches:
            done = pa.compute.equal(b.column(1), 1)
            if pa.compute.any(done).as_py():
                yield b.filter(done)
            for kind, d, h, n, x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 5)), strict=True):
                if kind == 1:
                    continue
                docs = len(d) // 8
                counts = np.frombuffer(n, np.uint32, docs).astype(np.int64)
                run_of = unpack_gaps(n[4 * docs :])
                ends = np.cumsum(counts)
                base = np.repeat(np.append(0, run_of[ends[:-1] - 1]), counts)
                ds.append(np.repeat(np.frombuffer(d, np.int64), counts))
                hs.append(np.repeat(np.frombuffer(h, np.int64), counts))
                ps.append((run_of - base).astype(np.uint32))
                ws.append(np.frombuffer(x, np.uint64))
        if not ws:
            return
        w = np.concatenate(ws)
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = np.empty(len(s), bool)
        same[0] = False
        same[1:] = s[1:] == s[:-1]
        dup = same.copy()
        dup[:-1] |= same[1:]
        order, s = order[dup], s[dup]
        if not len(s):
            return
        d, h, p = np.concatenate(ds)[order], np.concatenate(hs)[order], np.concatenate(ps)[order]
        del ds, hs, ps, ws, w
        group = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1
        order = np.lexsort((p, d, group))
        d, h, p, group = d[order], h[order], p[order], group[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        first_d, first_p = d[head][group], p[head][group]
        later = (d != first_d) | (p != first_p)
        d, h, p = d[later], h[later], p[later]
        out = []
        for part, pick in by_part(document_part(d, h, n_parts), n_parts):
            pick = pick[np.lexsort((p[pick], h[pick], d[pick]))]
            out.append((part, 1, d[pick].tobytes(), h[pick].tobytes(), None, p[pick].astype(np.uint32).tobytes()))
            if len(out) == 256:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return run


def _pack_documents(n_parts: int):
    """Documents as packed rows: keys, sizes and the compressed bytes of those of a chunk with the same part."""

    @frugal
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in parts(at, CHUNK):
                span, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                d, h = _keys(b, i, j), text_hashes(span, off)
                sizes, out = np.diff(off), []
                nulls = np.array(b.column(0).slice(i, j - i).is_null())
                for p, pick in by_part(document_part(d, h, n_parts).astype(np.int64), n_parts):
                    text = b"".join(span[off[k] : off[k + 1]].tobytes() for k in pick)
                    out.append((p, 2, d[pick].tobytes(), h[pick].tobytes(), sizes[pick].astype(np.int64).tobytes() + nulls[pick].tobytes(), squeeze.compress(text)))
                yield _table(out)

    return run


def _documents(rows: list[tuple]):
    """Unpacks documents: (key, text hash, is null, bytes) one by one."""
    grow = zstandard.ZstdDecompressor()
    for d, h, n, x in rows:
        d, h = np.frombuffer(d, np.int64), np.frombuffer(h, np.int64)
        sizes, nulls = np.frombuffer(n, np.int64, len(d)), np.frombuffer(n, bool, -1, 8 * len(d))
        text, at = grow.decompress(x), 0
        for k in range(len(d)):
            yield int(d[k]), int(h[k]), bool(nulls[k]), text[at : at + sizes[k]]
            at += int(sizes[k])


def cover(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [begin, end) that windows of a length at sorted starts cover; windows that touch merge."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z
    split = np.flatnonzero(np.diff(starts) > length)
    begin = starts[np.append(0, split + 1)]
    return begin, starts[np.append(split, len(starts) - 1)] + length


class Marks:
    """Repeated windows by document, from packed rows."""

    def __init__(self, rows: list[tuple]):
        if rows:
            d, h, p = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((0, np.int64), (1, np.int64), (3, np.uint32)))
            order = np.lexsort((p, h, d))
            self.d, self.h, self.p = d[order], h[order], p[order].astype(np.int64)
        else:
            self.d = self.h = self.p = np.zeros(0, np.int64)

    def of(self, d: int, h: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.d, d, "left"), np.searchsorted(self.d, d, "right")
        lo, hi = lo + np.searchsorted(self.h[lo:hi], h, "left"), lo + np.searchsorted(self.h[lo:hi], h, "right")
        return np.unique(self.p[lo:hi])


def _remove(window: int):
    @frugal
    def run(batches):
        marks, docs = [], []
        for b in batches:
            for kind, *row in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4, 5)), strict=True):
                (marks if kind == 1 else docs).append(row)
        marks, out = Marks(marks), []
        for d, h, null, text in _documents(docs):
            data = np.frombuffer(text, np.uint8)
            _, start, end, _ = words(data, np.array([0, len(data)]))
            begin, stop = cover(marks.of(d, h), window)
            depth = np.zeros(len(start) + 1, np.int64)
            depth[begin] += 1
            depth[stop] -= 1
            keep = np.cumsum(depth)[:-1] == 0
            kept = b" ".join(text[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True))
            out.append((None if null else d, len(start), len(start) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), begin.tolist(), stop.tolist(), kept))
            if len(out) == 500:
                yield _result(out)
                out = []
        if out:
            yield _result(out)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "begins", "ends", "kept"]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    columns[-1] = columns[-1].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names)


def repeated_substrings(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept and the word intervals [begins, ends) removed from each document.

    A word goes if a window of `window` words over it also starts at a smaller doc_id, or
    earlier in the same document; a null doc_id is the smallest. Repeated rows, of equal
    doc_id, start level, so none is earlier; rows of equal doc_id and different texts
    are ordered by the start alone. A null or empty text has no words. Equality of
    windows is equality of their 64-bit hashes. Other columns are not read.
    """
    lean_batches(docs.sparkSession)
    n = tasks(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    hashed = deal(rows.mapInArrow(_hash_windows(n, window, hot_windows(rows, window)), _PACKED), n)
    later = hashed.mapInArrow(_later(n), _PACKED)
    both = deal(rows.mapInArrow(_pack_documents(n), _PACKED).unionByName(later), n)
    return both.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, begins array<long>, ends array<long>, kept string")


def op1(spark, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
