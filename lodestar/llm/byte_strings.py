"""Suffix-array dedup of byte strings.

Every string of LENGTH bytes has an anchor, the leftmost smallest fingerprint of its
SEED-byte pieces, so equal strings have equal anchors at equal places.
1. Anchors are counted. A string whose anchor occurs once occurs once.
2. The stretches of text whose strings have a repeated anchor go to the shard of the
   anchor; stretches of equal bytes are one from there on, with all their places.
3. A shard trims its stretches to the strings whose fingerprint occurs again there, so
   that the surroundings of a passage that many documents share fall away and its copies
   become one. It sorts the suffixes of what is left by induced sorting, and the permuted
   common prefixes show which strings occur elsewhere.
4. The documents meet their repeated strings, which merge into removed runs.
A string starts in exactly one stretch, so stretches never match themselves.

A piece of SEED bytes that a sample shows to be very frequent is an anchor only of strings that
have no other piece, so the many surroundings of a passage in a third of all documents do not
crowd one task. Strings of such pieces alone that the sample holds twice are known to be
repeated and are not dealt at all: their fingerprints find them, their bytes decide.
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
from ._text import _BYTE_BASE, _CODES, among, mix, parts, powers, prefix, utf8
from .substrings import _PACKED, _documents, _keys, _pack_documents, _table, by_part, document_part, hash_part, text_hashes
from .suffix import repeated

LENGTH = 400
#: Bytes of an anchor's fingerprint.
SEED = 32
#: Bytes of documents whose anchors are sought at once; below 2**POSITION.
CHUNK, POSITION = 1 << 19, 20
#: Bytes of stretches sorted at once; the stretches of one anchor stay together.
SORTED = 4 << 20
#: Occurrences, as estimated from one document in SAMPLE, from which an anchor is avoided.
HOT_ROWS, SAMPLE = 1 << 18, 64
_NONE = np.zeros(0, np.uint64)


class Known:
    """Strings that are repeated for certain: sorted fingerprints, and where the bytes of each stand in a book."""

    def __init__(self, runs: list[bytes], length: int, prints: np.ndarray | None = None):
        """All strings of `length` bytes in runs, or those of the given fingerprints."""
        self.length, self.book = length, np.frombuffer(b"".join(runs), np.uint8)
        sums = prefix(_CODES[self.book] * powers(_BYTE_BASE, len(self.book)))
        ends = np.cumsum([len(r) for r in runs])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(e - len(r), e - length + 1) for r, e in zip(runs, ends.tolist(), strict=True))])
        found = mix((sums[at + length] - sums[at]) * powers(pow(_BYTE_BASE, -1, 1 << 64), len(sums))[at])
        if prints is not None:
            at, found = at[among(prints, found)], found[among(prints, found)]
        self.prints, first = np.unique(found, return_index=True)
        self.at = at[first]

    def __len__(self) -> int:
        return len(self.prints)

    def holds(self, data: np.ndarray, starts: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Whether the string at each of the starts, which rise, is known, byte by byte; a stretch of neighbours in both is compared at once."""
        out = np.zeros(len(starts), bool)
        some = np.flatnonzero(among(self.prints, prints))
        if not len(some):
            return out
        here, there = starts[some], self.at[np.searchsorted(self.prints, prints[some])]
        edges = np.flatnonzero(np.append(True, (np.diff(here) != 1) | (np.diff(there) != 1)))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(some)], strict=True):
            n = e - s + self.length - 1
            same = data[here[s] : here[s] + n] == self.book[there[s] : there[s] + n]
            if same.all():
                out[some[s:e]] = True
            else:
                wrong = np.append(0, np.cumsum(~same))
                out[some[s:e]] = wrong[self.length :] == wrong[: e - s]
        return out


_NOTHING = Known([], 1)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, ~np.uint64(0))
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class _Pieces:
    """Texts in overlapping pieces of CHUNK starts: of each the fingerprints of its seeds, and every start's row, anchor and string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int, hot: np.ndarray):
        self.data, self.offsets, self.length, self.seed, self.hot = data, offsets, length, seed, hot
        self.inverse = pow(_BYTE_BASE, -1, 1 << 64)

    def __iter__(self):
        for base in range(0, len(self.data) - self.length + 1, CHUNK):
            piece = self.data[base : base + CHUNK + self.length - 1]
            self.sums = prefix(_CODES[piece] * powers(_BYTE_BASE, len(piece)))
            self.h = self._prints(np.arange(len(piece) - self.seed + 1), self.seed)
            # Hot seeds come after all others, by the top bit.
            order = self.h >> np.uint64(1) | among(self.hot, self.h).astype(np.uint64) << np.uint64(63)
            key = (order >> np.uint64(POSITION) << np.uint64(POSITION)) | np.arange(len(self.h), dtype=np.uint64)
            self.low = _window_min(key, self.length - self.seed + 1)
            self.at = np.arange(base, base + len(self.low))
            self.row = np.searchsorted(self.offsets, self.at, "right") - 1
            self.inside = self.at + self.length <= self.offsets[self.row + 1]
            yield self

    def _prints(self, starts: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[starts + n] - self.sums[starts]) * powers(self.inverse, len(self.sums))[starts])

    def anchors(self, starts: np.ndarray) -> np.ndarray:
        return self.h[(self.low[starts] & np.uint64((1 << POSITION) - 1)).astype(np.int64)]

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first, last) of the runs of neighbours among starts of this piece, as places in the texts."""
        first = np.flatnonzero(np.append(True, (np.diff(starts) > 1) | (np.diff(self.row[starts]) > 0)))
        last = np.append(first[1:], len(starts)) - 1
        return self.row[starts[first]], self.at[starts[first]], self.at[starts[last]]

    def all_hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of strings of hot seeds alone, and the strings' fingerprints."""
        starts = np.flatnonzero((self.low >> np.uint64(63) == 1) & self.inside)
        return starts, self._prints(starts, self.length)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED, hot: np.ndarray = _NONE, known: Known = _NOTHING):
    """(row, first start, last start, anchor) of the maximal runs of starts that have one anchor at one place; and (row, first, last) of those of known strings.

    Starts are counted in the row. Long rows are taken in overlapping pieces; a piece
    border only splits a run when its anchors are equal on both sides, which is as good.
    """
    z = np.zeros(0, np.int64)
    rows, begins, ends, anchors, done = [z], [z], [z], [_NONE], [np.zeros((3, 0), np.int64)]
    for p in _Pieces(data, offsets, length, seed, hot):
        use = p.inside.copy()
        if len(known):
            starts, prints = p.all_hot()
            starts = starts[known.holds(data, p.at[starts], prints)]
            use[starts] = False
            if len(starts):
                row, begin, end = p.runs(starts)
                done.append(np.stack([row, begin - offsets[row], end - offsets[row]]))
        fresh = np.ones(len(p.low), bool)
        fresh[1:] = (p.low[1:] != p.low[:-1]) | (p.row[1:] != p.row[:-1]) | ~use[:-1]
        first = np.flatnonzero(fresh & use)
        marks = np.flatnonzero(fresh | ~use)
        last = (np.append(marks[1:], len(p.low)) - 1)[np.searchsorted(marks, first)]
        rows.append(p.row[first])
        begins.append(p.at[first] - offsets[p.row[first]])
        ends.append(p.at[last] - offsets[p.row[first]])
        anchors.append(p.anchors(first))
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(ends), np.concatenate(anchors), np.concatenate(done, 1)


def _counted(count):
    """Texts to what count(data, offsets) finds in each chunk, with how often."""

    @frugal
    def run(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in parts(at, 4 * CHUNK):
                x, n = np.unique(count(data[at[i] : at[j]], at[i : j + 1] - at[i]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["x", "n"])

    return run


def hot_seeds(rows: DataFrame, length: int, seed: int = SEED) -> tuple[np.ndarray, Known]:
    """Very frequent seeds, and the strings of such seeds alone that occur again for certain, from a sample of the documents.

    A string is known if the sample holds its bytes twice. The driver gets the different
    runs of such strings that the sampled documents have.
    """
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(SAMPLE)) == 0)
    least = max(2, HOT_ROWS // SAMPLE)

    def frequent(count, n: int) -> np.ndarray:
        found = sample.mapInArrow(_counted(count), "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter(F.col("n") >= n).select("x").toArrow()
        return np.sort(found.column("x").to_numpy().view(np.uint64))

    anchors = frequent(lambda data, at: stretches(data, at, length, seed)[3], least)
    if not len(anchors):
        return _NONE, _NOTHING

    def around(data, at):
        out = [_NONE]
        for p in _Pieces(data, at, length, seed, _NONE):
            starts = np.flatnonzero(p.inside)
            starts = starts[among(anchors, p.anchors(starts))]
            depth = np.zeros(len(p.h) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + length - seed + 1, -1)
            out.append(p.h[np.cumsum(depth)[:-1] > 0])
        return np.concatenate(out)

    hot = frequent(around, least)
    twice = frequent(lambda data, at: np.concatenate([_NONE, *(p.all_hot()[1] for p in _Pieces(data, at, length, seed, hot))]), 2)
    if not len(twice):
        return hot, _NOTHING

    def passages(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in parts(at, 4 * CHUNK):
                span, found = data[at[i] : at[j]], set()
                for p in _Pieces(span, at[i : j + 1] - at[i], length, seed, hot):
                    starts, prints = p.all_hot()
                    starts = starts[among(twice, prints)]
                    if len(starts):
                        found |= {span[x : y + length].tobytes() for _, x, y in zip(*p.runs(starts), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["x"])

    runs = sample.mapInArrow(passages, "x binary").distinct().toArrow().column("x").to_pylist()
    book = Known(sorted(runs, key=lambda r: (-len(r), r)), length, twice)

    def verified(data, at):
        out = [_NONE]
        for p in _Pieces(data, at, length, seed, hot):
            starts, prints = p.all_hot()
            out.append(prints[book.holds(data, p.at[starts], prints)])
        return np.concatenate(out)

    return hot, Known(sorted(runs, key=lambda r: (-len(r), r)), length, frequent(verified, 2))


def anchor_part(anchors: np.ndarray, n_parts: int) -> np.ndarray:
    """Task of an anchor; anchors are minima, hence small numbers, and are mixed first."""
    return hash_part(mix(anchors), n_parts)


def runs(flags: np.ndarray):
    """(begin, end) of every run of true flags."""
    edge = (np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist()
    edge = ([0] if flags[0] else []) + edge + ([len(flags)] if flags[-1] else [])
    return zip(edge[::2], edge[1::2], strict=True)


def _anchors(n_parts: int, length: int, hot: np.ndarray, known: Known):
    """Documents to their stretches by anchor, and the runs of known strings by document."""

    @frugal
    def run(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in parts(at, 4 * CHUNK):
                span, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                row, begin, end, anchor, done = stretches(span, off, length, SEED, hot, known)
                if not len(row) and not done.shape[1]:
                    continue
                d, h = _keys(b, i, j), text_hashes(span, off)
                out = []
                for p, pick in by_part(document_part(d[done[0]], h[done[0]], n_parts).astype(np.int64), n_parts):
                    r = done[0][pick]
                    out.append((p, KNOWN, d[r].tobytes(), h[r].tobytes(), done[1:, pick].astype(np.uint32).tobytes(), np.zeros(len(r), np.uint64).tobytes()))
                for p, pick in by_part(anchor_part(anchor, n_parts), n_parts):
                    where = np.stack([begin[pick], end[pick]]).astype(np.uint32)
                    out.append((p, 0, d[row[pick]].tobytes(), h[row[pick]].tobytes(), where.tobytes(), anchor[pick].tobytes()))
                yield _table(out)

    return run


#: Kind of the packed rows of known strings, which pass all steps to the last.
KNOWN = 3


def _passing(batches, out: list):
    """Appends (kind, row) of the packed rows to out, but for those that pass, which are yielded."""
    for b in batches:
        known = pa.compute.equal(b.column(1), KNOWN)
        if pa.compute.any(known).as_py():
            yield b.filter(known)
        out += [(kind, row) for kind, *row in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True) if kind != KNOWN]


def _repeated_anchors(n_parts: int):
    """Anchors of a range to the stretches of those that occur more than once, dealt by document."""

    @frugal
    def run(batches):
        read: list = []
        yield from _passing(batches, read)
        rows = [r for _, r in read]
        if not rows:
            return
        d, h, anchor = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((0, np.int64), (1, np.int64), (3, np.uint64)))
        where = np.concatenate([np.frombuffer(r[2], np.uint32).reshape(2, -1) for r in rows], 1)
        order = np.argsort(anchor, kind="stable")
        s = anchor[order]
        dup = np.zeros(len(s), bool)
        dup[1:] = s[1:] == s[:-1]
        dup[:-1] |= dup[1:]
        pick = order[dup]
        d, h, anchor, where = d[pick], h[pick], anchor[pick], where[:, pick]
        out = [(p, 1, d[k].tobytes(), h[k].tobytes(), where[:, k].tobytes(), anchor[k].tobytes()) for p, k in by_part(document_part(d, h, n_parts).astype(np.int64), n_parts)]
        if out:
            yield _table(out)

    return run


class _Places:
    """Ranges by document, from packed rows."""

    def __init__(self, rows: list):
        z = np.zeros(0, np.int64)
        self.d, self.h, self.a = (np.concatenate([z.astype(t), *(np.frombuffer(r[k], t) for r in rows)]) for k, t in ((0, np.int64), (1, np.int64), (3, np.uint64)))
        self.w = np.concatenate([np.frombuffer(r[2], np.uint32).reshape(2, -1) for r in rows], 1).astype(np.int64) if rows else np.zeros((2, 0), np.int64)
        order = np.lexsort((self.w[0], self.h, self.d))
        self.d, self.h, self.a, self.w = self.d[order], self.h[order], self.a[order], self.w[:, order]

    def of(self, d: int, h: int) -> slice:
        lo, hi = np.searchsorted(self.d, d, "left"), np.searchsorted(self.d, d, "right")
        return slice(int(lo + np.searchsorted(self.h[lo:hi], h, "left")), int(lo + np.searchsorted(self.h[lo:hi], h, "right")))


def _cut(n_parts: int, length: int):
    """Documents and their repeated anchors to stretches of bytes, dealt by anchor."""

    @frugal
    def run(batches):
        rows: list = []
        yield from _passing(batches, rows)
        places = _Places([r for k, r in rows if k == 1])
        squeeze = zstandard.ZstdCompressor(level=3)
        held: dict[int, list] = {}
        size, seen = 0, set()

        def flush():
            out = []
            for p, items in held.items():
                ds, hs, bs, es, an, texts = zip(*items, strict=True)
                head = np.stack([np.array(bs), np.array(es)]).astype(np.uint32)
                out.append((p, 0, np.array(ds, np.int64).tobytes(), np.array(hs, np.int64).tobytes(), head.tobytes() + np.array(an, np.uint64).tobytes(), squeeze.compress(b"".join(texts))))
            held.clear()
            return _table(out)

        for d, h, _, text in _documents([r for k, r in rows if k == 2]):
            if (d, h) in seen:  # repeated rows: the places already hold each of them
                continue
            mine = places.of(d, h)
            if mine.stop > mine.start:
                seen.add((d, h))
            part = anchor_part(places.a[mine], n_parts)
            for k in range(mine.start, mine.stop):
                b, e = int(places.w[0, k]), int(places.w[1, k])
                held.setdefault(int(part[k - mine.start]), []).append((d, h, b, e, places.a[k], text[b : e + length]))
                size += e + length - b
            if size > 8 * SORTED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _again(contents: list[bytes], times: np.ndarray, length: int) -> np.ndarray:
    """Of every start in turn, whether the fingerprint of its string occurs at another start or its stretch at another place."""
    prints, inverse, i = [], pow(_BYTE_BASE, -1, 1 << 64), 0
    while i < len(contents):
        j, size = i, 0
        while j < len(contents) and (j == i or size < SORTED // 4):
            size, j = size + len(contents[j]), j + 1
        data = np.frombuffer(b"".join(contents[i:j]), np.uint8)
        sums = prefix(_CODES[data] * powers(_BYTE_BASE, len(data)))
        h = mix((sums[length:] - sums[:-length]) * powers(inverse, len(data) - length + 1))
        sizes = np.array([len(c) for c in contents[i:j]])
        have = sizes - length + 1
        first = np.repeat(np.cumsum(sizes) - sizes, have) + np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        prints.append(h[first])
        i = j
    h = np.concatenate(prints)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out | np.repeat(times > 1, [len(c) - length + 1 for c in contents])


def _match(n_parts: int, length: int):
    """Stretches of an anchor range to the repeated starts among them, dealt by document."""

    @frugal
    def run(batches):
        grow = zstandard.ZstdDecompressor()
        anchors: dict[int, dict[bytes, list]] = {}
        read: list = []
        yield from _passing(batches, read)
        for _, (d, h, head, x) in read:
            d, h = np.frombuffer(d, np.int64).tolist(), np.frombuffer(h, np.int64).tolist()
            n = len(d)
            begin, end = np.frombuffer(head, np.uint32, 2 * n).reshape(2, -1).tolist()
            anchor = np.frombuffer(head, np.uint64, -1, 8 * n).tolist()
            text, at = grow.decompress(x), 0
            for k in range(n):
                size = end[k] + length - begin[k]
                anchors.setdefault(anchor[k], {}).setdefault(text[at : at + size], []).append((d[k], h[k], begin[k]))
                at += size
        ds, hs, bs, es = [], [], [], []

        def found(spots: list, b: int, e: int) -> None:
            for d, h, begin in spots:
                ds.append(d)
                hs.append(h)
                bs.append(begin + b)
                es.append(begin + e)

        def sort(groups: list) -> None:
            """groups: for each anchor its different stretches with their places."""
            stretch = [c for g in groups for c in g]
            again = _again([c for c, _ in stretch], np.array([len(p) for _, p in stretch]), length)
            at, rest = 0, []
            for g in groups:
                pieces: dict[bytes, list] = {}
                for content, spots in g:
                    n = len(content) - length + 1
                    for b, e in runs(again[at : at + n]):
                        pieces.setdefault(content[b : e - 1 + length], []).extend((d, h, begin + b) for d, h, begin in spots)
                    at += n
                if not pieces:
                    continue
                if len(pieces) == 1:
                    # One piece throughout: each of its strings occurs at each of its places.
                    content, spots = next(iter(pieces.items()))
                    if len(spots) > 1:
                        found(spots, 0, len(content) - length)
                else:
                    rest += pieces.items()
            if not rest:
                return
            yes, at = repeated(np.frombuffer(b"\xff".join(c for c, _ in rest), np.uint8), length), 0
            for content, spots in rest:
                n = len(content) - length + 1
                hit = np.ones(n, bool) if len(spots) > 1 else yes[at : at + n]
                for b, e in runs(hit):
                    found(spots, b, e - 1)
                at += len(content) + 1

        batch, size = [], 0
        for contents in anchors.values():
            if len(contents) == 1:
                content, spots = next(iter(contents.items()))
                if len(spots) > 1:
                    found(spots, 0, len(content) - length)
                continue
            batch.append(list(contents.items()))
            size += sum(map(len, contents))
            if size > SORTED:
                sort(batch)
                batch, size = [], 0
        if batch:
            sort(batch)
        if ds:
            d, h = np.array(ds, np.int64), np.array(hs, np.int64)
            where = np.stack([np.array(bs), np.array(es)]).astype(np.uint32)
            yield _table([(p, 1, d[k].tobytes(), h[k].tobytes(), where[:, k].tobytes(), np.zeros(len(k), np.uint64).tobytes()) for p, k in by_part(document_part(d, h, n_parts).astype(np.int64), n_parts)])

    return run


def _remove(length: int):
    @frugal
    def run(batches):
        rows = [(kind, row) for b in batches for kind, *row in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True)]
        places, out = _Places([r for k, r in rows if k in (1, KNOWN)]), []
        for d, h, null, text in _documents([r for k, r in rows if k == 2]):
            w = places.w[:, places.of(d, h)]
            spans: list[list[int]] = []
            for b, e in sorted(zip(w[0].tolist(), (w[1] + length).tolist(), strict=True)):
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([b, e])
            kept, at = [], 0
            for b, e in spans:
                kept.append(text[at:b])
                at = e
            kept = b"".join([*kept, text[at:]])
            out.append((None if null else d, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [s[0] for s in spans], [s[1] for s in spans], kept))
            if len(out) == 500:
                yield _result(out)
                out = []
        if out:
            yield _result(out)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and the byte intervals [begins, ends) removed from each document.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in
    another row or in the same. Repeated rows are occurrences each, so they remove one
    another's strings; a null doc_id is no hindrance. Null texts are empty; texts shorter
    than length lose nothing. Other columns are not read.
    """
    lean_batches(docs.sparkSession)
    n = tasks(docs.sparkSession)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    documents = rows.mapInArrow(_pack_documents(n), _PACKED)
    hot, known = hot_seeds(rows, length)
    places = deal(rows.mapInArrow(_anchors(n, length, hot, known), _PACKED), n).mapInArrow(_repeated_anchors(n), _PACKED)
    cut = deal(documents.unionByName(places), n).mapInArrow(_cut(n, length), _PACKED)
    starts = deal(cut, n).mapInArrow(_match(n, length), _PACKED)
    return deal(documents.unionByName(starts), n).mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>, kept binary")


def op9(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
