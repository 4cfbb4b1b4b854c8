"""N-gram Jaccard join with PartEnum signatures.

1. Screen: the smallest shingle hashes of every set (a prefix long enough that linked
   sets share a known number of them) are counted; sets without enough shared ones
   cannot link and go no further. Of those left, all shingles are counted, and sets of
   which too few are held by others of fitting size are done as well.
2. PartEnum: sets of an equal size band within which the similarity bounds the
   symmetric difference partition the shingle domain twice; every choice of all but one
   second-level part gives a signature, and linked sets agree on a non-empty one. Sets
   for which that cannot be guaranteed also join on prefix shingles among themselves.
3. Pairs of small signature groups are compared exactly, those most likely to link
   first; pairs already connected need no comparison. A large group meets at its hub,
   the member that shares most. Members that are not connected by then differ from the
   hub by known shingles. Their numbers say how many of these two members must share to
   link; those with too few shared ones are done, the others meet on their rarest, and
   just such pairs are compared.
Sets with equal shingles are one throughout. Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import deal, discard, frugal, lean_batches, settle, small_side, tasks
from ._text import among, mix, parts, utf8, windows, words
from .graph import components
from .substrings import _PACKED, _keys, _table, by_part, hash_part

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
CHUNK = 1 << 20
#: Second-level parts, of which one may differ.
SUBPARTS = 3
#: Members of a signature group up to which its pairs are listed; larger groups meet through a hub.
SMALL = 8
#: Hubs of a turn up to which what is known of each is broadcast.
HUBS = 1 << 16
#: Sets, or pairs of them, unpacked at once.
SLICE = 128
#: Packed exchanges have as many tasks as this, or this part of the shuffle partitions if those are more: what a set takes beside its hashes is sent once for each task, so tasks that grow with the data would make the bytes of each hash grow, too.
PARTS, PARTS_SHARE = 64, 8
#: Hashes or signatures of a task that are sorted at once.
RANGE = 1 << 20
#: Sets, as estimated from one document in SAMPLE, from which a shingle that they hold is taken as held by others and not dealt; this only lets more sets pass the screens.
HOT_SETS, SAMPLE = 1 << 18, 64
#: Sizes of sets in the screens: whole steps of a logarithm to this base, and how far apart those of sets that link can be.
SIZE_BASE = 1.01
SIZE_STEPS = int(np.log(100 / PERCENT) / np.log(SIZE_BASE)) + 1


def packed_parts(tasks: int) -> int:
    """Parts of the packed exchanges for so many shuffle partitions."""
    return min(tasks, max(PARTS, tasks // PARTS_SHARE))


def sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """Distinct shingle hashes of each row, sorted by row and hash, and their row offsets."""
    hashes, _, _, word_at = words(data, offsets, lower=True)
    win, _, rows = windows(hashes, word_at, k, whole=True)
    order = np.lexsort((win, rows))
    win, rows = win[order], rows[order]
    fresh = np.ones(len(win), bool)
    fresh[1:] = (win[1:] != win[:-1]) | (rows[1:] != rows[:-1])
    win, rows = win[fresh], rows[fresh]
    return win, np.searchsorted(rows, np.arange(len(offsets)))


def prints(win: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    raw = [hashlib.blake2b(win[at[i] : at[i + 1]], digest_size=16).digest() for i in range(len(at) - 1)]
    both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n that every linked set must hold."""
    return -(-n * PERCENT // 100)


def shared_in_prefix(n: np.ndarray) -> np.ndarray:
    """By how many a prefix exceeds the shortest one; linked sets of at least this size share so many in their prefixes."""
    return np.maximum(1, n // 5)


def size_code(n: np.ndarray) -> np.ndarray:
    return (np.log(np.maximum(n, 1)) / np.log(SIZE_BASE)).astype(np.uint16)


def screen_rows(out: list, part: int, sets_of: np.ndarray, codes: np.ndarray, owner: np.ndarray, h: np.ndarray) -> None:
    """Adds the hashes of one range as packed rows: sets, how many hashes of each and their size codes, and 32 bits of every hash.

    Sets may meet by chance on 32 bits, so the screens keep no fewer of them than they should.
    """
    docs, count = np.unique(owner, return_counts=True)
    for i in range(0, int(count.max()), 65535):  # more of a set's in one range are told apart
        have = np.clip(count - i, 0, 65535)
        pick = have > 0
        first = np.cumsum(count) - count + i
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first[pick], have[pick], strict=True)]) if i or count.max() > 65535 else slice(None)
        out.append((part, 0, sets_of[docs[pick]].tobytes(), None, np.concatenate([have[pick].astype(np.uint16), codes[docs[pick]]]).tobytes(), h[rows].astype(np.uint32).tobytes()))


def _packed(batches, *columns: int) -> list[tuple]:
    return [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]


def _ranges(packed: list[tuple], kind: type) -> range:
    """Numbers of the ranges in which the hashes in the last column are sorted, about RANGE at once."""
    return range(-(-sum(len(row[-1]) for row in packed) // (np.dtype(kind).itemsize * RANGE)))


def _of_range(x: bytes, kind: type, r: int, ranges: range) -> tuple[np.ndarray, np.ndarray | slice]:
    """The hashes of one range, and which of all they are."""
    x = np.frombuffer(x, kind)
    pick = np.flatnonzero(x % kind(len(ranges)) == r) if len(ranges) > 1 else slice(None)
    return x[pick], pick


def screen_ranges(batches):
    """(set, size code, hash) from packed rows, by range of the hash."""
    packed = _packed(batches, 2, 4, 5)
    ranges = _ranges(packed, np.uint32)
    for r in ranges:
        ds, hs, ns = [], [], []
        for d, n, x in packed:
            count, code = np.frombuffer(n, np.uint16).reshape(2, -1)
            h, pick = _of_range(x, np.uint32, r, ranges)
            ds.append(np.repeat(np.frombuffer(d, np.int64), count)[pick])
            ns.append(np.repeat(code, count)[pick])
            hs.append(h)
        if any(map(len, hs)):
            yield np.concatenate(ds), np.concatenate(ns), np.concatenate(hs)


def read_screen(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(set, size code, hash) from packed rows, all of them."""
    rows = list(screen_ranges(batches))
    return tuple(map(np.concatenate, zip(*rows, strict=True))) if rows else None


def _distinct(f1, f2, d):
    """Rows of distinct fingerprints, each that of the smallest key."""
    order = np.lexsort((d, f2, f1))
    a, b = f1[order], f2[order]
    return np.sort(order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if len(order) else order


def _chunks(batches, k: int):
    """Documents with a key and a shingle, by chunk: keys, offsets and bytes, sets, fingerprints."""
    for b in batches:
        data, at = utf8(b.column(1))
        for i, j in parts(at, CHUNK):
            span, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
            win, set_at = sets(span, off, k)
            f1, f2 = prints(win, set_at)
            yield _keys(b, i, j), np.array(b.column(0).slice(i, j - i).is_null()), span, off, win, set_at, f1, f2


def _prefix_hashes(batches, k: int):
    """The prefixes of the distinct sets of each chunk: sets, sizes, and of every hash its set and itself."""
    for d, null, _, _, win, at, f1, f2 in _chunks(batches, k):
        n = np.diff(at)
        rows = _distinct(f1, f2, d)
        rows = rows[(n[rows] >= 3) & ~null[rows]]
        size = n[rows]
        take = size - least_overlap(size) + shared_in_prefix(size)
        owner = np.repeat(np.arange(len(rows)), take)
        if len(owner):
            first = np.repeat(np.cumsum(take) - take, take)
            yield f1[rows], size, owner, mix(win[np.arange(len(owner)) - first + np.repeat(at[rows], take)])


def hot_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """Hashes, in order, of the shingles that very many sets hold in their prefixes, by a sample of the documents."""

    @frugal
    def run(batches):
        for _, _, _, h in _prefix_hashes(batches, k):
            x, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["x", "n"])

    sample = rows.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(SAMPLE)) == 0)
    found = sample.mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, HOT_SETS // SAMPLE)).select("x").toArrow()
    return np.sort(found.column("x").to_numpy().view(np.uint64))


def _held_rows(sets_of: np.ndarray, count: np.ndarray, n_parts: int) -> list[tuple]:
    """Packed rows of how many hashes of each set are held by another, by set."""
    return [(p, 1, sets_of[pick].tobytes(), None, count[pick].astype(np.uint32).tobytes(), None) for p, pick in by_part(set_part(sets_of, n_parts), n_parts)]


def _without_hot(out: list, hot: np.ndarray, n_parts: int, sets_of: np.ndarray, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner and h without hot hashes, which count as held."""
    is_hot = among(hot, h)
    if is_hot.any():
        count = np.bincount(owner[is_hot], minlength=len(sets_of))
        have = np.flatnonzero(count)
        out += _held_rows(sets_of[have], count[have], n_parts)
    return owner[~is_hot], h[~is_hot]


def _prefixes(n_parts: int, k: int, hot: np.ndarray):
    @frugal
    def run(batches):
        for sets_of, size, owner, h in _prefix_hashes(batches, k):
            out, codes = [], size_code(size)
            owner, h = _without_hot(out, hot, n_parts, sets_of, owner, h)
            for p, pick in by_part(hash_part(h, n_parts), n_parts):
                screen_rows(out, p, sets_of, codes, owner[pick], h[pick])
            if out:
                yield _table(out)

    return run


def held_by_another(sets_of: np.ndarray, code: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets and how many of their hashes another set, of a size with which it could link, has too."""
    # Copies of a set come from many chunks: each set counts once.
    order = np.lexsort((sets_of, code, h))
    d, n, h = sets_of[order], code[order].astype(np.int32), h[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
    d, n, h = d[fresh], n[fresh], h[fresh]
    near = (h[1:] == h[:-1]) & (n[1:] - n[:-1] <= SIZE_STEPS)
    dup = np.zeros(len(h), bool)
    dup[1:] = near
    dup[:-1] |= near
    return np.unique(d[dup], return_counts=True)


def set_part(sets_of: np.ndarray, n_parts: int) -> np.ndarray:
    return (mix(sets_of.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)


def _shared(n_parts: int):
    """Hashes of a range to how many of each set's are held by another set as well, by set; rows that tell it already pass."""

    @frugal
    def run(batches):
        dealt = []
        for b in batches:
            done = pa.compute.equal(b.column(1), 1)
            if pa.compute.any(done).as_py():
                yield b.filter(done)
                b = b.filter(pa.compute.invert(done))
            dealt.append(b)
        found = [held_by_another(*rows) for rows in screen_ranges(dealt)]
        if found:
            sets_of, back = np.unique(np.concatenate([d for d, _ in found]), return_inverse=True)
            out = _held_rows(sets_of, np.bincount(back, np.concatenate([c for _, c in found]), len(sets_of)), n_parts)
            if out:
                yield _table(out)

    return run


def _texts(n_parts: int, k: int):
    @frugal
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for d, null, span, off, _, at, f1, f2 in _chunks(batches, k):
            n = np.diff(at)
            rows = _distinct(f1, f2, d)
            rows = rows[(n[rows] >= 3) & ~null[rows]]
            out, size = [], np.diff(off)
            for p, pick in by_part(set_part(f1[rows], n_parts), n_parts):
                r = rows[pick]
                head = np.concatenate([d[r], n[r].astype(np.int64), size[r].astype(np.int64)])
                out.append((p, 2, f1[r].tobytes(), f2[r].tobytes(), head.tobytes(), squeeze.compress(b"".join(span[off[i] : off[i + 1]].tobytes() for i in r))))
            if out:
                yield _table(out)

    return run


def _survivors():
    """Sets with enough shared prefix shingles: (id, n, text), once each, id being the smallest key."""

    @frugal
    def run(batches):
        counts, docs = [], []
        for b in batches:
            for kind, *row in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True):
                (counts if kind == 1 else docs).append(row)
        f = np.concatenate([np.frombuffer(r[0], np.int64) for r in counts]) if counts else np.zeros(0, np.int64)
        c = np.concatenate([np.frombuffer(r[2], np.uint32) for r in counts]) if counts else np.zeros(0, np.uint32)
        f, back = np.unique(f, return_inverse=True)
        c = np.bincount(back, c, len(f)) if len(f) else np.zeros(0)
        squeeze, grow = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        keep: dict[tuple[int, int], tuple] = {}
        for r, (d, h, head, x) in enumerate(docs):
            d, h = np.frombuffer(d, np.int64), np.frombuffer(h, np.int64)
            ids, n, size = np.frombuffer(head, np.int64).reshape(3, -1)
            at = np.minimum(np.searchsorted(f, d), max(0, len(f) - 1))
            if not len(f):
                continue
            have = np.where(f[at] == d, c[at], 0)
            for k in np.flatnonzero(have >= shared_in_prefix(least_overlap(n))):
                key = (int(d[k]), int(h[k]))
                if key not in keep or ids[k] < keep[key][0]:
                    keep[key] = (int(ids[k]), int(n[k]), r, int(size[:k].sum()), int(size[k]))
        by_row: dict[int, list] = {}
        for v in keep.values():
            by_row.setdefault(v[2], []).append(v)
        for r, found in by_row.items():
            text = grow.decompress(docs[r][3])
            cols = [[v[0] for v in found], [v[1] for v in found], [squeeze.compress(text[v[3] : v[3] + v[4]]) for v in found]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["id", "n", "packed"])

    return run


def bands(top: int) -> np.ndarray:
    """Upper sizes of the bands: no set links across more than one border."""
    out = [2]
    while out[-1] < top:
        out.append(max(out[-1] + 1, (out[-1] + 1) * 100 // PERCENT))
    return np.array(out)


def signatures(win: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of every set: PartEnum in its own band and in the next, and prefix shingles where those may all be empty."""
    size = np.diff(at)
    upper = bands(int(size.max(initial=0)) * 2 + 4)
    own = np.searchsorted(upper, size)
    sigs, rows = [], []
    poor = np.zeros(len(size), bool)
    for step in (0, 1):
        band = own + step
        top = upper[np.minimum(band, len(upper) - 1)]
        bound = np.minimum(2 * (100 - PERCENT) * top // (100 + PERCENT), size * (100 - PERCENT) // PERCENT)
        # First-level partitions: the same number for all sets of the band.
        first = np.maximum(1, np.round(top / (SUBPARTS * 1.7)).astype(np.int64))
        live = np.flatnonzero((size > 0) & (bound > 0))
        cells_at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(np.where((size > 0) & (bound > 0), first, 0), out=cells_at[1:])
        if not len(live):
            continue
        owner = np.repeat(np.arange(len(size)), size)
        use = np.isin(owner, live)
        h, o = win[use], owner[use]
        x = mix(h ^ np.uint64(0xA0761D6478BD642F))
        f = ((x >> np.uint64(32)) * first[o].astype(np.uint64)) >> np.uint64(32)
        s = (x & np.uint64(0xFFFFFFFF)) * np.uint64(SUBPARTS) >> np.uint64(32)
        cell = (cells_at[o] + f.astype(np.int64)) * SUBPARTS + s.astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], mix(h[order] ^ np.uint64(0xE7037ED1A0B428DB))
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums, counts = np.zeros(int(cells_at[-1]) * SUBPARTS, np.uint64), np.zeros(int(cells_at[-1]) * SUBPARTS, np.int64)
        sums[cell[edge]] = np.add.reduceat(value, edge)
        counts[cell[edge]] = np.diff(np.append(edge, len(cell)))
        sums, counts = sums.reshape(-1, SUBPARTS), counts.reshape(-1, SUBPARTS)
        but_one, left = sums.sum(1, keepdims=True, dtype=np.uint64) - sums, counts.sum(1, keepdims=True) - counts
        row = np.repeat(np.arange(len(size)), np.diff(cells_at))
        part = np.arange(len(row)) - cells_at[row]
        tag = (band[row].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(4))
        sig = mix(but_one ^ mix(tag[:, None] + np.arange(SUBPARTS, dtype=np.uint64)[None, :] + np.uint64(1)))
        full = left > 0
        sigs.append(sig[full])
        rows.append(np.repeat(row, SUBPARTS)[full.ravel()])
        lacking = np.bincount(row, ~full.all(1), len(size))
        # At most bound/2 partitions differ in two shingles or more; of the others one must have no empty choice.
        poor |= (size > 0) & (bound > 0) & (lacking >= first - bound // 2)
    for r in np.flatnonzero(poor):
        n = int(size[r])
        take = n - int(least_overlap(np.array(n))) + 1
        sigs.append(mix(win[at[r] : at[r] + take] ^ np.uint64(0x8EBC6AF09C88C6E3)))
        rows.append(np.full(take, r))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows)


def _unpack(column) -> tuple[np.ndarray, np.ndarray]:
    grow = zstandard.ZstdDecompressor()
    texts = [grow.decompress(v) for v in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _sign(n_parts: int, k: int):
    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                ids = part.column(0).to_numpy()
                sig, rows = signatures(*sets(*_unpack(part.column(2)), k))
                out = []
                for p, pick in by_part(hash_part(sig, n_parts), n_parts):
                    docs, back = np.unique(rows[pick], return_inverse=True)
                    order = np.argsort(back, kind="stable")
                    count = np.bincount(back)
                    out.append((p, 0, ids[docs].tobytes(), None, count.astype(np.uint32).tobytes(), sig[pick][order].tobytes()))
                if out:
                    yield _table(out)

    return run


def _every(n_parts: int, k: int, hot: np.ndarray):
    """All shingles of the sets in a table (id, n, packed), by hash."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                ids = part.column(0).to_numpy()
                h, at = sets(*_unpack(part.column(2)), k)
                size, h = np.diff(at), mix(h)
                out, codes = [], size_code(size)
                owner, h = _without_hot(out, hot, n_parts, ids, np.repeat(np.arange(len(size)), size), h)
                for p, pick in by_part(hash_part(h, n_parts), n_parts):
                    screen_rows(out, p, ids, codes, owner[pick], h[pick])
                if out:
                    yield _table(out)

    return run


def _sums(batches):
    """Packed counts of a range of sets to (id, c)."""
    rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (2, 4)), strict=True)]
    if rows:
        i, back = np.unique(np.concatenate([np.frombuffer(d, np.int64) for d, _ in rows]), return_inverse=True)
        c = np.bincount(back, np.concatenate([np.frombuffer(n, np.uint32) for _, n in rows]), len(i))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c.astype(np.int64))], ["id", "c"])


def screened(table: DataFrame, k: int, hot: np.ndarray) -> DataFrame:
    """Sets of table (id, n, packed) of which another one could hold PERCENT of the shingles; others link with nothing."""
    n = packed_parts(tasks(table.sparkSession))
    held = deal(table.mapInArrow(_every(n, k, hot), _PACKED), n).mapInArrow(_shared(n), _PACKED)
    enough = deal(held, n).mapInArrow(_sums, "id long, c long")
    return table.join(enough, "id").filter(100 * F.col("c") >= PERCENT * F.col("n")).select("id", "n", "packed")


def _met(w: np.ndarray, i: np.ndarray, seen: set):
    """What _groups() makes of the signatures of one range and their ids; seen has the keys of large groups so far."""
    order = np.lexsort((i, w))
    w, i = w[order], i[order]
    fresh = np.append(True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]))
    w, i = w[fresh], i[fresh]
    edge = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w))
    size = np.diff(edge)
    a, b = [], []
    for g in range(2, SMALL + 1):
        start = edge[:-1][size == g]
        for p in range(g):
            for q in range(p + 1, g):
                a.append(i[start + p])
                b.append(i[start + q])
    large = []
    for g in np.flatnonzero(size > SMALL):
        members = i[edge[g] : edge[g + 1]]
        key = hashlib.blake2b(members, digest_size=8).digest()
        if key not in seen:
            seen.add(key)
            large.append((int.from_bytes(key, "little", signed=True), members))
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if len(a):
        edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        count = np.diff(np.append(edge, len(a)))
        for s in range(0, len(edge), 100000):
            e = edge[s : s + 100000]
            yield pa.RecordBatch.from_arrays([pa.array(a[e]), pa.array(b[e]), pa.array(count[s : s + 100000].astype(np.int64)), pa.nulls(len(e), pa.int64())], ["a", "b", "c", "g"])
    for key, members in large:
        yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(members), pa.array(np.zeros(len(members), np.int64)), pa.array(np.full(len(members), key))], ["a", "b", "c", "g"])


def _groups():
    """Signatures of a range to pairs (a, b, count) of ids and, for large groups, their members."""

    @frugal
    def run(batches):
        packed, seen = _packed(batches, 2, 4, 5), set()
        ranges = _ranges(packed, np.uint64)
        for r in ranges:
            ws, ids = [], []
            for d, n, x in packed:
                w, pick = _of_range(x, np.uint64, r, ranges)
                ids.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32))[pick])
                ws.append(w)
            if any(map(len, ws)):
                yield from _met(np.concatenate(ws), np.concatenate(ids), seen)

    return run


def _linked(k: int):
    """Pairs with their packed texts to those that link."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x, x_at = sets(*_unpack(part.column(2)), k)
                y, y_at = sets(*_unpack(part.column(3)), k)
                nx, ny = np.diff(x_at), np.diff(y_at)
                rows = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                h = np.concatenate([x, y])
                order = np.lexsort((h, rows))
                h, rows = h[order], rows[order]
                same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
                both = np.bincount(rows[1:][same], minlength=len(nx))
                link = 100 * both >= PERCENT * (nx + ny - both)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(link)), part.column(1).filter(pa.array(link))], ["a", "b"])

    return run


def verify(pairs: DataFrame, table: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of ids in table (id, n, packed) whose sets link; sizes are compared before texts."""
    left = table.select(F.col("id").alias("a"), F.col("packed").alias("x"))
    right = table.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    sizes = table.select("id", "n")
    near = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    near = near.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    return settle(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_linked(k), "a long, b long"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    l = labels.withColumnRenamed("component", "l")
    out = pairs.join(l.withColumnRenamed("id", "a").withColumnRenamed("l", "la"), "a", "left").join(l.withColumnRenamed("id", "b").withColumnRenamed("l", "lb"), "b", "left")
    return out.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def _differences(k: int):
    """Pairs (hub, id, x, y, c, open) with their packed texts to the shingles that only one of both has, keyed by hub, the hub's size and how many are the hub's (p) and the member's (q)."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                x, x_at = sets(*_unpack(part.column(2)), k)
                y, y_at = sets(*_unpack(part.column(3)), k)
                nx, ny = np.diff(x_at), np.diff(y_at)
                rows = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                h, mine = np.concatenate([x, y]), np.repeat([False, True], [len(x), len(y)])
                order = np.lexsort((h, rows))
                h, rows, mine = h[order], rows[order], mine[order]
                alone = np.ones(len(h), bool)
                same = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
                alone[1:] &= ~same
                alone[:-1] &= ~same
                h, rows, mine = h[alone], rows[alone], mine[alone]
                keys = mix(h ^ mix(part.column(0).to_numpy().view(np.uint64))[rows]).view(np.int64)
                q = np.bincount(rows, mine, len(nx)).astype(np.int64)
                at = np.searchsorted(rows, np.arange(len(nx) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nx.astype(np.int64)), pa.array(np.diff(at).astype(np.int64) - q), pa.array(q), part.column(4), part.column(5), lists], ["hub", "id", "r", "p", "q", "c", "open", "d"])

    return run


def _member(b: pa.RecordBatch) -> np.ndarray:
    """A number for each (hub, id) in the first two columns."""
    return mix(b.column(1).to_numpy().view(np.uint64) ^ mix(b.column(0).to_numpy().view(np.uint64)))


def _deal_keys(n_parts: int):
    """Members (hub, id, c, open, need, d) to their keys by range."""

    @frugal
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                lists, who = part.column(5), _member(part)
                keys, size = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
                owner, c, is_open = np.repeat(np.arange(len(size)), size), part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)
                out = []
                for p, pick in by_part(hash_part(keys, n_parts), n_parts):
                    docs, count = np.unique(owner[pick], return_counts=True)
                    out.append((p, 0, who[docs].tobytes(), c[docs].tobytes(), np.concatenate([count, is_open[docs]]).astype(np.uint32).tobytes(), keys[pick].tobytes()))
                if out:
                    yield _table(out)

    return run


def _useful_keys(n_parts: int):
    """Keys of a range to those that could tell of a link (an open member has it, and one of another component), with how many members have them, by member."""

    @frugal
    def run(batches):
        who, cs, opens, ks = [], [], [], []
        for b in batches:
            for d, h, n, x in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                count, is_open = np.frombuffer(n, np.uint32).reshape(2, -1)
                who.append(np.repeat(np.frombuffer(d, np.uint64), count))
                cs.append(np.repeat(np.frombuffer(h, np.int64), count))
                opens.append(np.repeat(is_open, count))
                ks.append(np.frombuffer(x, np.uint64))
        if not ks:
            return
        who, c, is_open, k = map(np.concatenate, (who, cs, opens, ks))
        order = np.lexsort((c, k))
        who, c, is_open, k = who[order], c[order], is_open[order], k[order]
        edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        df = np.diff(np.append(edge, len(k)))
        useful = (np.add.reduceat(is_open, edge) > 0) & (c[edge] != c[edge + df - 1])
        use, df = np.repeat(useful, df), np.repeat(df, df)
        who, k, df = who[use], k[use], df[use]
        out = [(p, 1, who[pick].tobytes(), None, df[pick].astype(np.uint32).tobytes(), k[pick].tobytes()) for p, pick in by_part((who % np.uint64(n_parts)).astype(np.int64), n_parts)]
        if out:
            yield _table(out)

    return run


def _deal_members(n_parts: int):
    @frugal
    def run(batches):
        for b in batches:
            who = _member(b)
            ids, c, is_open, need, v = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3, 4, 5))
            out = [(p, 2, who[pick].tobytes(), ids[pick].tobytes(), np.concatenate([need[pick], is_open[pick], v[pick]]).tobytes(), c[pick].tobytes()) for p, pick in by_part((who % np.uint64(n_parts)).astype(np.int64), n_parts)]
            if out:
                yield _table(out)

    return run


def _rarest_keys(n_parts: int):
    """Members and their useful keys to the rarest ones, of which any partner has at least one among its rarest."""

    @frugal
    def run(batches):
        keys, members = [], []
        for b in batches:
            for kind, *row in zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True):
                (keys if kind == 1 else members).append(row)
        if not keys or not members:
            return
        who, df, k = (np.concatenate([np.frombuffer(r[i], t) for r in keys]) for i, t in ((0, np.uint64), (2, np.uint32), (3, np.uint64)))
        order = np.lexsort((k, df, who))
        who, k = who[order], k[order]
        member, ids, c = (np.concatenate([np.frombuffer(r[i], t) for r in members]) for i, t in ((0, np.uint64), (1, np.int64), (3, np.int64)))
        need, is_open, v = np.concatenate([np.frombuffer(r[2], np.int64).reshape(3, -1) for r in members], 1)
        lo, hi = np.searchsorted(who, member, "left"), np.searchsorted(who, member, "right")
        take = np.maximum(0, hi - lo - need + 1)
        row = np.repeat(np.arange(len(member)), take)
        at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + lo[row]
        k, rest = k[at], hi[row] - at
        out = [(p, 3, ids[row[pick]].tobytes(), c[row[pick]].tobytes(), np.stack([is_open[row[pick]], v[row[pick]], rest[pick]]).tobytes(), k[pick].tobytes()) for p, pick in by_part(hash_part(k, n_parts), n_parts)]
        if out:
            yield _table(out)

    return run


def _meet():
    """Rarest keys of a range to the pairs (a, b) of an open member and one of another component that may share enough from that key on."""

    @frugal
    def run(batches):
        rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
        if not rows:
            return
        i, c, k = (np.concatenate([np.frombuffer(r[j], t) for r in rows]) for j, t in ((0, np.int64), (1, np.int64), (3, np.uint64)))
        is_open, v, rest = np.concatenate([np.frombuffer(r[2], np.int64).reshape(3, -1) for r in rows], 1)
        order = np.lexsort((1 - is_open, k))
        i, c, is_open, v, rest, k = (x[order] for x in (i, c, is_open, v, rest, k))
        edge = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        held, size = [], 0

        def pack():
            pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for o in range(s, s + int(is_open[s:e].sum())):
                may = (c[s:e] != c[o]) & ((is_open[s:e] == 0) | (np.arange(s, e) > o))
                # rest counts a member's useful keys from this one on; v is 2 w - 25 r.
                may &= 2 * (100 + PERCENT) * np.minimum(rest[s:e], rest[o]) >= v[s:e] + v[o]
                far = i[s:e][may]
                held.append(np.stack([np.minimum(far, i[o]), np.maximum(far, i[o])], 1))
                size += len(far)
                if size > 1 << 19:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()

    return run


def _past_hubs(hubs: DataFrame, table: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of members of one hub that are not connected and may link.

    A member that lacks p of the hub's r shingles and adds q others has the weight w =
    100 p + 75 q. Two members link only if they share (w + w' - 25 r) / 175 of the
    shingles that set them apart from the hub. An open member, that is one not connected with the
    hub, has w > 25 r, hence must share some with any partner; ordered by how many
    members have them, one of both members' rarest.
    """
    n = packed_parts(tasks(table.sparkSession))
    l = labels.withColumnRenamed("component", "c")
    members = hubs.select("hub", "id").join(l, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = members.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("hub")
    home = members.filter("hub = id").select("hub", F.col("c").alias("hc"))
    sizes = table.select("id", "n")
    members = members.join(mixed, "hub").join(home, "hub").filter("hub <> id").join(sizes, "id").join(sizes.select(F.col("id").alias("hub"), F.col("n").alias("r")), "hub")
    members = settle(members.select("hub", "id", "c", (F.col("c") != F.col("hc")).alias("open"), (F.col("n") + F.col("r")).alias("most")))
    # A set is a member of more hubs as tables grow: hubs go by turns, with as many shingles in a turn as the table has, so that what is exchanged at once grows with the table alone.
    all_keys, most = table.agg(F.sum("n")).first()[0], members.agg(F.sum("most")).first()[0]
    turns = -(-(most or 0) // max(1, all_keys or 0))
    found = None
    for turn in range(turns):
        pairs = _of_turn(members.filter(F.pmod(F.xxhash64(F.lit(7), "hub"), F.lit(turns)) == turn).drop("most"), table, k, n)
        found = pairs if found is None else found.unionByName(pairs)
    return members.select(F.col("hub").alias("a"), F.col("id").alias("b")) if found is None else found.distinct()


def _of_turn(members: DataFrame, table: DataFrame, k: int, n: int) -> DataFrame:
    """_past_hubs() of the members (hub, id, c, open) of some hubs."""
    texts = members.join(table.select(F.col("id").alias("hub"), F.col("packed").alias("x")), "hub").join(table.select("id", F.col("packed").alias("y")), "id")
    apart = texts.select("hub", "id", "x", "y", "c", "open").mapInArrow(_differences(k), "hub long, id long, r long, p long, q long, c long, open boolean, d array<long>")
    rows = settle(apart.withColumn("w", F.lit(100) * F.col("p") + F.lit(PERCENT) * F.col("q")))
    least = settle(rows.groupBy("hub").agg(F.min("w").alias("least"), F.min(F.when(F.col("open"), F.col("w"))).alias("least_open")).filter("least_open is not null"))
    need = F.ceil((F.col("w") + F.when(F.col("open"), F.col("least")).otherwise(F.col("least_open")) - F.lit(100 - PERCENT) * F.col("r")) / (100 + PERCENT)).cast("long")
    able = rows.join(small_side(least, HUBS), "hub").withColumn("need", F.greatest(need, F.lit(1).cast("long"))).filter("need <= p + q").select("hub", "id", "c", "open", "need", "d", (2 * F.col("w") - F.lit(100 - PERCENT) * F.col("r")).alias("v"))
    useful = deal(able.mapInArrow(_deal_keys(n), _PACKED), n).mapInArrow(_useful_keys(n), _PACKED)
    rarest = deal(able.select("hub", "id", "c", "open", "need", "v").mapInArrow(_deal_members(n), _PACKED).unionByName(useful), n).mapInArrow(_rarest_keys(n), _PACKED)
    pairs = settle(deal(rarest, n).mapInArrow(_meet(), "a long, b long").distinct())
    discard(rows)
    return pairs


def link(table: DataFrame, k: int = SHINGLE, hot: np.ndarray | None = None) -> DataFrame:
    """(id, component) of the sets in table (id, n, packed) that link with another, found by shared signatures; hot are the hashes of very frequent shingles."""
    n = packed_parts(tasks(table.sparkSession))
    table = settle(screened(table, k, np.zeros(0, np.uint64) if hot is None else hot))
    found = settle(deal(table.mapInArrow(_sign(n, k), _PACKED), n).mapInArrow(_groups(), "a long, b long, c long, g long"))
    pairs = settle(found.filter("g is null").groupBy("a", "b").agg(F.sum("c").alias("c")))
    members = found.filter("g is not null").select("g", F.col("a").alias("id")).distinct()
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    members = settle(members.join(sizes, "g"))
    # The member that shares most, over all its groups, is the hub of a group.
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    centers = members.join(weight, "id").groupBy("g").agg(F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("top")).select("g", (-F.col("top.m")).alias("hub"))
    hubs = settle(members.join(centers, "g").select("hub", "id").distinct())
    # First the hubs, and the partner with the most shared signatures; then all listed pairs that are not connected by then.
    best = pairs.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    first = best.unionByName(hubs.filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"))).distinct()
    links = verify(first, table, k)
    labels = components(links)
    rest = settle(_apart(pairs.select("a", "b"), labels))
    if not rest.isEmpty():
        links = links.unionByName(verify(rest, table, k))
        labels = components(links)
    cross = _past_hubs(hubs, table, labels, k)
    if not cross.isEmpty():
        links = links.unionByName(verify(cross, table, k))
        labels = components(links)
    return labels


def near_duplicates(docs: DataFrame, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are runs of non-blank bytes with A-Z in lower case; a set is the distinct
    k-word shingles, or the whole sequence of a shorter text. Sets link at a Jaccard
    similarity of 0.75 or more; component_id is the smallest doc_id reachable. Null,
    empty and blank texts have no shingles and stand alone, and a row with a null doc_id
    has a null component and links with nothing. Repeated rows have a result each.
    Shingles are compared by 64-bit hashes. Other columns are not read.
    """
    lean_batches(docs.sparkSession)
    n = packed_parts(tasks(docs.sparkSession))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    hot = hot_shingles(rows, k)
    counts = deal(rows.mapInArrow(_prefixes(n, k, hot), _PACKED), n).mapInArrow(_shared(n), _PACKED)
    table = settle(deal(rows.mapInArrow(_texts(n, k), _PACKED).unionByName(counts), n).mapInArrow(_survivors(), "id long, n long, packed binary"))
    labels = link(table, k, hot)

    @frugal
    def sizes(batches):
        for d, null, _, _, _, at, f1, f2 in _chunks(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(d, mask=null), pa.array(np.diff(at).astype(np.int64)), pa.array(f1), pa.array(f2)], ["doc_id", "n_shingles", "f1", "f2"])

    every = settle(rows.mapInArrow(sizes, "doc_id long, n_shingles long, f1 long, f2 long"))
    same = every.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    # Only sets with copies or links need their class; their rows are few against all, and partial minima carry hot copies.
    # Settled, so that the join below is free to split the rows of a hot set.
    known = settle(same.join(labels, "id", "left").filter("copies > 1 or component is not null").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "id").alias("component")))
    out = every.join(known, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
