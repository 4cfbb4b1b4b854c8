import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import byte_strings, jaccard, substrings, suffix

from . import helpers as h


@pytest.fixture(scope="module")
def rows():
    return h.documents()


def _plain(rows):
    return [(r[0], r[1]) for r in rows]


def test_substrings_match_brute_force(spark, rows):
    got = substrings.repeated_substrings(h.frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == h.substring_removal(_plain(rows))


def test_byte_strings_match_brute_force(spark, rows):
    got = byte_strings.repeated_bytes(h.frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == h.byte_removal(_plain(rows))


def test_tasks_with_documents_but_no_repeated_bytes(spark):
    shared = h.documents(1)[:40] + [(999, "a" * 900, *[None] * 10)]
    alone = [(i, " ".join(h.vocabulary(50 + i, 150)), *[None] * 10) for i in range(30)]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # more tasks than documents that lose bytes
    try:
        for some in (alone, shared + alone):
            got = byte_strings.repeated_bytes(h.frame(spark, some)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
            assert Counter(map(tuple, got)) == h.byte_removal(_plain(some))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


@pytest.mark.parametrize("seed", [0, 7])
def test_jaccard_matches_brute_force(spark, seed):
    rows = h.documents(seed, near=90)
    got = jaccard.near_duplicates(h.frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == h.near_classes(_plain(rows))


def test_empty_tables(spark):
    empty = h.frame(spark, [])
    assert substrings.repeated_substrings(empty).count() == 0
    assert byte_strings.repeated_bytes(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0


def test_signatures_lose_no_pair():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(3, 160)
        a = np.unique(np.array([r.getrandbits(63) for _ in range(n)], np.uint64))
        lost = r.randint(0, len(a) // 4)
        b = a[np.array(sorted(r.sample(range(len(a)), len(a) - lost)), int)]
        extra = np.array([r.getrandbits(63) for _ in range(r.randint(0, max(0, len(a) // 4 - lost)))], np.uint64)
        b = np.unique(np.concatenate([b, extra]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        sigs, rows = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(sigs[rows == 0].tolist()) & set(sigs[rows == 1].tolist()), (len(a), len(b), both)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_suffix_arrays(monkeypatch, dense):
    monkeypatch.setattr(suffix, "DENSE", dense)
    r = np.random.default_rng(1)
    for t in range(60):
        a = r.integers(1, int(r.integers(2, 6)), int(r.integers(1, 150)))
        a = np.tile(a[: max(1, len(a) // 4)], 5) if t % 3 == 0 else a
        s = np.append(a, 0).astype(np.int16)
        assert suffix.sais(s, 6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_window_cover_and_gaps():
    begin, end = substrings.cover(np.array([0, 1, 5, 30]), 5)
    assert begin.tolist() == [0, 30] and end.tolist() == [10, 35]
    v = np.array([0, 3, 3, 900, 901, 100000])
    assert substrings.unpack_gaps(substrings.pack_gaps(v)).tolist() == v.tolist()


def test_hot_windows_are_judged_on_the_spot(spark, monkeypatch):
    rows = h.documents(4)
    r = random.Random(2)
    line = " ".join(h.vocabulary(9, 40)[:25])
    rows += [(5000 + i, f"{i} {r.random()} " * r.randint(0, 9) + line + f" {i}", None, None, *rows[0][4:]) for i in range(60)] + [(None, line, None, None, *rows[0][4:])]
    monkeypatch.setattr(substrings, "HOT_ROWS", 20)
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    frame = h.frame(spark, rows)
    assert substrings.hot_windows(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 20).shape[1] >= 6
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.repeated_substrings(frame).collect())
    assert got == h.substring_removal([(x[0], x[1]) for x in rows])


def test_hot_anchors_are_avoided(spark, monkeypatch):
    r = random.Random(5)
    v = h.vocabulary(12, 200)
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    passage, other = say(150), say(90)
    rows = [(i, say(r.randint(0, 60)) + " " + (passage if i % 3 else passage[: r.randint(380, len(passage))]) + " " + say(r.randint(0, 60)) + (other if i % 10 == 0 else ""), *[None] * 10) for i in range(60)]
    rows += [(100, passage, *[None] * 10), (101, other, *[None] * 10), (None, passage + passage, *[None] * 10), (102, None, *[None] * 10), rows[4]]
    monkeypatch.setattr(byte_strings, "HOT_ROWS", 15)
    monkeypatch.setattr(byte_strings, "SAMPLE", 1)
    frame = spark.createDataFrame(rows, h.SCHEMA).repartition(5)
    hot, known = byte_strings.hot_seeds(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 400)
    assert len(hot) > 100 and len(known) > 100
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in byte_strings.repeated_bytes(frame).collect())
    assert got == h.byte_removal([(x[0], x[1]) for x in rows])
    # With a sparser sample, only some of the strings are known; the rest go the usual way.
    monkeypatch.setattr(byte_strings, "SAMPLE", 3)
    got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in byte_strings.repeated_bytes(frame).collect())
    assert got == h.byte_removal([(x[0], x[1]) for x in rows])


def test_hot_shingles_change_no_class(spark, monkeypatch):
    rows = h.documents(6, near=60)
    want = h.near_classes([(x[0], x[1]) for x in rows])
    monkeypatch.setattr(jaccard, "HOT_SETS", 4)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    frame = h.frame(spark, rows)
    assert len(jaccard.hot_shingles(frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 5)) > 5
    assert Counter(map(tuple, jaccard.near_duplicates(frame).collect())) == want


def test_many_hashes_of_one_set_in_one_range():
    out = []
    owner = np.repeat([0, 1, 2], [3, 70000, 5])
    jaccard.screen_rows(out, 0, np.array([7, 8, 9]), jaccard.size_code(np.array([3, 70000, 5])), owner, np.arange(len(owner), dtype=np.uint64))
    d, code, x = jaccard.read_screen([substrings._table(out)])
    order = np.argsort(x)
    assert (d[order] == np.array([7, 8, 9])[owner]).all() and (x[order] == np.arange(len(owner))).all() and len(set(zip(d, code))) == 3


def test_ranges_of_hashes_change_no_class(spark, monkeypatch):
    rows = h.documents(11, near=60)
    monkeypatch.setattr(jaccard, "RANGE", 50)
    monkeypatch.setattr(jaccard, "PARTS", 2)
    assert Counter(map(tuple, jaccard.near_duplicates(h.frame(spark, rows)).collect())) == h.near_classes([(x[0], x[1]) for x in rows])


def test_bytes_of_a_hash_do_not_grow_with_the_partitions():
    rng = np.random.default_rng(3)
    hashes, owner = rng.integers(0, 2**63, 200 * 225, dtype=np.uint64) * np.uint64(2), np.repeat(np.arange(200), 225)
    sets_of, codes = rng.integers(0, 2**62, 200), np.zeros(200, np.uint16)

    def size(partitions):
        n, out = jaccard.packed_parts(partitions), []
        for p, pick in substrings.by_part(substrings.hash_part(hashes, n), n):
            jaccard.screen_rows(out, p, sets_of, codes, owner[pick], hashes[pick])
        found = [np.concatenate(x) for x in zip(*jaccard.screen_ranges([substrings._table(out)]))]
        assert sorted(zip(*found[::2])) == sorted(zip(sets_of[owner], hashes.astype(np.uint32)))
        return sum(len(v) for row in out for v in row[2:] if v)

    assert size(600) <= 1.25 * size(51)


def test_known_strings_are_compared_byte_by_byte():
    import numpy as np

    text = bytes(range(97, 123)) * 3
    known = byte_strings.Known([text[:40], text[10:50]], 16)
    data = np.frombuffer(b"##" + text[:40] + b"##" + text[:20] + b"!" + text[21:40], np.uint8)
    starts = np.arange(len(data) - 15)
    prints = np.array([known.prints[0]] * len(starts))
    for i in range(len(starts)):  # as if the fingerprints of the changed strings were those of the unchanged
        s = bytes(data[i : i + 16]).replace(b"!", text[20:21])
        at = (text[:50]).find(s)
        if at >= 0:
            prints[i] = byte_strings.Known([s], 16).prints[0]
    want = [bytes(data[i : i + 16]) in {text[k : k + 16] for k in range(25)} | {text[k : k + 16] for k in range(10, 35)} for i in starts]
    assert known.holds(data, starts, prints).tolist() == want and sum(want) > 20 and not all(want)
    assert not len(byte_strings._NOTHING) and not byte_strings._NOTHING.holds(data, starts, prints).any()


def test_hubs_of_many_members_go_by_turns(spark, monkeypatch):
    import zstandard

    r = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(common + [f"w{r.randrange(10**6)}" for _ in range(30)]) for _ in range(30)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[:10]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    table = spark.createDataFrame([(i, len(s), zstandard.compress(t.encode())) for i, (t, s) in enumerate(zip(texts, sets, strict=True))], "id long, n long, packed binary")
    hubs = spark.createDataFrame([(h, i) for h in range(12) for i in range(len(texts))], "hub long, id long")
    settled, plain = [], jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df: (settled.append(df.selectExpr("sum(size(d))").first()[0] or 0) if "d" in df.columns else None) or plain(df))
    got = {tuple(x) for x in jaccard._past_hubs(hubs, table, spark.createDataFrame([], "id long, component long"), 5).collect()}
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(near) == 10 and near <= got
    # What sets the members of all hubs apart is never held at once.
    assert max(settled) < sum(len(sets[a] ^ s) for a in range(12) for s in sets) / 2
