"""Streams with state against plain loops, whatever the steps after which they are restarted."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lodestar.operators import dedup
from lodestar.streaming import operators as st
from lodestar.streaming import state

SCHEMA = "event_id long, ts double, user_id long, event_type string, value double, node string, n string"


def _events(seed=0, n=300, days=4):
    r = random.Random(seed)
    rows = [(i, r.uniform(0, days * 86400), r.choice([None, -1, *range(8)]), r.choice([None, "a", "b", "c"]), r.choice([None, r.expovariate(0.1)]), r.choice(["x", "x", "x", "y", None]), "clash") for i in range(n)]
    return sorted(rows, key=lambda x: x[1])


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts")).repartition(3)


@pytest.mark.parametrize("steps", [1, 4])
def test_null_users_and_kinds_count(spark, steps):
    rows = _events()
    got = st.replayed(_frame(spark, rows), st.hourly_counts, steps)
    assert got.agg(F.sum("n")).first()[0] == len(rows) and got.filter("user_id = -1").count() > 0 and got.filter("user_id is null").count() > 0
    days = st.replayed(_frame(spark, rows), st.summaries, steps).collect()
    assert sum(r["n"] for r in days) == len(rows) and any(r["event_type"] is None for r in days)


@pytest.mark.parametrize("steps", [1, 3])
def test_lru_equals_a_plain_loop(spark, steps):
    rows = _events(1)
    got = st.replayed(_frame(spark, rows), lambda e: state.lru(e, "node", "user_id", 3, 20000.0), steps)
    got = {r["node"]: tuple(r)[1:] for r in got.groupBy("node").agg(*[F.max(c) for c in ("n", "hits", "expired", "evicted")]).collect()}
    caches, want = {}, {}
    for _, t, user, _, _, node, _ in rows:
        cache, counts = caches.setdefault(node, OrderedDict()), want.setdefault(node, [0, 0, 0, 0])
        counts[0] += 1
        if user in cache and t - cache[user] <= 20000:
            counts[1] += 1
            cache.move_to_end(user)
            continue
        if user in cache:
            counts[2] += 1
            del cache[user]
        elif len(cache) == 3:
            counts[3] += 1
            cache.popitem(last=False)
        cache[user] = t
    assert got == {k: tuple(v) for k, v in want.items()} and all(min(v) > 0 for v in got.values())


@pytest.mark.parametrize("steps", [1, 3])
def test_flapping_equals_a_plain_loop(spark, steps):
    rows = _events(2)
    got = {r["event_id"]: (r["user_id"], r["changes"], r["suspicious"]) for r in st.replayed(_frame(spark, rows), state.flapping, steps).collect()}
    want, held = {}, {}
    for i, t, user, kind, *_ in rows:
        claims = held[user] = [c for c in held.get(user, []) if c[0] >= t - 86400] + [(t, kind)]
        changes = sum(a[1] != b[1] for a, b in zip(claims, claims[1:], strict=False))
        want[i] = (user, changes, changes >= 3)
    assert got == want


def _pages(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(20)]
    texts += [t + " end" for t in texts[:8]] + [t.replace("w1 ", "") for t in texts[8:14]] + texts[:5] + ["", None, "one", "one"]
    r.shuffle(texts)
    return [(i, i * 50000.0 + r.random(), t, "clash") for i, t in enumerate(texts)]


def test_fingerprints_of_texts_alone_are_those_of_tables(spark):
    rows = spark.createDataFrame([(i, t) for i, _, t, _ in _pages()], "doc_id long, text string")
    alone = {r["doc_id"]: r["f"] for r in rows.select("doc_id", dedup.fingerprint(F.col("text")).alias("f")).collect()}
    assert alone == {r["doc_id"]: r["simhash"] for r in dedup.simhash(rows).collect()}


def test_fingerprints_of_long_texts_take_time_in_proportion(spark):
    import time

    rows = spark.createDataFrame([(i, f"w{i} " * 7 + "some words that go on and on " * 12000) for i in range(2)], "doc_id long, text string")
    began = time.time()
    alone = {r["doc_id"]: r["f"] for r in rows.select("doc_id", dedup.fingerprint(F.col("text")).alias("f")).collect()}
    assert time.time() - began < 60  # words taken anew for each run would take hours
    assert alone == {r["doc_id"]: r["simhash"] for r in dedup.simhash(rows).collect()}


@pytest.mark.parametrize("steps", [1, 4])
def test_near_pages_are_known_after_restarts(spark, steps):
    rows = _pages()
    frame = spark.createDataFrame(rows, "doc_id long, ts double, text string, distance string")
    prints = {r["doc_id"]: r["simhash"] for r in dedup.simhash(frame).collect()}
    hours = 200.0
    got = st.replayed(frame.withColumn("ts", F.timestamp_seconds("ts")), lambda e: state.near_seen(e, hours), steps)
    got = {r["doc_id"]: r["d"] for r in got.groupBy("doc_id").agg(F.min("distance").alias("d")).collect()}
    want = {}
    for i, t, *_ in rows:
        gaps = [bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") for j, u, *_ in rows if j < i and t - u < hours * 3600]
        if gaps and min(gaps) <= 3:
            want[i] = min(gaps)
    assert got == want and len({*want.values()}) > 1
    everyone = [min((bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") for j, *_ in rows if j < i), default=64) for i, *_ in rows]
    assert sum(x <= 3 for x in everyone) > len(want)  # some are forgotten


@pytest.mark.parametrize("earlier", [1e6, 1e10])
def test_near_pages_before_1970_are_known(spark, earlier):
    rows = [(i, t - earlier, text) for i, t, text, _ in _pages()]
    frame = spark.createDataFrame(rows, "doc_id long, ts double, text string").withColumn("ts", F.timestamp_seconds("ts"))
    later = frame.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(earlier)))
    least = lambda df: {r["doc_id"]: r["d"] for r in st.replayed(df, lambda e: state.near_seen(e, 200.0)).groupBy("doc_id").agg(F.min("distance").alias("d")).collect()}
    assert (got := least(frame)) == least(later) and len(got) > 5


def test_near_pages_meet_in_few_groups(spark):
    rows = _pages(4)
    calls = spark.sparkContext.accumulator(0)
    plain = state.by_key

    def counted(events, keys, out, kind, start, step, order, idle):
        def run(held, frame):
            calls.add(1)
            return step(held, frame)

        return plain(events, keys, out, kind, start, run, order, idle)

    frame = spark.createDataFrame(rows, "doc_id long, ts double, text string, distance string").withColumn("ts", F.timestamp_seconds("ts"))
    want = {tuple(r) for r in st.replayed(frame, lambda e: state.near_seen(e, 200.0), 2).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(state, "by_key", counted)
        got = {tuple(r) for r in st.replayed(frame, lambda e: state.near_seen(e, 200.0, keys=3), 2).collect()}
    assert got == want and 0 < calls.value <= 2 * 3 + 3


def test_quantiles_merge_in_any_order(spark):
    r = random.Random(5)
    values = [r.lognormvariate(0, 2) for _ in range(20000)]
    rows = spark.createDataFrame([(i, float(i * 20), 1, "a", v, "x", "c") for i, v in enumerate(values)], SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    hours = st.replayed(rows, lambda e: state.quantile_sketches(e, "1 hour"), 2)
    assert hours.count() > 50
    ordered = sorted(values)
    for seed in range(3):
        q = hours.orderBy(F.rand(seed)).agg(F.kll_merge_agg_double("sketch", F.lit(state.SKETCH)).alias("s")).select(state.quantiles(F.col("s")).alias("q")).first()["q"]
        for p, x in zip((0.5, 0.95, 0.99), q, strict=True):
            rank = sum(v <= x for v in ordered) / len(ordered)
            assert abs(rank - p) <= 0.02


def test_no_events(spark):
    none = _frame(spark, [])
    for operator in (st.hourly_counts, state.flapping, state.quantile_sketches, lambda e: state.lru(e, "node", "user_id", 2, 60.0)):
        assert st.replayed(none, operator).count() == 0
    assert st.replayed(none, state.hourly_peers, then=state.drop_alerts).count() == 0


@pytest.mark.parametrize("steps", [1, 3])
def test_locks_files_and_reformulations_equal_plain_loops(spark, steps):
    rows = _events(6)
    frame = _frame(spark, rows)
    got = {r["event_id"]: r["outcome"] for r in st.replayed(frame, lambda e: state.locks(e, "node", "user_id", F.col("event_type") == "b", 9000.0), steps).collect()}
    held, want = {}, {}
    for i, t, user, kind, _, node, _ in rows:
        owner, until = held.get(node, (None, 0.0))
        holds, mine = t < until, owner == ("" if user is None else user)
        if kind == "b":
            want[i] = "released" if holds and mine else "ignored"
            held[node] = (owner, 0.0 if holds and mine else until)
        elif holds and not mine:
            want[i] = "refused"
        else:
            want[i] = "renewed" if holds else "granted"
            held[node] = ("" if user is None else user, t + 9000.0)
    assert got == want and set(want.values()) == {"released", "ignored", "refused", "renewed", "granted"}

    got = {r["event_id"]: r["file"] for r in st.replayed(frame, lambda e: state.log_files(e, "node", F.format_string("%d %s", "event_id", "event_type"), 60), steps).collect()}
    files, want = {}, {}
    for i, _, _, kind, _, node, _ in rows:
        file, size = files.get(node, (0, 0))
        file, size = (file + 1, 0) if size > 60 else (file, size)
        want[i] = file
        files[node] = file, size + len(f"{i} {kind or 'null'}") + 1
    assert got == want and max(want.values()) > 3

    got = {r["event_id"]: (r["user_id"], round(r["gap"], 3)) for r in st.replayed(frame, lambda e: state.reformulations(e, "a", 9000.0), steps).collect()}
    last, want = {}, {}
    for i, t, user, kind, *_ in rows:
        if kind == "a":
            if user in last and t - last[user] <= 9000:
                want[i] = (user, t - last[user])
            last[user] = t
    assert got.keys() == want.keys() and all(u == want[i][0] and abs(g - want[i][1]) < 0.01 for i, (u, g) in got.items()) and len(want) > 5


def test_submissions_are_checked_and_indexed(spark, tmp_path):
    import hashlib
    import hmac

    from lodestar.operators.segments import Index
    from lodestar.streaming import submissions

    def message(i, peer, text="some words here", url="u", spoil=None):
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest()
        sign = hmac.new(b"k", f"{url or ''}\n{digest or ''}".encode(), hashlib.sha256).hexdigest()
        return (i, float((i or 0) * 100), peer, url, "t", text, "0" * 64 if spoil == "digest" else digest, "bad" if spoil == "sign" else None if spoil == "none" else sign, "clash")

    rows = [message(1, 7), message(2, 8), message(3, None), message(4, 7, "x" * 101), message(5, 7, spoil="digest"), message(6, 7, spoil="sign"), message(7, 7, spoil="none"), message(8, 7, None), message(9, 7, url=None), message(10, 7, "other words"), message(1, 7, "new words é")]
    frame = spark.createDataFrame(rows, "doc_id long, ts double, peer long, url string, title string, text string, text_hash string, signature string, _peer string").drop("_peer").withColumn("ts", F.timestamp_seconds("ts"))
    allowed = spark.createDataFrame([(7,), (7,)], "peer long")
    index = Index(spark, str(tmp_path / "i"), buckets=2)
    got = st.replayed(frame, lambda e: submissions.checked(e.filter(~st.closing(e)), allowed, "k", 100), 2, each=submissions.into(index)).select("doc_id", "outcome").collect()
    want = {2: "peer_not_allowed", 3: "peer_not_allowed", 4: "too_large", 5: "wrong_digest", 6: "wrong_signature", 7: "wrong_signature", 8: "incomplete", 9: "incomplete", 10: "accepted"}
    assert {r["doc_id"]: r["outcome"] for r in got if r["doc_id"] != 1} == want and [r["outcome"] for r in got if r["doc_id"] == 1] == ["accepted"] * 2
    assert sorted(r["doc_id"] for r in index.ids().collect()) == [1, 10]
    open_all = submissions.checked(frame, None, None).filter("doc_id = 2").first()
    assert open_all["outcome"] == "accepted"
