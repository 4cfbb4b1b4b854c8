"""Formulas at their boundaries, oracles on a small corpus, and the lexical search against SQLite's."""

import hashlib
import itertools
import math
import re
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestar import catalog
from lodestar.functions import passages, quality, scores, text
from lodestar.operators import dedup, extraction, graph, ledger, ranking, search, trust

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_freshness_half_life_floor_and_future(spark):
    now = 1e9
    at = lambda age: one(spark, scores.freshness(F.lit(now - age), now))
    assert at(0) == 1.0 and at(-50) == 1.0 and at(604800) == 0.5 and at(365 * 86400) == 0.05


def test_bm25_normal_and_weights(spark):
    assert one(spark, scores.normal_bm25(F.lit(3.0), F.lit(3.0))) == 0.5
    assert sum(scores.WEIGHTS.values()) == pytest.approx(1.0)


def test_bm25_equals_sqlite(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit("").alias("title"), "text")
    queries = spark.createDataFrame([(1, "the of"), (2, "la de"), (3, "tion")], "query_id long, query string")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE d USING fts5(title, text)")
    db.executemany("INSERT INTO d(rowid, title, text) VALUES (?, ?, ?)", [(r[0] + 1, r[1], r[2]) for r in docs.collect()])
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25(docs, queries).collect()}
    want = {(q, i - 1): -s for q, t in ((1, "the of"), (2, "la de"), (3, "tion")) for i, s in db.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (t,))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got)


def test_off_peak_wraps_midnight(spark):
    assert [one(spark, ledger.off_peak(F.lit(h))) for h in (22, 23, 0, 6, 7)] == [False, True, True, True, False]


def test_credit_weights(spark):
    log = spark.createDataFrame([(1, 1, "crawl", 10.0, 43200.0), (2, 1, "query_process", 5.0, 43200.0), (3, 1, "llm_own", 1.0, 0.0)], "event_id long, peer long, action string, quantity double, ts double")
    assert [r["credits"] for r in ledger.earned(log).orderBy("event_id").collect()] == [10.0, 2.5, 2.25]


def test_contribution_caps_models(spark):
    rows = spark.createDataFrame([(1, "llm_own", 100.0), (1, "crawl", 20.0)], "peer long, action string, credits double")
    assert ledger.contribution(rows).first()["score"] == pytest.approx(20 + 20 * 0.6 / 0.4)


def test_trust_extremes(spark):
    assert one(spark, trust.trust_score(F.lit(720.0), F.lit(5000.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)
    assert one(spark, trust.trust_score(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == pytest.approx(0.3)


def test_ema_folds_in_order(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (1, 1, 0.0)], "peer long, ts long, v double")
    assert trust.ema(rows, "peer", "v", ["ts"]).first()["result"] == pytest.approx((0.5 * 0.7) * 0.7 + 0.3)


def test_passages_split_and_merge():
    long = "First sentence here is long. " * 20
    assert passages.split("") == [] and passages.split(None) == []
    parts = passages.split("A paragraph that is long enough to stand alone here.\n\nshort\n\n" + long)
    assert parts[0].endswith("short") and all(len(p) <= 500 for p in parts[1:])


def test_wide_grams():
    assert passages.wide_grams("日本語 abc x1 한", 2) == ["日本", "本語", "abc", "x1", "한"]


def test_url_rules(spark):
    norm = lambda u: one(spark, dedup.normalize_url(F.lit(u)))
    assert norm("HTTP://A.com/b/?z=1&utm_source=x&a=2#f") == "http://a.com/b?a=2&z=1" and norm("http://a.com") == "http://a.com/"
    safe = lambda u: one(spark, quality.url_safe(F.lit(u)))
    assert [safe(u) for u in ("http://10.0.0.1/", "http://8.8.8.8/", "ftp://a.com", "http://x.local/", "https://a.org/p")] == [False, True, False, False, True]


def test_simhash_pairs_equal_brute_force(spark):
    hashes = dedup.simhash(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = {r["simhash"]: r["doc_id"] for r in hashes.orderBy(F.desc("doc_id")).collect()}
    want = {tuple(sorted((rows[x], rows[y]))) for x in rows for y in rows if x < y and bin((x ^ y) & (2**64 - 1)).count("1") <= 3}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(hashes).collect()} == want


def test_diversify_takes_turns(spark):
    rows = spark.createDataFrame([(1, i + 1, d, i) for i, d in enumerate(["a", "a", "b", "a", "c", "a"])], "query_id long, rank long, domain string, doc_id long")
    got = [r["doc_id"] for r in ranking.diversify(rows).orderBy("rank").collect()]
    assert got == [0, 2, 1, 4, 3]  # the turn moves on past the domain after one that leaves


def test_ndcg(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "query_id long, rank long, relevance long")
    assert ranking.ndcg(rows).first()["ndcg"] == pytest.approx(1 / math.log2(3))


def test_entities_and_wet(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace met Alan Turing over Python and Python")], "doc_id long, text string")
    got = {(r["type"], r["name"], r["n"]) for r in extraction.entities(docs).collect()}
    assert got == {("NAME", "Ada Lovelace", 1), ("NAME", "Alan Turing", 1), ("TECH", "Python", 2)}
    wet = "WARC/1.0\nWARC-Type: warcinfo\n\nx\n" + "".join(f"WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: http://a/{i}\n\n{'word ' * n}\n" for i, n in ((1, 20), (2, 3), (3, 30)))
    assert extraction.wet_records(spark.createDataFrame([(wet,)], "content string")).count() == 2


def test_authority_prefers_the_cited(spark):
    e = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a")], "source_domain string, target_domain string")
    s = {r["domain"]: r["score"] for r in graph.authority(e).collect()}
    assert s["c"] == 1.0 and s["a"] > s["b"]


def test_tokens_fold_accents(spark):
    assert one(spark, text.index_tokens(F.lit("Café_au lait's"))) == ["cafe", "au", "lait", "s"]


def test_related_searches_pairs_all_terms_of_a_turn(spark, tmp_path):
    long = " ".join(f"term{i}" for i in range(90))
    rows = [(1, 0, "user", long + " ai ml"), (1, 1, "assistant", "term0 ai"), (2, 0, "user", long.upper()), (3, 0, "user", "ml AI ml once"), (4, 0, "user", None), (5, 0, "user", ""), (3, 1, "user", "term0"), (3, 2, "user", "ai")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["term_a"], r["term_b"]): r["times"] for r in catalog.QUERIES["related_searches"](spark, str(tmp_path)).collect()}
    want = Counter(p for _, _, role, t in rows if role == "user" for p in itertools.combinations(sorted(set((t or "").lower().split())), 2))
    assert got == {p: n for p, n in want.items() if n > 1} and got["ai", "ml"] == 2 and len(got) == 90 * 89 // 2 + 1


FAST = ["bm25_search", "ranked_search", "intent6", "nl_query_parse", "toxicity", "url_safety", "credit_balance", "grace_state", "trust_score", "threat_level", "rate_limited", "facets", "keywords_tf", "normalize_url", "content_diff", "citations", "rag_chunks", "replica_set", "recrawl_queue", "stream_hourly_counts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr([_plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert sorted(repr([_plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) >= 112
    assert not any(re.search(r"\bLIMIT 1000\b", s) for s in catalog.ORACLES.values())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle_proofs_hold_and_fail(spark, n):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(i * 3, digest(f"text {i}")) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, leaf string").repartition(4)
    level = [digest("leaf:" + x) for _, x in rows]
    while len(level) > 1:
        level = [digest(level[i] + level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    proofs = dedup.merkle_proofs(df, "doc_id", "leaf")
    assert dedup.merkle_root(df, "doc_id", "leaf").first()["root"] == level[0]
    got = proofs.select("doc_id", "pos", "root", F.size("path").alias("n"), dedup.proof_holds(F.col("leaf"), F.col("path"), F.col("root")).alias("ok"), dedup.proof_holds(F.lit(digest("other")), F.col("path"), F.col("root")).alias("other")).collect()
    assert sorted((r["doc_id"], r["pos"]) for r in got) == [(i * 3, i) for i in range(n)]
    assert all(r["root"] == level[0] and r["ok"] and not r["other"] and r["n"] == (n - 1).bit_length() for r in got)


def test_dense_snippets_try_every_window(spark):
    import random

    from lodestar.operators import results

    r = random.Random(2)
    texts = [" ".join(r.choice(["A,", "b", "C!", "x", "y", "z", "w"] + ["."] * 20) for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = [(i, t, ["a", "b", "c"]) for i, t in enumerate([*texts, "", None, "a b c"])]
    got = results.dense_snippets(spark.createDataFrame(rows, "k long, text string, terms array<string>"), ["k"], 7).collect()
    assert len(got) == len(rows)
    for g in got:
        words = (rows[g["k"]][1] or "").split()
        plain = [w.lower().strip(",!.") for w in words]
        count = lambda s: len(set(plain[s : s + 7]) & {"a", "b", "c"})
        most = max([count(s) for s in range(len(words))], default=0)
        assert g["n_terms"] == most == count(g["start"])


def test_peers_in_order_and_with_diversity(spark):
    from lodestar.operators import peers

    rows = [(i, None if i % 7 == 0 else float((i * 37) % 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "peer long, latency double").repartition(5)
    order = [p for p, _ in sorted(rows, key=lambda r: (math.inf if r[1] is None else r[1], r[0]))]
    got = {r["place"]: r["peer"] for r in peers.by_latency(df).collect()}
    assert [got[i + 1] for i in range(40)] == order
    lucky = lambda p: int(hashlib.md5(str(p).encode()).hexdigest()[:8], 16) % 5 == 0
    slow = order[20:]
    got = {r["place"]: r["peer"] for r in peers.diverse(df).collect()}
    assert [got[i + 1] for i in range(40)] == order[:20] + [p for p in slow if lucky(p)] + [p for p in slow if not lucky(p)]
    assert [r["peer"] for r in peers.diverse(df.limit(0)).collect()] == []


def test_means_of_equal_values_are_equal_in_any_order(spark):
    from lodestar.operators import peers

    values = [0.1, 0.2, 0.3, 56.25, 122.79, 29.27, 1e7 + 0.05, 0.07]
    rows = [(p, i, v) for p in range(12) for i, v in enumerate([*values[p % 8 :], *values[: p % 8]])] + [(90, 0, None), (91, 0, float("nan")), (91, 1, 1.0), (92, 0, 1e300), (92, 1, -1e300)]
    df = spark.createDataFrame(rows, "peer long, i long, value double").repartition(1).sortWithinPartitions("peer", "i")
    got = {r["peer"]: r["m"] for r in df.groupBy("peer").agg(peers.exact_mean(F.col("value")).alias("m")).collect()}
    assert {got[p] for p in range(12)} == {sum(round(v * 100) for v in values) / 800}
    assert got[90] is None and math.isnan(got[91]) and got[92] == 0.0


def test_peers_without_an_answer_come_after_unknown_ones(spark, tmp_path):
    rows = [(p * 100 + i, p, "error" if p == 1 else "view", 5.0 + p) for p in range(5) for i in range(10 if p == 2 else 70)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("peer_order", "peer_order_diverse"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(db.sql(catalog.ORACLES[name]).fetchall())


def test_scores_halfway_are_shown_as_sql_shows_them(spark):
    from lodestar.functions import shaping

    scores = [0.5005, 0.5025, 0.50051, 0.00015, 0.00145, 0.12345, 0.2575, 0.0, 1.0]
    c = F.col("s")
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    shown = shaping.result_text(F.lit(1), F.lit("t"), F.lit("https://a/b"), F.lit("x"), c, {"all": c})
    score = F.from_json(shaping.result_json(F.lit("https://a/b"), F.lit("t"), F.lit("x"), c, {"all": c}), "score double")["score"]
    got = {r["s"]: (r["t"], r["j"]) for r in df.select("s", F.regexp_extract(shown, r"Score: (.*)\n", 1).alias("t"), score.alias("j")).collect()}
    for s in scores:
        assert got[s] == duckdb.sql(f"SELECT format('{{:.4f}} (all={{:.3f}})', round({s!r}::DOUBLE, 4), round({s!r}::DOUBLE, 3)), round({s!r}::DOUBLE, 4)").fetchall()[0]


def test_index_of_repeated_documents_moves_no_postings(spark, tmp_path):
    rows = [(i % 90, f"title {i % 7}", " ".join(f"w{(i * j) % 23}" for j in range(i % 40)) or None) for i in range(150)] + [(None, "w1", "w2"), (None, "w1", "w3 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(5)
    path = str(tmp_path / "index")
    search.build_index(docs, path, buckets=5, slices=3)
    got = sorted(map(tuple, spark.read.parquet(f"{path}/postings").select(F.coalesce("doc_id", F.lit(-1)), "term", "tf").collect()))
    want = Counter((-1 if i is None else i, w) for i, a, b in rows for w in f"{a} {b or ''}".split())
    assert got == sorted((i, w, n) for (i, w), n in want.items())
    # What is moved are the texts: the postings of many words are written where they are made.
    assert len({r[0] for r in spark.read.parquet(f"{path}/postings").select(F.col("_metadata.file_name").substr(6, 5)).distinct().collect()}) <= 3


def test_poor_snippets_give_way_to_longer_passages(spark):
    from lodestar.operators import results

    body = "Nothing of note is said at first here. " * 20 + "The red fox jumps over a lazy dog and runs. " + "It ends with other words again. " * 20
    rows = [(1, body, ["fox"], "fox"), (2, body, ["fox"], "a fox is said to be here in a snippet that is long enough to stay as it is, really so"), (3, body, ["fox"], "x" * 400), (4, None, ["fox"], "kept"), (5, "short", ["fox"], None), (6, body, ["zebra"], "z")]
    got = {r["k"]: r["snippet"] for r in results.enhanced(spark.createDataFrame(rows, "k long, text string, wanted array<string>, snippet string"), ["k"]).collect()}
    assert "red fox" in got[1] and len(got[1]) <= 300 and got[2] == rows[1][3] and got[3] == rows[2][3] and got[4] == "kept" and got[5] == "short" and got[6] == body[:200]


def test_pointer_lists_merge_with_the_new_first(spark):
    schema = "term string, peer string, doc_id long, score long, place long"
    old = [("a", "p", 1, 5, 1), ("a", "q", 1, 6, 2), ("a", None, 2, 1, 3), ("b", "p", 9, 1, 1), ("a", "p", 3, 2, 4)]
    new = [("a", "p", 3, 9, 1), ("a", "p", 3, 1, 2), ("a", "p", 1, 7, 3), ("c", "p", None, 1, 1)]
    got = sorted(map(tuple, graph.merged_pointers(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), 2).collect()))
    assert got == [("a", "p", 1, 7, 2), ("a", "p", 3, 9, 1), ("b", "p", 9, 1, 1)]


def test_deviations_equal_plain_ones(spark):
    import random

    from lodestar.operators import peers

    r = random.Random(3)
    rows = [(i % 12, r.choice([0.0, 1.0, 2.5, 7.0, -1.0])) for i in range(70)] + [(100, 3.0), (101, 0.0), (101, 0.0)]
    got = {x["k"]: (x["seen"], x["median"], round(x["deviation"], 6)) for x in peers.deviations(spark.createDataFrame(rows, "k long, s double"), "k", "s").collect()}
    for k in {k for k, _ in rows}:
        s = sorted(v for j, v in rows if j == k)
        m = s[len(s) // 2]
        assert got[k] == (len(s), m, round(0.0 if len(s) <= 1 or m <= 0 else max(abs(v - m) for v in s) / m, 6))


def test_answers_and_work(spark):
    import json

    from lodestar.functions import shaping

    entry = shaping.merged_entry(F.lit("https://a.example/x"), F.lit("t"), F.lit("s" * 300), F.lit("fts"), F.lit(0.123456), F.lit(None).cast("double"), F.lit(0.016393))
    said = json.loads(spark.range(1).select(shaping.answer_json(F.array(entry), F.lit(1.26), F.lit("hybrid"), F.lit(1), F.lit(0))).first()[0])
    assert said["total"] == 1 and said["elapsed_ms"] == 1.3 and said["local_count"] == 1 and said["results"][0]["scores"] == {"bm25": 0.1235, "rrf": 0.0164} and len(said["results"][0]["snippet"]) == 200
    key = hashlib.sha256(b"key").digest()
    for nonce in (0, 1, 255, 2**40 + 7):
        digest = hashlib.sha256(key + nonce.to_bytes(8, "big")).digest()
        bits = 256 - int.from_bytes(digest, "big").bit_length()
        assert spark.range(1).select(shaping.work_bits(F.lit(key.hex()), F.lit(nonce))).first()[0] == bits
