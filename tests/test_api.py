"""The client, tools, plugins, snapshots and digests against plain Python."""

import hashlib
import hmac
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.api import cli, tools
from lodestar.api.client import Client, Retriever, summary_rejection
from lodestar.api.plugins import Plugins, Point
from lodestar.functions import digests, markup, requests, shaping
from lodestar.operators import graph, maintenance, results, search
from lodestar.sources.tables import NOW, documents
from lodestar.streaming import operators as st

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def client(spark):
    return Client(spark, documents(spark, SF), NOW)


def test_client_pages_and_filters(client):
    all_ = [r["doc_id"] for r in client.search("the of", 10).orderBy("rank").collect()]
    assert len(all_) == 10
    docs = {r["doc_id"]: r["lang"] for r in client.docs.select("doc_id", "lang").collect()}
    fr = client.search("de", 10, language="fr").collect()
    assert fr and {docs[r["doc_id"]] for r in fr} == {"fr"}
    path = storage.new_path(client.spark, "index")
    search.build_index(client.docs, path, buckets=7, slices=2)
    indexed = Client(client.spark, client.docs, NOW, index=path)
    for given in ({}, {"language": "fr"}):
        assert [tuple(r) for r in indexed.search("de la", 10, **given).orderBy("rank").collect()] == [tuple(r) for r in client.search("de la", 10, **given).orderBy("rank").collect()]
    assert [d.metadata["doc_id"] for d in Retriever(client, 3).invoke("the of")] == [r["doc_id"] for r in client.search("the of", 3).orderBy("rank").collect()]
    assert [r["rank"] for r in client.search("the of", 3, 5).orderBy("rank").collect()] == [1, 2, 3]


def test_tools_answer_in_json(client):
    t = tools.Tools(client)
    found = json.loads(t.call("web_search", {"query": "the of", "limit": 3}))["results"]
    assert len(found) == 3 and found[0]["rank"] == 1
    url = found[0]["url"]
    assert json.loads(t.call("fetch_page", {"url": url}))["results"][0]["page"].startswith("# ")
    assert "error" in json.loads(t.call("nothing", {})) and "error" in json.loads(t.call("web_search", {})) and "error" in json.loads(t.call("analytics", {}, role="reader"))
    assert json.loads(t.call("fact_check", {"claim": "the of", "top_k": 4}))["verdict"] == "supported"
    assert json.loads(t.call("status", {}))["n_docs"] == 200
    page = {"page_id": 1, "url": "https://new.example/", "html": "<title>N</title><p>words of a new page</p>"}
    assert json.loads(t.call("crawl_url", {"pages": [page, page | {"page_id": 2}]}))["results"] == [{"page_id": 1, "url": page["url"], "outcome": "added"}, {"page_id": 2, "url": page["url"], "outcome": "duplicate"}]
    assert len(json.loads(t.call("batch_search", {"queries": ["the", "de"], "limit": 2}))["results"]) == 4
    assert json.loads(t.call("search_rag", {"query": "the of", "limit": 1, "chunk_size": 50}))["results"]
    assert json.loads(t.call("explain", {"query": "the of", "limit": 1}))["results"][0]["dominant"]
    assert json.loads(t.call("search_history", {}))["history"][0]["tool"] == "explain"
    assert tools.route(t, "/health", {}) == (200, '{"pong": true}') and tools.route(t, "/none", {})[0] == 404
    assert tools.filters_of({"recency_days": 7, "date_from": 1, "domain_allowlist": ["a"], "include_domains": ["b"]}, 1e6) == {"date_from": 1e6 - 604800, "include": ["a"]}


def test_command_line_exports_and_imports(spark, tmp_path, capsys):
    assert json.loads(cli.main([SF, "search", "the of", "--limit", "2"], spark))["results"]
    assert json.loads(cli.main([SF, "export", str(tmp_path / "snap")], spark)) == {"exported": 200}
    assert json.loads(cli.main([SF, "import", str(tmp_path / "snap")], spark)) == {"new": 0}
    assert json.loads(cli.main([SF, "stats"], spark))["n_docs"] == 200 and json.loads(cli.main([SF, "tool", "ping", "{}"], spark)) == {"pong": True}
    with pytest.raises(ValueError, match="version"):
        maintenance.read_snapshot(spark, str(tmp_path / "snap"), version=2)


def test_plugins_filter_skip_failures_and_score(spark, client):
    p = Plugins()
    p.register("none", hooks={Point.POST_CRAWL: lambda df: None})
    assert p.run(Point.POST_CRAWL, spark.range(3)).count() == 0 and p.run(Point.PRE_CRAWL, spark.range(3)).count() == 3 and p.named == {"none": "0.0.1"}
    p.hook(Point.POST_SEARCH)(lambda df: 1 / 0)
    p.hook(Point.CUSTOM_SCORER)(lambda c: c * 10)
    plain, changed = client.search("the of", 1).first(), Client(spark, client.docs, NOW, p).search("the of", 1).first()
    assert changed["combined"] == pytest.approx(10 * plain["combined"])


def test_digests_agree_with_hmac(spark):
    for secret in ("k", "x" * 100):
        assert one(spark, digests.hmac_sha256(F.lit("a message é"), secret)) == hmac.new(secret.encode(), "a message é".encode(), hashlib.sha256).hexdigest()
    token = one(spark, digests.jwt(F.lit('{"sub":"1","exp":200}'), "s"))
    ok = lambda t, s="s", now=100.0: one(spark, digests.jwt_valid(F.lit(t), s, now))
    assert ok(token) and not ok(token, "other") and not ok(token, now=201.0) and not ok(token[:-2]) and not ok("a.b") and not ok("")
    assert ok(one(spark, digests.jwt(F.lit("{}"), "s")))


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    bits, hashes = digests.bloom_size(1000, 0.01)
    assert (bits, hashes) == (9585, 6)
    raw = hashlib.md5(b"abc").digest()
    a, b = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
    assert one(spark, digests.bloom_bits(F.lit("abc"), bits, hashes)) == [(a + i * b) % bits for i in range(hashes)]
    rows = spark.range(3000).select(F.col("id").cast("string").alias("item"), "id")
    got = digests.bloom_seen(rows.filter("id < 1000"), rows, "item", 1000).groupBy((F.col("id") < 1000).alias("known")).agg(F.avg(F.col("seen").cast("int")).alias("p")).collect()
    share = {r["known"]: r["p"] for r in got}
    assert share[True] == 1.0 and share[False] < 0.03


def test_links_resolve_like_the_standard(spark):
    from urllib.parse import urljoin

    base = "https://a.example/x/y/z.html?k=v"
    for link in ("b.html", "../c?d=1", "./", "/root", "//h.example/q", "?p=2", "../../../up", "a/./b/../c", "http://o.example/1"):
        want = urljoin(base, link)
        assert one(spark, graph.resolved(F.lit(link), F.lit(base))) == want, link
    assert one(spark, graph.resolved(F.lit("mailto:a@b.c"), F.lit(base))) is None


def test_look_alikes_keep_the_first():
    rows = pd.DataFrame([(1, 1, "https://a/", "t", "one two three four"), (1, 2, "https://a", "u", "five"), (1, 3, "https://b", "t", "one two three four"), (1, 4, "https://c", "", ""), (1, 5, "https://d", "", "")], columns=["query_id", "rank", "url", "title", "snippet"])
    assert results.look_alikes(rows)["rank"].tolist() == [1, 4, 5]


def test_truncation_breaks_no_character(spark):
    for t in ("ééééé", "日本語テキスト", "a😀b😀c", "", "plain", "é" * 50 + "😀"):
        for n in range(1, 12):
            assert one(spark, shaping.truncated(F.lit(t), n)) == t.encode()[:n].decode("utf-8", "ignore"), (t, n)


def test_robots_and_sanitizing(spark):
    rules = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /a\nAllow: /\n"
    assert [one(spark, markup.forbidden(F.lit(rules), F.lit(p))) for p in ("/a/b", "/b", "/")] == [True, False, False]
    assert [one(spark, requests.sanitized(F.lit(q), "all")) for q in ('"a" AND b*', "((", "x" * 1200)] == ["a b", "all", "x" * 1000]


def test_a_refusal_names_its_first_reason():
    good = {"trust": 0.5, "n_chars": 100, "running": 0, "pending": 0, "idle": 5.0}
    assert summary_rejection(**good) is None
    assert summary_rejection(**good | {"trust": 0.1, "n_chars": 0}) == "untrusted" and summary_rejection(**good | {"idle": 0.1}) == "cooldown" and summary_rejection(**good | {"running": 2}) == "busy"


def test_updates_and_retention(spark):
    docs = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, title string, n int")
    changes = spark.createDataFrame([("u2", None, 5), ("u3", "x", 1)], "url string, title string, n int")
    assert sorted(map(tuple, maintenance.update(docs, changes).collect())) == [("u1", "a", 1), ("u2", "b", 5)]
    assert [r["n"] for r in maintenance.retained(docs, "n", 1, 1, "url").collect()] == [2]
    assert maintenance.migrated(docs, {"n": ("int", 0), "m": ("string", "d")}).columns == ["url", "title", "n", "m"]


def test_settled_tables_are_in_the_shared_folder_and_go(spark):
    df = storage.settle(spark.range(3))
    assert df.count() == 3 and df.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(storage.shared_folder(spark).lstrip("/"))


def test_a_page_of_results_is_bounded(spark):
    assert [r["id"] for r in search.page(spark.range(20), ["id"], 3, 4).collect()] == [4, 5, 6] and search.page(spark.range(20), ["id"], 0).count() == 1


def test_stream_guard_equals_a_plain_loop(spark):
    got = {(r["user_id"], r["event_id"]) for r in st.replayed(st.replay(spark, SF), lambda e: st.admitted(e, 2, 86400.0)).collect()}
    held, want = {}, set()
    for r in spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").collect():
        now = r["ts"].timestamp()
        held[r["user_id"]] = [x for x in held.get(r["user_id"], []) if now - x < 86400]
        if len(held[r["user_id"]]) < 2:
            held[r["user_id"]].append(now)
            want.add((r["user_id"], r["event_id"]))
    assert got == want


def test_a_late_event_is_left_out(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    # The watermark by which rows are late is that of the batch before, so one batch stands between.
    for i, rows in enumerate([[(1, "2024-01-01 00:00:00", 1, "a", 1.0), (2, "2024-01-01 12:00:00", 1, "a", 1.0)], [(5, "2024-01-02 00:00:00", 1, "a", 1.0)], [(3, "2024-01-01 00:30:00", 1, "a", 1.0), (4, "2024-01-05 12:00:00", 1, "a", 1.0)]]):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    assert sorted(r["n"] for r in st.run_to_end(st.hourly_counts(stream)).collect()) == [1, 1, 1]


def test_files_from_outside(spark, tmp_path):
    import gzip

    from lodestar.sources import records

    record = lambda i: f"WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: http://a/{i}\nContent-Type: text/plain\n\n{'word ' * 30}{i}\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wet.gz").write_bytes(gzip.compress((record(1) + record(2)).encode()))
    (tmp_path / "in" / "b.wet").write_text(record(3))
    assert sorted(r["target"] for r in records.wet(spark, str(tmp_path / "in")).collect()) == ["http://a/1", "http://a/2", "http://a/3"]
    assert records.whole_files(spark, str(tmp_path / "in")).count() == 2
    with pytest.raises(ValueError, match="by record"):
        records.whole_files(spark, str(tmp_path / "in"), 10)
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds" / "news.txt").write_text("# c\nhttps://a.example/\nno\n")
    (tmp_path / "seeds" / "tech.txt").write_text("http://b.example\n\n")
    assert sorted(r["url"] for r in records.seeds(spark, str(tmp_path / "seeds")).collect()) == ["http://b.example", "https://a.example/"]
    assert [r["url"] for r in records.seeds(spark, str(tmp_path / "seeds"), "tech").collect()] == ["http://b.example"]
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    assert records.compact(spark, str(tmp_path / "many"), str(tmp_path / "few")) == 1 and spark.read.parquet(str(tmp_path / "few")).count() == 100
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string")
    records.write_warc(pages, str(tmp_path / "out"), "2024-01-31T00:00:00Z")
    assert "Content-Length: 9" in spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0]


def test_vector_store_replaces_known_keys(spark):
    from lodestar.api.client import VectorStore

    store = VectorStore(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    store.add(spark.createDataFrame([(2, [1.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<float>"))
    got = store.search(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, probe array<float>"), 2).orderBy("rank").collect()
    assert store.count() == 3 and [r["doc_id"] for r in got] == [1, 3]


def test_explanations_tell_what_ranked(spark, client):
    rows = client.explain("the of", 5).collect()
    hits = {r["doc_id"]: r["combined"] for r in client.search("the of", 5).collect()}
    assert {r["doc_id"] for r in rows} == set(hits)
    for r in rows:
        assert sum(r[f"w_{n}"] for n in ("bm25", "freshness", "trust", "authority", "title", "url")) == pytest.approx(hits[r["doc_id"]], abs=1e-5)


def test_profiles_and_tokenizers_reach_the_search(spark, client):
    news = Client(spark, client.docs, NOW, profile="news")
    assert news.weights["freshness"] == 0.45 and Client(spark, client.docs, NOW, profile="none").weights == client.weights
    assert [r["combined"] for r in news.search("the of", 3).collect()] != [r["combined"] for r in client.search("the of", 3).collect()]
    p = Plugins()
    p.hook(Point.CUSTOM_TOKENIZER)(lambda c: F.split(F.lower(c), ""))
    letters = Client(spark, client.docs, NOW, p).search("zq", 50)
    assert letters.count() > client.search("zq", 50).count()


def test_cut_answers_say_so(spark, client):
    t = tools.Tools(client)
    t.tool_all = lambda args: spark.range(120).orderBy("id")
    pages = [json.loads(t.call("all", {"page": p})) for p in range(3)]
    assert [len(p["results"]) for p in pages] == [50, 50, 20] and [p.get("next_page") for p in pages] == [1, 2, None]
    assert "at most" in json.loads(t.call("batch_search", {"queries": ["a"] * 11}))["error"]


def test_vectors_are_deleted(spark):
    from lodestar.api.client import VectorStore

    store = VectorStore(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>"))
    for i in range(9):
        store.delete(spark.createDataFrame([(i,)], "vec_id long"))
        store.add(spark.createDataFrame([(i + 10, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert store.count() == 9 and len(store.vectors._jdf.queryExecution().toString()) < 20000
