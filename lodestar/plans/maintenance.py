"""Changes of the collection, logs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, EVENTS_SQL, NOW, documents, events, table

_CHANGED = "changes AS (SELECT 'https://' || source || '/' || doc_id AS url, CASE WHEN quality = 1 THEN 'good ' || doc_id END AS title, CASE WHEN toxic = 1 THEN 'xx' END AS lang FROM labels JOIN documents USING (doc_id))"


@query("update_documents", f"WITH {DOCUMENTS_SQL}, {_CHANGED} SELECT doc_id, url, coalesce(c.title, docs.title) AS title, coalesce(c.lang, docs.lang) AS lang FROM docs LEFT JOIN changes c USING (url)")
def update_documents(spark, sf_dir):
    """Only fields that a change names are written; labels stand for changes."""
    docs = documents(spark, sf_dir).select("doc_id", "url", "title", "lang")
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id", "url"), "doc_id")
    changes = labels.select("url", F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("toxic") == 1, "xx").alias("lang"))
    return m.update(docs, changes)


@query("delete_documents", f"WITH {DOCUMENTS_SQL} SELECT doc_id, url FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "url")
    return m.delete(docs, docs.join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi"))


_BATCH_SQL = """batch AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'https://same/' || page_id // 20 ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'text ' || page_id % 3 ELSE html END AS text FROM pages),
hashed AS (SELECT *, sha256(text) AS text_hash FROM batch), known AS (SELECT url, sha256(html) AS text_hash FROM pages WHERE page_id % 13 = 0),
fresh AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i, row_number() OVER (PARTITION BY text_hash ORDER BY page_id) AS j FROM hashed WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM known) AND text_hash NOT IN (SELECT text_hash FROM known)),
outcome AS (SELECT page_id, CASE WHEN i > 1 OR j > 1 THEN 'duplicate' ELSE 'added' END AS outcome FROM fresh UNION ALL SELECT page_id, CASE WHEN url IS NULL THEN 'failed' ELSE 'duplicate' END FROM hashed WHERE page_id NOT IN (SELECT page_id FROM fresh))"""


def _ingested(spark, sf_dir):
    """A batch made from all pages, with missing and repeated addresses and texts, against a collection of some of them."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    url = F.when(i % 11 == 0, None).when(i % 5 == 0, F.concat(F.lit("https://same/"), F.floor(i / 20).cast("string"))).otherwise(F.col("url"))
    batch = p.select("page_id", url.alias("url"), F.when(i % 7 == 0, F.concat(F.lit("text "), (i % 3).cast("string"))).otherwise(F.col("html")).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    return m.ingested(batch, p.filter(i % 13 == 0).select("url", F.sha2("html", 256).alias("text_hash")), "page_id")


@query("batch_ingest", f"WITH {_BATCH_SQL} SELECT page_id, outcome FROM outcome")
def batch_ingest(spark, sf_dir):
    return _ingested(spark, sf_dir).select("page_id", "outcome")


@query("batch_ingest_counts", f"WITH {_BATCH_SQL} SELECT count(*) AS total, count(*) FILTER (outcome <> 'failed') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed FROM outcome")
def batch_ingest_counts(spark, sf_dir):
    failed = F.count_if(F.col("outcome") == "failed")
    return _ingested(spark, sf_dir).agg(F.count("*").alias("total"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"))


@query("schema_migration", "SELECT doc_id, lang, NULL::VARCHAR AS etag, 0 AS stale_count, 0.0::DOUBLE AS change_frequency FROM documents")
def schema_migration(spark, sf_dir):
    """Documents with the recrawl columns of a later version, at their defaults."""
    return m.migrated(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"lang": ("string", "en"), "etag": ("string", None), "stale_count": ("int", 0), "change_frequency": ("double", 0.0)})


@query("snapshot_import", f"WITH {DOCUMENTS_SQL}, have AS (SELECT url, sha256(text) AS h FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id, url FROM docs WHERE url NOT IN (SELECT url FROM have) AND sha256(text) NOT IN (SELECT h FROM have)")
def snapshot_import(spark, sf_dir):
    """What a snapshot of all documents adds to a collection of the labelled ones."""
    docs = documents(spark, sf_dir).select("doc_id", "url", F.sha2("text", 256).alias("text_hash"))
    return m.imported(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), docs).select("doc_id", "url")


_LISTED = Literal("lines", "value string", (("# seeds",), ("",), ("https://a.example/",), ("  https://b.example/x  ",), ("ftp://c.example/",), ("https://a.example/",), ("http://d.example#y",), ("no address",), ("#https://e.example/",)))


@query("url_list", f"WITH {_LISTED.sql} SELECT DISTINCT trim(value) AS url FROM lines WHERE regexp_matches(trim(value), '^https?://') AND trim(value) NOT IN (SELECT url FROM pages)")
def url_list(spark, sf_dir):
    """Addresses of a list that no page has yet; seed files are such lists."""
    found = m.addresses(_LISTED.frame(spark))
    return found.join(table(spark, sf_dir, "pages").select("url").distinct(), "url", "left_anti")


@query("prune_events", f"WITH {EVENTS_SQL} SELECT event_id, peer FROM ev WHERE ts >= {NOW} - 20 * 86400 ORDER BY ts DESC, event_id LIMIT 200")
def prune_events(spark, sf_dir):
    """Retention by age, then by number: the newest 200 of the last 20 days."""
    return m.retained(events(spark, sf_dir), "ts", NOW - 20 * 86400, 200, "event_id").select("event_id", "peer")


@query("prune_peers", f"WITH {EVENTS_SQL}, p AS (SELECT peer, max(ts) AS last_seen FROM ev GROUP BY peer) SELECT peer, last_seen FROM p WHERE last_seen >= {NOW} - 168 * 3600 ORDER BY last_seen DESC, peer LIMIT 100")
def prune_peers(spark, sf_dir):
    peers = events(spark, sf_dir).groupBy("peer").agg(F.max("ts").alias("last_seen"))
    return m.retained(peers, "last_seen", NOW - 168 * 3600, 100, "peer")


_CALLS = Literal("calls", "id long, tool string, api_key string, args string", ((1, "search", "k1", '{"query":"x","api_key":"k1"}'), (2, "fetch_page", "", '{"url":"https://a.example/","password":"p"}'), (3, "status", None, "{}"), (4, "search", "k2", None)))


@query("audit_log", f"WITH {_CALLS.sql} SELECT id, tool, CASE WHEN api_key <> '' THEN substr(sha256(api_key), 1, 16) END AS key_hash, CASE id WHEN 1 THEN '{{\"query\":\"x\"}}' WHEN 2 THEN '{{\"url\":\"https://a.example/\"}}' END AS arguments FROM calls UNION ALL SELECT -event_id - 1, event_type, CASE WHEN user_id % 3 > 0 THEN substr(sha256('k' || user_id), 1, 16) END, '{{\"query\":\"q' || event_id || '\"}}' FROM events")
def audit_log(spark, sf_dir):
    """What is written down of calls: some of every kind, and one an event, whose user has a key or none."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("k"), F.col("user_id").cast("string")))
    args = F.format_string('{"query":"q%d","api_key":"%s"}', F.col("event_id"), F.coalesce(key, F.lit("")))
    calls = _CALLS.frame(spark).unionByName(e.select((-F.col("event_id") - 1).alias("id"), F.col("event_type").alias("tool"), key.alias("api_key"), args.alias("args")))
    return calls.select("id", *[c.alias(n) for n, c in m.audit_line(F.col("tool"), F.col("api_key"), F.col("args")).items()])


@query(
    "metrics_exposition",
    f"""WITH {EVENTS_SQL}, t AS (SELECT event_type AS n, count(*) AS c, sum(value) AS s FROM ev GROUP BY event_type), x AS (SELECT 'events.' || n AS name, 'counter' AS kind, c::DOUBLE AS v, c, replace('events.' || n, '.', '_') AS safe FROM t UNION ALL SELECT 'value-' || n, 'summary', s, c, 'value_' || n FROM t)
 SELECT name, kind, 0 AS pos, '# TYPE ' || safe || ' ' || kind AS line FROM x UNION ALL SELECT name, kind, 1, CASE kind WHEN 'counter' THEN format('{{}} {{:.3f}}', safe, v) ELSE format('{{}}_count {{}}', safe, c) END FROM x
 UNION ALL SELECT name, kind, 2, format('{{}}_sum {{:.3f}}', safe, v) FROM x WHERE kind = 'summary' UNION ALL SELECT name, kind, 3, format('{{}}_avg {{:.3f}}', safe, v / c) FROM x WHERE kind = 'summary'""",
)
def metrics_exposition(spark, sf_dir):
    t = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    counters = t.select(F.concat(F.lit("events."), "event_type").alias("name"), F.lit("counter").alias("kind"), F.col("n").cast("double").alias("value"), "n")
    return m.exposition(counters.unionByName(t.select(F.concat(F.lit("value-"), "event_type").alias("name"), F.lit("summary").alias("kind"), F.col("total").alias("value"), "n")))
