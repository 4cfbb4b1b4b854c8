"""Streaming queries replayed over the event file; their results equal the batch rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.segments import Index
from ..registry import query
from ..sources.tables import EVENTS_SQL, NOW, documents, queries
from ..storage import new_path, settle
from ..streaming import operators as st
from ..streaming import state, submissions
from .dedup import SIMHASH_SQL
from .search import BM25_SQL
from .trust import PARTITION_SQL


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    return st.replayed(st.replay(spark, sf_dir), st.hourly_counts)


@query("stream_bursts", "WITH m AS (SELECT user_id, unnest(range(0, 5)) AS k, ts FROM events) SELECT date_trunc('minute', ts) - to_minutes(k::INT) AS start, user_id, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 2")
def stream_bursts(spark, sf_dir):
    return st.replayed(st.replay(spark, sf_dir), st.bursts)


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w > INTERVAL 1 HOUR, false))::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, id",
)
def stream_sessions(spark, sf_dir):
    return st.replayed(st.replay(spark, sf_dir), st.sessions)


@query("stream_unseen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_unseen(spark, sf_dir):
    """Keys that pass as first seen; a key passes again once the watermark has left it behind, so each is told once here."""
    out = st.replayed(st.replay(spark, sf_dir), lambda e: st.unseen(e, ["user_id", "event_type"]))
    return out.select("user_id", "event_type").distinct().withColumn("n", F.lit(1).cast("long"))


@query("stream_ema", "SELECT user_id, n, round(pow(0.7::DOUBLE, n) * 0.5::DOUBLE + sum(0.3::DOUBLE * pow(0.7::DOUBLE, n - i) * v), 6) AS ema FROM (SELECT user_id, least(value / 100.0, 1.0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id, n")
def stream_ema(spark, sf_dir):
    """The last update of each user."""
    out = st.replayed(st.replay(spark, sf_dir), st.running_ema)
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("ema", "n"), 6).alias("ema"))


_AUDITS = "au AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'click')), ru AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM au), rl AS (SELECT user_id, run, sum(bad::INT) AS l FROM ru GROUP BY ALL)"


@query("stream_failures", f"WITH {_AUDITS} SELECT user_id, max(l)::BIGINT AS worst, max(l) >= 3 AS isolated FROM rl GROUP BY user_id")
def stream_failures(spark, sf_dir):
    """Longest run of failed audits of each user, and whether it isolates the user."""
    out = st.replayed(st.replay(spark, sf_dir), st.failures_in_a_row)
    return out.groupBy("user_id").agg(F.max("worst").alias("worst")).withColumn("isolated", F.col("worst") >= 3)


def _admitted_sql(most: int, seconds: float) -> str:
    inside = f"len(list_filter(acc, lambda x: t - x < {seconds}))"
    times = f"list_reduce(list(epoch_us(ts) / 1e6 ORDER BY ts, event_id), lambda acc, t: CASE WHEN {inside} < {most} THEN list_append(acc, t) ELSE acc END, []::DOUBLE[])"
    return f"SELECT user_id, len({times})::BIGINT AS n FROM events GROUP BY user_id"


@query("stream_load_guard", _admitted_sql(2, 86400.0))
def stream_load_guard(spark, sf_dir):
    """Events let through by a guard of two a user and trailing day."""
    out = st.replayed(st.replay(spark, sf_dir), lambda e: st.admitted(e, 2, 86400.0))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_locks", _admitted_sql(1, 300.0))
def stream_locks(spark, sf_dir):
    """Acquisitions of a lock that lives for five minutes; users stand for its keys."""
    out = st.replayed(st.replay(spark, sf_dir), lambda e: st.admitted(e, 1, 300.0))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_summaries", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS most FROM events GROUP BY ALL")
def stream_summaries(spark, sf_dir):
    """Daily metrics of each kind of event."""
    return st.replayed(st.replay(spark, sf_dir), st.summaries).withColumn("total", F.round("total", 6))


@query("stream_submissions", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT doc_id FROM labels) AND event_type = 'purchase' GROUP BY user_id")
def stream_submissions(spark, sf_dir):
    """Submissions of the peers that an access list allows: a stream joined with a table; labelled ids stand for the list."""
    allowed = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("user_id")).distinct()
    return st.replayed(st.replay(spark, sf_dir), lambda e: e.filter("event_type = 'purchase'").join(allowed, "user_id", "left_semi")).groupBy("user_id").agg(F.count("*").alias("n"))


_KEPT = "list_reduce(list({'t': epoch_us(ts) / 1e6, 'hits': 0::BIGINT} ORDER BY ts, event_id), lambda a, x: CASE WHEN x.t - a.t < 43200 THEN {'t': a.t, 'hits': a.hits + 1} ELSE {'t': x.t, 'hits': a.hits} END, {'t': -1e12::DOUBLE, 'hits': 0::BIGINT}).hits"


@query("stream_cache", f"SELECT user_id, count(*) AS n, {_KEPT} AS hits FROM events GROUP BY user_id")
def stream_cache(spark, sf_dir):
    """Hits of a cache whose entries live half a day from when they were made; users stand for its keys."""
    out = st.replayed(st.replay(spark, sf_dir), lambda e: st.cached(e, 43200.0))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("hits").alias("hits"))


_BUCKET = "list_reduce(list({'t': epoch_us(ts) / 1e6, 'v': value::DOUBLE, 'level': 0.0::DOUBLE, 'ok': 0::BIGINT} ORDER BY ts, event_id), lambda a, x: CASE WHEN least(100.0::DOUBLE, a.level + greatest(0.0::DOUBLE, x.t - a.t) * 0.001::DOUBLE) >= x.v THEN {'t': x.t, 'v': x.v, 'level': least(100.0::DOUBLE, a.level + greatest(0.0::DOUBLE, x.t - a.t) * 0.001::DOUBLE) - x.v, 'ok': a.ok + 1} ELSE {'t': x.t, 'v': x.v, 'level': least(100.0::DOUBLE, a.level + greatest(0.0::DOUBLE, x.t - a.t) * 0.001::DOUBLE), 'ok': a.ok} END, {'t': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'level': 100.0::DOUBLE, 'ok': 0::BIGINT}).ok"


@query("stream_bandwidth", f"SELECT user_id, count(*) AS n, {_BUCKET} AS allowed FROM events GROUP BY user_id")
def stream_bandwidth(spark, sf_dir):
    """Transfers (their values) that a bucket of 100 tokens, refilled by one each 1000 seconds, lets through."""
    out = st.replayed(st.replay(spark, sf_dir), lambda e: st.bucket(e, 100.0, 0.001))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("allowed").alias("allowed"))


_CRAWLED = f"cr AS (SELECT doc_id, simhash, {NOW}::DOUBLE - doc_id * 3600.0::DOUBLE AS t FROM simhash)"


@query("stream_near_seen", f"WITH {SIMHASH_SQL}, {_CRAWLED} SELECT a.doc_id, min(bit_count(xor(a.simhash, b.simhash)))::INT AS distance FROM cr a JOIN cr b ON b.t < a.t AND a.t - b.t < {state.REMEMBERED * 3600} AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY a.doc_id")
def stream_near_seen(spark, sf_dir):
    """Documents that resemble one crawled in the thirty days before; the crawl is restarted between steps."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.timestamp_seconds("crawled_at").alias("ts"))
    return st.replayed(docs, state.near_seen).groupBy("doc_id").agg(F.min("distance").alias("distance"))


@query("stream_lru")
def stream_lru(spark, sf_dir):
    """Sixteen nodes keep the sessions of five users each for a day, the least recent ones going first."""
    rows = st.replay(spark, sf_dir).withColumn("node", F.pmod("user_id", F.lit(16)).cast("string"))
    out = st.replayed(rows, lambda e: state.lru(e, "node", "user_id", 5, 86400.0))
    return out.groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "hits", "expired", "evicted")])


_RANKS = (0.5, 0.95, 0.99)


@query("stream_quantiles", "SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, true AS within FROM events GROUP BY ALL UNION ALL SELECT NULL, event_type, count(value), true FROM events GROUP BY event_type")
def stream_quantiles(spark, sf_dir):
    """Median, 95th and 99th percentile of each day and kind by sketches, and of all days by their merge: whether each is within two hundredths of its rank.

    The sketches come from the stream; exact ranks are counted beside them from the events.
    """
    days = settle(st.replayed(st.replay(spark, sf_dir), state.quantile_sketches))
    whole = days.groupBy("event_type").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(state.SKETCH)).alias("sketch")).withColumn("start", F.lit(None).cast("timestamp"))
    told = days.unionByName(whole).withColumn("q", state.quantiles(F.col("sketch"), _RANKS)).drop("sketch")
    values = st.replay(spark, sf_dir).select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type", "value")
    values = values.unionByName(values.withColumn("start", F.lit(None).cast("timestamp")))
    both = told.alias("a").join(values.alias("v"), F.col("a.start").eqNullSafe(F.col("v.start")) & F.col("a.event_type").eqNullSafe(F.col("v.event_type")))
    below = [F.count_if(F.col("value") < F.col("q")[i]) for i in range(len(_RANKS))]
    upto = [F.count_if(F.col("value") <= F.col("q")[i]) for i in range(len(_RANKS))]
    near = [(b <= (r + 0.02) * F.first("n")) & (u >= (r - 0.02) * F.first("n")) for r, b, u in zip(_RANKS, below, upto, strict=True)]
    return both.groupBy(F.col("a.start").alias("start"), F.col("a.event_type").alias("event_type")).agg(F.first("n").alias("n"), (near[0] & near[1] & near[2]).alias("within"))


@query("stream_peer_drops", PARTITION_SQL)
def stream_peer_drops(spark, sf_dir):
    """partition_alert as two streams: the second reads what the first has written."""
    return st.replayed(st.replay(spark, sf_dir), state.hourly_peers, then=state.drop_alerts)


@query(
    "stream_flapping",
    "WITH c AS (SELECT event_id, user_id, ts, (coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false))::INT AS changed FROM events), t AS (SELECT *, sum(changed) OVER w - first_value(changed) OVER w AS changes FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)) SELECT event_id, user_id, changes::BIGINT AS changes, changes >= 3 AS suspicious FROM t",
)
def stream_flapping(spark, sf_dir):
    """Changes of the claimed zone, here the event type, in the day up to each claim."""
    return st.replayed(st.replay(spark, sf_dir), state.flapping)


@query("stream_reformulations", f"WITH {EVENTS_SQL}, q AS (SELECT event_id, ts - lag(ts) OVER (PARTITION BY peer ORDER BY ts, event_id) AS gap FROM ev WHERE event_type = 'view') SELECT event_id, round(gap, 3) AS gap FROM q WHERE gap <= 3600")
def stream_reformulations(spark, sf_dir):
    """Views of a user within an hour of the one before, as few are within a minute."""
    return st.replayed(st.replay(spark, sf_dir), lambda e: state.reformulations(e, "view", 3600.0)).select("event_id", F.round("gap", 3).alias("gap"))


@query("stream_lock_release")
def stream_lock_release(spark, sf_dir):
    """Outcomes of requests for sixteen locks of an hour; purchases release them."""
    rows = st.replay(spark, sf_dir).withColumn("lock", F.pmod("event_id", F.lit(16)))
    return st.replayed(rows, lambda e: state.locks(e, "lock", "user_id", F.col("event_type") == "purchase", 3600.0))


@query("stream_audit_files")
def stream_audit_files(spark, sf_dir):
    """The audit log files of sixteen nodes, which end after about 4000 bytes."""
    rows = st.replay(spark, sf_dir).withColumn("node", F.pmod("user_id", F.lit(16)))
    line = F.format_string('{"ts": %s, "action": "%s", "client": %d}', F.unix_micros("ts").cast("string"), F.col("event_type"), F.col("user_id"))
    return st.replayed(rows, lambda e: state.log_files(e, "node", line, 4000))


_SECRET = "a secret of crawlers"
_SENT = """sent AS (SELECT doc_id, text, CASE WHEN doc_id % 20 = 3 THEN 'peer_not_allowed' WHEN text IS NULL THEN 'incomplete' WHEN strlen(text) > 20000 THEN 'too_large' WHEN doc_id % 13 = 5 THEN 'wrong_digest' WHEN doc_id % 11 = 7 THEN 'wrong_signature' ELSE 'accepted' END AS outcome FROM documents)"""


def _sent(spark, sf_dir):
    """All documents as messages of twenty peers, of which one is on no list; some have a wrong digest or a wrong signature."""
    docs = documents(spark, sf_dir).select("doc_id", "url", "title", "text", (F.col("doc_id") % 20).alias("peer"), F.timestamp_seconds("crawled_at").alias("ts"))
    docs = docs.withColumn("text_hash", F.when(F.col("doc_id") % 13 == 5, F.sha2("title", 224)).otherwise(F.sha2("text", 256)))
    return docs.withColumn("signature", submissions.signed(_SECRET + "!", F.col("url"), F.col("text_hash"))).withColumn("signature", F.when(F.col("doc_id") % 11 == 7, F.col("signature")).otherwise(submissions.signed(_SECRET)))


def _received(spark, sf_dir, each=None):
    allowed = spark.range(20).select(F.col("id").alias("peer")).filter("peer <> 3")
    return st.replayed(_sent(spark, sf_dir), lambda e: submissions.checked(e.filter(~st.closing(e)), allowed, _SECRET, 20000), each=each)


@query("stream_received", f"WITH {_SENT} SELECT doc_id, outcome FROM sent")
def stream_received(spark, sf_dir):
    """What becomes of each page that crawlers send."""
    return _received(spark, sf_dir).select("doc_id", "outcome")


@query("stream_received_search", f"WITH {_SENT}, " + BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM sent WHERE outcome = 'accepted'))") + " SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def stream_received_search(spark, sf_dir):
    """BM25 over an index that a stream of submissions has filled, a segment for each micro-batch."""
    index = Index(spark, new_path(spark, "received"), buckets=16, slices=2)
    _received(spark, sf_dir, submissions.into(index))
    return index.bm25(queries(spark, sf_dir)).withColumn("score", F.round("score", 6))
