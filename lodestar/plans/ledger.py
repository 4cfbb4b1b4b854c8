"""Credit ledger queries; events are the action log: views process queries, clicks crawl, purchases run models, signups are uptime, errors spend."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..registry import query
from ..sources.tables import EVENTS_SQL, events

ACTIONS = {"view": "query_process", "click": "crawl", "purchase": "llm_own", "signup": "network_uptime"}
LOG_SQL = f"""{EVENTS_SQL}, log AS (SELECT event_id, peer, ts, value AS quantity, CASE event_type WHEN 'view' THEN 'query_process' WHEN 'click' THEN 'crawl' WHEN 'purchase' THEN 'llm_own' WHEN 'signup' THEN 'network_uptime' END AS action FROM ev WHERE event_type <> 'error'),
cred AS (SELECT *, quantity * CASE action WHEN 'crawl' THEN 1.0::DOUBLE WHEN 'llm_own' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN action = 'llm_own' AND ((floor(ts / 3600)::BIGINT % 24) >= 23 OR (floor(ts / 3600)::BIGINT % 24) < 7) THEN 1.5::DOUBLE ELSE 1 END AS credits FROM log),
spent AS (SELECT peer, event_id, ts, value AS amount FROM ev WHERE event_type = 'error')"""
CONTRIB_SQL = f"""{LOG_SQL}, c0 AS (SELECT peer, sum(CASE WHEN action = 'llm_own' THEN credits ELSE 0 END) AS llm, sum(CASE WHEN action <> 'llm_own' THEN credits ELSE 0 END) AS other FROM cred GROUP BY peer),
contrib AS (SELECT peer, other + CASE WHEN llm + other > 0 AND llm / (llm + other) > 0.6 THEN other * 0.6::DOUBLE / 0.4::DOUBLE ELSE llm END AS score FROM c0)"""


def log(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    e = events(spark, sf_dir).filter("event_type <> 'error'")
    return e.select("event_id", "peer", "ts", F.col("value").alias("quantity"), F.element_at(names, F.col("event_type")).alias("action"))


def spent(spark, sf_dir):
    return events(spark, sf_dir).filter("event_type = 'error'").select("peer", "event_id", "ts", F.col("value").alias("amount"))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("credits_earned", f"WITH {LOG_SQL} SELECT event_id, action, round(credits, 6) AS credits FROM cred")
def credits_earned(spark, sf_dir):
    return ledger.earned(log(spark, sf_dir)).select("event_id", "action", *r6("credits"))


@query("off_peak", f"WITH {EVENTS_SQL} SELECT event_id, (floor(ts / 3600)::BIGINT % 24) >= 23 OR (floor(ts / 3600)::BIGINT % 24) < 7 AS off_peak FROM ev")
def off_peak(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ledger.off_peak(ledger.hour_of(F.col("ts"))).alias("off_peak"))


@query(
    "credit_balance",
    f"""WITH {LOG_SQL}, e AS (SELECT peer, sum(credits) AS earned FROM cred GROUP BY peer), s AS (SELECT peer, sum(amount) AS spent FROM spent GROUP BY peer)
 SELECT peer, round(coalesce(earned, 0), 6) AS earned, round(coalesce(spent, 0), 6) AS spent, round(coalesce(earned, 0) - coalesce(spent, 0), 6) AS balance FROM e FULL JOIN s USING (peer)""",
)
def credit_balance(spark, sf_dir):
    return ledger.balances(ledger.earned(log(spark, sf_dir)), spent(spark, sf_dir)).select("peer", *r6("earned", "spent", "balance"))


@query("earnings_by_action", f"WITH {LOG_SQL} SELECT action, round(sum(credits), 4) AS credits FROM cred GROUP BY action HAVING sum(credits) > 0 ORDER BY credits DESC")
def earnings_by_action(spark, sf_dir):
    return ledger.earned(log(spark, sf_dir)).groupBy("action").agg(F.round(F.sum("credits"), 4).alias("credits")).filter("credits > 0").orderBy(F.desc("credits"))


@query("contribution_score", f"WITH {CONTRIB_SQL} SELECT peer, round(score, 6) AS score FROM contrib")
def contribution_score(spark, sf_dir):
    return ledger.contribution(ledger.earned(log(spark, sf_dir))).select("peer", *r6("score"))


@query("search_cost", f"WITH {CONTRIB_SQL} SELECT peer, CASE WHEN score >= 1000 THEN 0.033::DOUBLE WHEN score >= 100 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS cost FROM contrib")
def search_cost(spark, sf_dir):
    return ledger.contribution(ledger.earned(log(spark, sf_dir))).select("peer", ledger.search_cost(F.col("score")).alias("cost"))


_GRACE_SQL = f"""{LOG_SQL}, mv AS (SELECT peer, event_id, ts, credits AS delta FROM cred UNION ALL SELECT peer, event_id, ts, -3 * amount FROM spent),
b AS (SELECT *, sum(delta) OVER w AS balance FROM mv WINDOW w AS (PARTITION BY peer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
sp AS (SELECT *, sum((balance > 0)::INT) OVER (PARTITION BY peer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM b),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY ts DESC, event_id DESC) AS r FROM sp) WHERE r = 1),
gr AS (SELECT la.peer, la.balance, CASE WHEN la.balance <= 0 THEN (SELECT min(ts) FROM sp WHERE sp.peer = la.peer AND sp.spell = la.spell AND sp.balance <= 0) END AS since, la.ts AS seen FROM la)"""


@query("grace_state", f"WITH {_GRACE_SQL} SELECT peer, round(balance, 6) AS balance, since, CASE WHEN balance > 0 THEN 'normal' WHEN seen - since <= 259200 THEN 'grace' ELSE 'debt' END AS state FROM gr")
def grace_state(spark, sf_dir):
    """Spending counts threefold here, so that some peers fall behind."""
    plus = ledger.earned(log(spark, sf_dir)).select("peer", "event_id", "ts", F.col("credits").alias("delta"))
    moves = plus.unionByName(spent(spark, sf_dir).select("peer", "event_id", "ts", (F.col("amount") * -3).alias("delta")))
    return ledger.grace(moves).select("peer", F.round("balance", 6).alias("balance"), "since", "state")


@query(
    "ledger_stats",
    f"WITH {CONTRIB_SQL} SELECT round((SELECT sum(credits) FROM cred), 4) AS earned, round((SELECT sum(amount) FROM spent), 4) AS spent, round((SELECT sum(credits) FROM cred) - (SELECT sum(amount) FROM spent), 4) AS balance, round((SELECT sum(score) FROM contrib), 4) AS contribution, (SELECT count(*) FROM cred) AS entries",
)
def ledger_stats(spark, sf_dir):
    credited = ledger.earned(log(spark, sf_dir))
    e = credited.agg(F.sum("credits").alias("e"), F.count("*").alias("entries"))
    s = spent(spark, sf_dir).agg(F.sum("amount").alias("s"))
    c = ledger.contribution(credited).agg(F.sum("score").alias("c"))
    one_row = e.crossJoin(s).crossJoin(c)
    return one_row.select(F.round("e", 4).alias("earned"), F.round("s", 4).alias("spent"), F.round(F.col("e") - F.col("s"), 4).alias("balance"), F.round("c", 4).alias("contribution"), "entries")


@query(
    "owner_rollup",
    f"""WITH {CONTRIB_SQL}, m AS (SELECT peer, peer % 10 AS owner, (SELECT max(ts) FROM ev e WHERE e.peer = contrib.peer) AS ts, score FROM contrib),
 k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, peer) AS r FROM m WHERE ts >= (SELECT max(ts) FROM ev) - 259200) SELECT owner, count(*) AS peers, round(sum(score), 6) AS score FROM k WHERE r <= 20 GROUP BY owner""",
)
def owner_rollup(spark, sf_dir):
    """Scores of the 20 newest peers of each owner (peer modulo 10) seen within 72 hours of the last event."""
    from pyspark.sql import Window

    ev = events(spark, sf_dir)
    seen = ev.groupBy("peer").agg(F.max("ts").alias("ts"))
    rows = ledger.contribution(ledger.earned(log(spark, sf_dir))).join(seen, "peer").join(F.broadcast(ev.agg(F.max("ts").alias("end")))).filter("ts >= end - 259200")
    rows = rows.withColumn("owner", F.pmod("peer", F.lit(10))).withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), "peer"))).filter("r <= 20")
    return rows.groupBy("owner").agg(F.count("*").alias("peers"), F.round(F.sum("score"), 6).alias("score"))
