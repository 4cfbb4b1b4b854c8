"""Trust, audits, anomalies, feedback and service levels over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger, trust
from ..registry import query
from ..sources.tables import EVENTS_SQL, events
from .ledger import CONTRIB_SQL, log, r6

#: Seconds at which the event log ends, to the minute above.
END = 1706659080.0


def audits(spark, sf_dir):
    """Every error is a failed audit of its peer, every click a passed one."""
    return events(spark, sf_dir).filter("event_type in ('error', 'click')").select("peer", "event_id", "ts", (F.col("event_type") == "click").alias("passed"))


TRUST_SQL = f"""{CONTRIB_SQL}, au AS (SELECT peer, avg((event_type = 'click')::INT) AS rate FROM ev WHERE event_type IN ('error', 'click') GROUP BY peer),
up AS (SELECT peer, (max(ts) - min(ts)) / 3600 AS uptime FROM ev GROUP BY peer), sm AS (SELECT peer, avg(least(value / 100.0, 1.0)) AS summary FROM ev WHERE event_type = 'purchase' GROUP BY peer),
tr AS (SELECT peer, round(0.15::DOUBLE * least(uptime / 720.0, 1.0) + 0.25::DOUBLE * least(coalesce(score, 0) / 5000.0, 1.0) + 0.4::DOUBLE * coalesce(rate, 0.5) + 0.2::DOUBLE * coalesce(summary, 0.5), 6) AS trust
 FROM up LEFT JOIN contrib USING (peer) LEFT JOIN au USING (peer) LEFT JOIN sm USING (peer))"""


def trust_of(spark, sf_dir):
    ev = events(spark, sf_dir)
    up = ev.groupBy("peer").agg(
        ((F.max("ts") - F.min("ts")) / 3600).alias("uptime"),
        F.avg(F.when(F.col("event_type").isin("error", "click"), (F.col("event_type") == "click").cast("int"))).alias("rate"),
        F.avg(F.when(F.col("event_type") == "purchase", F.least(F.col("value") / 100.0, F.lit(1.0)))).alias("summary"),
    )
    rows = up.join(ledger.contribution(ledger.earned(log(spark, sf_dir))), "peer", "left")
    return rows.select("peer", F.round(trust.trust_score(F.col("uptime"), F.coalesce("score", F.lit(0.0)), F.col("rate"), F.col("summary")), 6).alias("trust"))


@query("trust_score", f"WITH {TRUST_SQL} SELECT peer, trust, CASE WHEN trust >= 0.8 THEN 'trusted' WHEN trust >= 0.5 THEN 'normal' WHEN trust >= 0.3 THEN 'suspect' ELSE 'untrusted' END AS tier FROM tr")
def trust_score(spark, sf_dir):
    return trust_of(spark, sf_dir).withColumn("tier", trust.trust_tier(F.col("trust")))


@query("trust_grade", f"WITH {TRUST_SQL} SELECT peer, CASE WHEN trust >= 0.9 THEN 'A+' WHEN trust >= 0.8 THEN 'A' WHEN trust >= 0.65 THEN 'B' WHEN trust >= 0.5 THEN 'C' WHEN trust >= 0.3 THEN 'D' ELSE 'F' END AS grade FROM tr")
def trust_grade(spark, sf_dir):
    return trust_of(spark, sf_dir).select("peer", trust.trust_grade(F.col("trust")).alias("grade"))


_TRAIL = "count(*) OVER (PARTITION BY {} ORDER BY round(ts * 1000000)::BIGINT RANGE BETWEEN {}000000 PRECEDING AND CURRENT ROW)"
_LIMIT = {"click": 120, "view": 300, "purchase": 60, "signup": 60}


@query(
    "rate_limited",
    f"WITH {EVENTS_SQL}, c AS (SELECT event_id, event_type, {_TRAIL.format('peer, event_type', 3600)} AS in_hour FROM ev) SELECT event_id, in_hour, in_hour > CASE event_type WHEN 'click' THEN 120 WHEN 'view' THEN 300 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 60 ELSE 120 END AS limited FROM c",
)
def rate_limited(spark, sf_dir):
    limit = F.lit(120)
    for name, n in _LIMIT.items():
        limit = F.when(F.col("event_type") == name, n).otherwise(limit)
    rows = trust.trailing(events(spark, sf_dir), ["peer", "event_type"], 3600.0)
    return rows.select("event_id", F.col("in_window").alias("in_hour"), (F.col("in_window") > limit).alias("limited"))


@query("burst", f"WITH {EVENTS_SQL}, c AS (SELECT peer, {_TRAIL.format('peer', 300)} AS n FROM ev) SELECT peer, max(n) AS most, max(n) >= 30 AS burst FROM c GROUP BY peer")
def burst(spark, sf_dir):
    rows = trust.trailing(events(spark, sf_dir), ["peer"], trust.BURST_SECONDS).groupBy("peer").agg(F.max("in_window").alias("most"))
    return rows.withColumn("burst", F.col("most") >= trust.BURST_COUNT)


_CV_SQL = """g AS (SELECT peer, ts - lag(ts) OVER (PARTITION BY peer ORDER BY ts, event_id) AS gap FROM ev), cv AS (SELECT peer, count(*) AS n, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END AS cv FROM g GROUP BY peer HAVING count(*) >= 10)"""


@query("interval_cv", f"WITH {EVENTS_SQL}, {_CV_SQL} SELECT peer, n, round(cv, 6) AS cv, coalesce(cv < 0.15, true) AS regular FROM cv")
def interval_cv(spark, sf_dir):
    return trust.interval_cv(events(spark, sf_dir))


_RUNS_SQL = """runs AS (SELECT peer, run, sum((NOT passed)::INT) AS failures FROM (SELECT peer, event_type = 'click' AS passed, sum((event_type = 'click')::INT) OVER (PARTITION BY peer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev WHERE event_type IN ('error', 'click')) GROUP BY ALL),
iso AS (SELECT peer, max(failures) AS worst, max(failures) >= 3 AS isolated FROM runs GROUP BY peer)"""


@query("isolation", f"WITH {EVENTS_SQL}, {_RUNS_SQL} SELECT * FROM iso")
def isolation(spark, sf_dir):
    return trust.isolation(audits(spark, sf_dir))


@query(
    "threat_level",
    f"""WITH {TRUST_SQL}, {_RUNS_SQL}, {_CV_SQL}, w AS (SELECT peer, trust, coalesce(isolated, false) AS isolated, (coalesce(worst, 0) >= 2)::INT + (coalesce(cv.cv < 0.15, false))::INT + (trust < 0.5)::INT AS weak FROM tr LEFT JOIN iso USING (peer) LEFT JOIN cv USING (peer))
 SELECT peer, CASE WHEN isolated THEN 'isolated' WHEN trust < 0.3 THEN 'high' WHEN weak >= 2 THEN 'medium' WHEN weak = 1 THEN 'low' ELSE 'none' END AS level, weak FROM w""",
)
def threat_level(spark, sf_dir):
    """Isolated, untrusted, then two weak signals or one: failures in a row, too regular intervals, low trust."""
    rows = trust_of(spark, sf_dir).join(trust.isolation(audits(spark, sf_dir)), "peer", "left").join(trust.interval_cv(events(spark, sf_dir)), "peer", "left")
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    weak = on(F.col("worst") >= 2) + on(F.col("cv") < trust.LEAST_CV) + on(F.col("trust") < 0.5)
    level = F.when(F.coalesce("isolated", F.lit(False)), "isolated").when(F.col("trust") < 0.3, "high").when(weak >= 2, "medium").when(weak == 1, "low").otherwise("none")
    return rows.select("peer", level.alias("level"), weak.alias("weak"))


_EMA_SQL = "SELECT peer, n, pow(0.7::DOUBLE, n) * 0.5::DOUBLE + sum(0.3::DOUBLE * pow(0.7::DOUBLE, n - i) * v) AS e FROM (SELECT peer, least(value / 100.0, 1.0) AS v, row_number() OVER (PARTITION BY peer ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY peer) AS n FROM ev WHERE event_type = 'purchase') GROUP BY peer, n"


def _ratings(spark, sf_dir):
    return events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("v", F.least(F.col("value") / 100.0, F.lit(1.0)))


@query("ema", f"WITH {EVENTS_SQL}, x AS ({_EMA_SQL}) SELECT peer, n, round(e, 6) AS ema FROM x")
def ema(spark, sf_dir):
    return trust.ema(_ratings(spark, sf_dir), "peer", "v", ["ts", "event_id"]).select("peer", "n", F.round("result", 6).alias("ema"))


@query(
    "reputation",
    f"""WITH {EVENTS_SQL}, x AS ({_EMA_SQL}), a AS (SELECT peer, avg(least(value / 100.0, 1.0)) AS average, avg(CASE WHEN ts >= {END} - 604800 THEN least(value / 100.0, 1.0) END) AS recent FROM ev WHERE event_type = 'purchase' GROUP BY peer)
 SELECT peer, n, round(average, 9) AS average, round(recent, 9) AS recent, round(e, 6) AS ema, CASE WHEN n < 5 THEN 'unknown' WHEN round(e, 6) >= 0.8 THEN 'excellent' WHEN round(e, 6) >= 0.6 THEN 'good' WHEN round(e, 6) >= 0.4 THEN 'fair' ELSE 'poor' END AS grade FROM x JOIN a USING (peer)""",
)
def reputation(spark, sf_dir):
    r = _ratings(spark, sf_dir)
    means = r.groupBy("peer").agg(F.avg("v").alias("average"), F.avg(F.when(F.col("ts") >= END - 604800, F.col("v"))).alias("recent"))
    rows = trust.ema(r, "peer", "v", ["ts", "event_id"]).withColumnRenamed("result", "ema").join(means, "peer").select("peer", "n", F.round("average", 9).alias("average"), F.round("recent", 9).alias("recent"), *r6("ema"))
    e = F.col("ema")
    return rows.withColumn("grade", F.when(F.col("n") < 5, "unknown").when(e >= 0.8, "excellent").when(e >= 0.6, "good").when(e >= 0.4, "fair").otherwise("poor"))


@query(
    "url_boosts",
    f"""WITH {EVENTS_SQL}, d AS (SELECT peer, CASE event_type WHEN 'view' THEN 1.0 WHEN 'error' THEN -0.3 ELSE 2.0 END AS v, count(*) OVER (PARTITION BY peer) - row_number() OVER (PARTITION BY peer ORDER BY ts, event_id) AS ago FROM ev WHERE event_type IN ('view', 'error', 'purchase'))
 SELECT peer AS url_id, round(sum(v * pow(0.95::DOUBLE, ago)), 6) AS boost FROM d GROUP BY peer""",
)
def url_boosts(spark, sf_dir):
    """Decayed sum of feedback on a result (here the user's page): views fetch, errors skip, purchases cite."""
    kind = F.when(F.col("event_type") == "view", trust.BOOST["fetch"]).when(F.col("event_type") == "error", trust.BOOST["skip"]).otherwise(trust.BOOST["cite"])
    rows = events(spark, sf_dir).filter("event_type in ('view', 'error', 'purchase')").withColumn("v", kind)
    return trust.decayed(rows, "peer", "v", ["ts", "event_id"], trust.BOOST_DECAY).select(F.col("peer").alias("url_id"), F.round("total", 6).alias("boost"))


@query("top_boosted", f"WITH {EVENTS_SQL}, d AS (SELECT peer, CASE event_type WHEN 'view' THEN 1.0 WHEN 'error' THEN -0.3 ELSE 2.0 END AS v, count(*) OVER (PARTITION BY peer) - row_number() OVER (PARTITION BY peer ORDER BY ts, event_id) AS ago FROM ev WHERE event_type IN ('view', 'error', 'purchase')), b AS (SELECT peer AS url_id, round(sum(v * pow(0.95::DOUBLE, ago)), 6) AS boost FROM d GROUP BY peer) SELECT * FROM b WHERE boost > 0 ORDER BY boost DESC, url_id LIMIT 50")
def top_boosted(spark, sf_dir):
    return url_boosts(spark, sf_dir).filter("boost > 0").orderBy(F.desc("boost"), "url_id").limit(50)


@query("search_analytics", f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS n, round(avg(value), 1) AS avg_latency FROM ev GROUP BY event_type")
def search_analytics(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("avg_latency"))


@query("slo_p99", f"WITH {EVENTS_SQL}, s AS (SELECT event_type, list_sort(list(value)) AS v FROM ev GROUP BY event_type) SELECT event_type, v[least((len(v) * 0.99::DOUBLE)::BIGINT - CASE WHEN (len(v) * 0.99::DOUBLE)::BIGINT > len(v) * 0.99::DOUBLE THEN 1 ELSE 0 END, len(v) - 1) + 1] AS p99 FROM s")
def slo_p99(spark, sf_dir):
    """The value at rank int(0.99 n): ranked by a window, so that no group is gathered in one array."""
    by = Window.partitionBy("event_type")
    rows = events(spark, sf_dir).withColumns({"i": F.row_number().over(by.orderBy("value")) - 1, "n": F.count("*").over(by)})
    return rows.filter(F.col("i") == F.least((F.col("n") * 0.99).cast("long"), F.col("n") - 1)).select("event_type", F.col("value").alias("p99"))


@query("slo_status", f"WITH {EVENTS_SQL}, d AS (SELECT floor(ts / 86400)::BIGINT AS day, avg((event_type <> 'error')::INT) AS ratio FROM ev GROUP BY 1) SELECT day, round(ratio, 6) AS ratio, ratio >= 0.8 AS met, round(greatest(0, 1 - (1 - ratio) / 0.2::DOUBLE), 6) AS budget_left FROM d")
def slo_status(spark, sf_dir):
    """Daily share of events that are not errors against an objective of 0.8, and what is left of the error budget."""
    rows = events(spark, sf_dir).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.avg((F.col("event_type") != "error").cast("int")).alias("ratio"))
    return rows.select("day", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.8).alias("met"), F.round(F.greatest(F.lit(0.0), 1 - (1 - F.col("ratio")) / 0.2), 6).alias("budget_left"))


_HOURS = "h AS (SELECT floor(ts / 3600)::BIGINT AS hour, count(DISTINCT peer) AS peers FROM ev GROUP BY 1)"


PARTITION_SQL = f"""WITH {EVENTS_SQL}, {_HOURS}, b AS (SELECT hour, peers, avg(peers) OVER w AS base, count(*) OVER w AS n FROM h WINDOW w AS (ORDER BY hour ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING))
 SELECT hour, peers, CASE WHEN n < 3 OR base < 3 THEN 'none' WHEN 1 - peers / base >= 0.8 THEN 'critical' WHEN 1 - peers / base >= 0.5 THEN 'warning' ELSE 'none' END AS alert FROM b"""


@query("partition_alert", PARTITION_SQL)
def partition_alert(spark, sf_dir):
    """Drop of the hour's distinct peers against the mean of up to nine hours before; one row an hour, so one window partition is small."""
    w = Window.orderBy("hour").rowsBetween(-9, -1)
    rows = events(spark, sf_dir).groupBy(F.floor(F.col("ts") / 3600).alias("hour")).agg(F.count_distinct("peer").alias("peers"))
    rows = rows.withColumns({"base": F.avg("peers").over(w), "n": F.count("*").over(w)})
    drop = 1 - F.col("peers") / F.col("base")
    return rows.select("hour", "peers", F.when((F.col("n") < 3) | (F.col("base") < 3), "none").when(drop >= 0.8, "critical").when(drop >= 0.5, "warning").otherwise("none").alias("alert"))


@query(
    "audit_verdict",
    f"WITH {EVENTS_SQL}, a AS (SELECT event_id // 3 AS audit, count(*) AS n, sum((event_type = 'error')::INT) AS failed FROM ev GROUP BY 1) SELECT audit, CASE WHEN failed >= 2 THEN 'fail' WHEN n - failed >= 2 THEN 'pass' ELSE 'inconclusive' END AS verdict FROM a WHERE n = 3",
)
def audit_verdict(spark, sf_dir):
    """Two of three results decide; here three events in a row are an audit and errors its failures."""
    rows = events(spark, sf_dir).groupBy(F.expr("event_id div 3").alias("audit")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("failed")).filter("n = 3")
    return rows.select("audit", F.when(F.col("failed") >= 2, "fail").when(F.col("n") - F.col("failed") >= 2, "pass").otherwise("inconclusive").alias("verdict"))


@query(
    "audit_outliers",
    f"""WITH {EVENTS_SQL}, v AS (SELECT event_id // 5 AS audit, event_type AS answer, event_id FROM ev WHERE event_type <> 'error'), c AS (SELECT audit, answer, count(*) AS n, min(event_id) AS first FROM v GROUP BY ALL),
 m AS (SELECT audit, answer AS mode FROM (SELECT *, row_number() OVER (PARTITION BY audit ORDER BY n DESC, first) AS r FROM c) WHERE r = 1) SELECT event_id FROM v JOIN m USING (audit) WHERE answer <> mode""",
)
def audit_outliers(spark, sf_dir):
    """Results that differ from the most frequent answer of their audit, the first at a tie; errors do not vote."""
    v = events(spark, sf_dir).filter("event_type <> 'error'").select(F.expr("event_id div 5").alias("audit"), F.col("event_type").alias("answer"), "event_id")
    counts = v.groupBy("audit", "answer").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    mode = counts.groupBy("audit").agg(F.max_by("answer", F.struct("n", -F.col("first"))).alias("mode"))
    return v.join(mode, "audit").filter("answer <> mode").select("event_id")


@query(
    "reformulations",
    f"WITH {EVENTS_SQL}, q AS (SELECT event_id, ts - lag(ts) OVER (PARTITION BY peer, event_type ORDER BY ts, event_id) AS gap FROM ev WHERE event_type = 'view') SELECT event_id, round(gap, 3) AS gap FROM q WHERE gap <= 60",
)
def reformulations(spark, sf_dir):
    """Views repeated by the same user within a minute."""
    w = Window.partitionBy("peer", "event_type").orderBy("ts", "event_id")
    return events(spark, sf_dir).filter("event_type = 'view'").withColumn("gap", F.col("ts") - F.lag("ts").over(w)).filter("gap <= 60").select("event_id", F.round("gap", 3).alias("gap"))


@query(
    "peer_profile",
    f"""WITH {EVENTS_SQL}, r AS (SELECT peer, value, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY peer ORDER BY ts DESC, event_id DESC) AS r FROM ev),
 s AS (SELECT peer, value, row_number() OVER (PARTITION BY peer ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY peer) AS n FROM ev WHERE event_type <> 'error'),
 e AS (SELECT peer, sum(CASE WHEN i = 1 THEN pow(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, n - i) END * value) AS ema FROM s GROUP BY peer), p AS (SELECT peer, quantile_cont(value, 0.95) AS p95 FROM (SELECT peer, value, row_number() OVER (PARTITION BY peer ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE event_type <> 'error') WHERE r <= 100 GROUP BY peer)
 SELECT peer, count(*) AS n, round(any_value(ema), 6) AS ema, round(any_value(p95), 6) AS p95, round(avg(CASE WHEN r <= 100 THEN ok::INT END), 6) AS success, CASE WHEN count(*) < 3 THEN 'unknown' WHEN any_value(ema) <= 30 THEN 'high' WHEN any_value(ema) <= 60 THEN 'medium' ELSE 'low' END AS class FROM r LEFT JOIN e USING (peer) LEFT JOIN p USING (peer) GROUP BY peer""",
)
def peer_profile(spark, sf_dir):
    """Latency average of successes (seeded by the first), 95th percentile and success rate of the last 100, and a class."""
    ev = events(spark, sf_dir)
    last = Window.partitionBy("peer").orderBy(F.desc("ts"), F.desc("event_id"))
    ok = ev.filter("event_type <> 'error'")
    averages = trust.ema(ok, "peer", "value", ["ts", "event_id"], 0.3, None).select("peer", F.col("result").alias("ema"))
    high = ok.withColumn("r", F.row_number().over(last)).filter("r <= 100").groupBy("peer").agg(F.expr("percentile(value, 0.95)").alias("p95"))
    rate = ev.withColumn("r", F.row_number().over(last)).groupBy("peer").agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") <= 100, (F.col("event_type") != "error").cast("int"))).alias("success"))
    rows = rate.join(averages, "peer", "left").join(high, "peer", "left")
    kind = F.when(F.col("n") < 3, "unknown").when(F.col("ema") <= 30, "high").when(F.col("ema") <= 60, "medium").otherwise("low")
    return rows.select("peer", "n", *r6("ema", "p95", "success"), kind.alias("class"))
