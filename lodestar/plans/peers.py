"""Peer placement, cross-validation, takedowns, schedules and load rules; sources and users stand for peers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger, peers
from ..registry import query
from ..sources.tables import EVENTS_SQL, events, table
from .trust import TRUST_SQL, trust_of

#: Hex digits of a SHA-256 compared as one number; ties would need 60 equal bits.
_HEX = 15


def _id(c):
    return F.conv(F.substring(F.sha2(c, 256), 1, _HEX), 16, 10).cast("long")


def _id_sql(c: str) -> str:
    return f"('0x' || substr(sha256({c}), 1, {_HEX}))::BIGINT"


def _peers(spark, sf_dir):
    """p, id: all peers and their numbers."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("p")).distinct().withColumn("id", _id(F.col("p")))


@query("url_owner", f"WITH p AS (SELECT DISTINCT source AS p FROM documents) SELECT page_id, arg_min(p, xor({_id_sql('url')}, {_id_sql('p')})) AS owner FROM pages, p GROUP BY page_id")
def url_owner(spark, sf_dir):
    """The peer whose number is closest to the URL's by exclusive or."""
    keys = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), _id(F.col("url")).alias("u"))
    near = peers.candidates(keys, _peers(spark, sf_dir), 1)
    return near.groupBy(F.col("key").alias("page_id")).agg(F.min(F.struct("d", "p"))["p"].alias("owner"))


@query(
    "replica_set",
    f"WITH p AS (SELECT DISTINCT source AS p FROM documents), d AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY xor({_id_sql('sha256(text)')}, {_id_sql('p')}), p) AS r FROM documents, p WHERE p <> source) SELECT doc_id, string_agg(p, ',' ORDER BY r) AS replicas FROM d WHERE r <= 3 GROUP BY doc_id",
)
def replica_set(spark, sf_dir):
    """The three peers closest to a document's number, its own left out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), _id(F.sha2("text", 256)).alias("u"), "source")
    near = peers.candidates(docs.select("key", "u"), _peers(spark, sf_dir), 4).join(docs.select("key", "source"), "key").filter("p <> source")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("d", "p"))).filter("r <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"])
    return best.groupBy(F.col("key").alias("doc_id")).agg(F.array_join(listed, ",").alias("replicas"))


@query(
    "cross_validate",
    """WITH r AS (SELECT doc_id % 60 AS url_id, source AS peer, avg(n_chars % 100) AS score FROM documents GROUP BY ALL), n AS (SELECT count(DISTINCT source) AS peers FROM documents),
 u AS (SELECT url_id, count(*) AS seen, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS hi, min(score) AS lo FROM r GROUP BY url_id)
 SELECT url_id, seen, round(median, 6) AS median, CASE WHEN peers < 2 THEN 'unverified' WHEN seen = 1 THEN 'fabricated' WHEN seen / peers::DOUBLE < 0.1 THEN 'suspicious' WHEN median > 0 AND greatest(hi - median, median - lo) / median > 3 THEN 'suspicious' ELSE 'trusted' END AS verdict FROM u, n""",
)
def cross_validate(spark, sf_dir):
    """Agreement of peers on results: here a document number modulo 60 is the result, and a tenth of the peers must agree."""
    d = table(spark, sf_dir, "documents")
    scores = d.groupBy(F.pmod("doc_id", F.lit(60)).alias("url_id"), F.col("source").alias("peer")).agg(F.avg(F.col("n_chars") % 100).alias("score"))
    peers = d.agg(F.count_distinct("source").alias("peers"))
    by = Window.partitionBy("url_id")
    placed = scores.withColumns({"i": F.row_number().over(by.orderBy("score")), "seen": F.count("*").over(by)})
    middle = F.when(F.col("i") == F.floor(F.col("seen") / 2) + 1, F.col("score"))
    u = placed.groupBy("url_id").agg(F.first("seen").alias("seen"), F.max(middle).alias("median"), F.min("score").alias("least"), F.max("score").alias("most")).join(F.broadcast(peers))  # one row
    off = F.greatest(F.col("most") - F.col("median"), F.col("median") - F.col("least")) / F.col("median")
    verdict = F.when(F.col("peers") < 2, "unverified").when(F.col("seen") == 1, "fabricated").when(F.col("seen") / F.col("peers") < 0.1, "suspicious").when((F.col("median") > 0) & (off > 3), "suspicious").otherwise("trusted")
    return u.select("url_id", "seen", F.round("median", 6).alias("median"), verdict.alias("verdict"))


_LAT, _LON = "((s_suppkey * 37) % 180 - 90)", "((s_suppkey * 73) % 360 - 180)"
_HAVERSINE = f"12742 * asin(sqrt(pow(sin(radians(({_LAT} - 40) / 2.0)), 2) + cos(radians(40.0)) * cos(radians({_LAT} * 1.0)) * pow(sin(radians(({_LON} - 10) / 2.0)), 2)))"


@query("geo_rank", f"SELECT peer, km, row_number() OVER (ORDER BY km, peer) AS rank FROM (SELECT s_suppkey AS peer, round({_HAVERSINE}, 3) AS km FROM supplier) ORDER BY km, peer LIMIT 20")
def geo_rank(spark, sf_dir):
    """The 20 peers closest to 40 N 10 E on a sphere of 6371 km; suppliers get a place from their number."""
    near = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("peer"), F.round(F.expr(_HAVERSINE), 3).alias("km")).orderBy("km", "peer").limit(20)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("km", "peer")))  # 20 rows


@query("recent_peers", f"WITH {EVENTS_SQL}, p AS (SELECT peer, count(*) AS attempts, avg((event_type <> 'error')::INT) AS success, max(ts) AS seen FROM ev GROUP BY peer) SELECT peer, attempts, round(success, 6) AS success, seen FROM p WHERE attempts < 5 OR success > 0.2 ORDER BY seen DESC, peer LIMIT 50")
def recent_peers(spark, sf_dir):
    p = events(spark, sf_dir).groupBy("peer").agg(F.count("*").alias("attempts"), F.avg((F.col("event_type") != "error").cast("int")).alias("success"), F.max("ts").alias("seen"))
    return p.filter("attempts < 5 or success > 0.2").orderBy(F.desc("seen"), "peer").limit(50).withColumn("success", F.round("success", 6))


_IP = "'10.' || (c_nationkey) || '.' || (c_custkey % 7) || '.' || (c_custkey % 250)"


@query("subnet_counts", f"WITH i AS (SELECT {_IP} AS ip FROM customer) SELECT regexp_replace(ip, '\\.\\d+$', '.0/24') AS subnet, count(*) AS n FROM i GROUP BY 1")
def subnet_counts(spark, sf_dir):
    """Nodes by /24 network; customers get an address from their numbers."""
    ip = F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 7).cast("string"), (F.col("c_custkey") % 250).cast("string"))
    return table(spark, sf_dir, "customer").groupBy(F.regexp_replace(ip, r"\.\d+$", ".0/24").alias("subnet")).agg(F.count("*").alias("n"))


@query("gdpr_pending", "SELECT doc_id AS request_id FROM documents WHERE doc_id % 10 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gdpr_pending(spark, sf_dir):
    """Erasure requests (every tenth document) without a confirmed deletion (a label of quality 1)."""
    asked = table(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").alias("request_id"))
    done = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("request_id"))
    return asked.join(done, "request_id", "left_anti")


_STATUS = {"view": "complied", "click": "acknowledged", "error": "invalid", "purchase": "rejected", "signup": "acknowledged"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END"


@query(
    "dmca_noncompliant",
    f"WITH {EVENTS_SQL}, a AS (SELECT event_id % 2000 AS notice, arg_min({_STATUS_SQL}, (ts, event_id)) AS status FROM ev GROUP BY 1) SELECT doc_id AS notice_id, coalesce(status, 'none') AS status FROM documents LEFT JOIN a ON notice = doc_id WHERE doc_id % 7 = 0 AND coalesce(status, 'none') NOT IN ('complied', 'invalid')",
)
def dmca_noncompliant(spark, sf_dir):
    """Notices (every seventh document) whose first acknowledgement is neither compliance nor invalidity."""
    names = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    first = events(spark, sf_dir).groupBy((F.col("event_id") % 2000).alias("notice_id")).agg(F.min_by(F.element_at(names, F.col("event_type")), F.struct("ts", "event_id")).alias("status"))
    rows = table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("notice_id")).join(first, "notice_id", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    return rows.filter("status not in ('complied', 'invalid')")


@query("tz_changes", f"WITH {EVENTS_SQL}, c AS (SELECT peer, floor(ts / 86400)::BIGINT AS day, (event_type <> lag(event_type) OVER (PARTITION BY peer, floor(ts / 86400) ORDER BY ts, event_id))::INT AS changed FROM ev) SELECT peer, day, coalesce(sum(changed), 0)::BIGINT AS changes, coalesce(sum(changed), 0) >= 3 AS suspicious FROM c GROUP BY peer, day")
def tz_changes(spark, sf_dir):
    """Changes of the claimed zone (here the event type) between a peer's claims of one day."""
    w = Window.partitionBy("peer", "day").orderBy("ts", "event_id")
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / 86400)).withColumn("changed", (F.col("event_type") != F.lag("event_type").over(w)).cast("int"))
    return rows.groupBy("peer", "day").agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("changes")).withColumn("suspicious", F.col("changes") >= 3)


#: First octets of addresses and the hour offset that is usual there; the first range that holds an octet counts.
OCTET_OFFSETS = [(1, 49, 8), (50, 99, -5), (100, 149, 1), (150, 199, 9), (200, 223, -3)]
_OFFSET_SQL = "CASE " + " ".join(f"WHEN octet BETWEEN {a} AND {b} THEN {o}" for a, b, o in OCTET_OFFSETS) + " END"


@query("tz_plausible", f"WITH o AS (SELECT c_custkey, (c_custkey % 223 + 1) AS octet, (c_custkey % 25 - 12) AS claimed FROM customer), d AS (SELECT *, abs(claimed - {_OFFSET_SQL}) AS gap FROM o) SELECT c_custkey AS peer, least(gap, 24 - gap) <= 2 AS plausible FROM d")
def tz_plausible(spark, sf_dir):
    """Whether a claimed offset is within two hours, around the clock, of the usual one of the address."""
    octet, claimed = F.col("c_custkey") % 223 + 1, F.col("c_custkey") % 25 - 12
    usual = F.lit(None).cast("int")
    for a, b, o in reversed(OCTET_OFFSETS):
        usual = F.when(octet.between(a, b), o).otherwise(usual)
    gap = F.abs(claimed - usual)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("peer"), (F.least(gap, 24 - gap) <= 2).alias("plausible"))


@query("llm_schedule", f"WITH {TRUST_SQL}, n AS (SELECT peer, row_number() OVER (ORDER BY trust DESC, peer) - 1 AS slot FROM (SELECT * FROM tr ORDER BY trust DESC, peer LIMIT 16)) SELECT event_id, peer AS node FROM ev e JOIN (SELECT peer AS p, slot FROM n) ON e.event_id % 16 = slot, LATERAL (SELECT p AS peer) x WHERE event_type = 'purchase'".replace("SELECT event_id, peer AS node FROM ev e JOIN (SELECT peer AS p, slot FROM n) ON e.event_id % 16 = slot, LATERAL (SELECT p AS peer) x", "SELECT e.event_id, n.peer AS node FROM ev e JOIN n ON e.event_id % 16 = n.slot"))
def llm_schedule(spark, sf_dir):
    """Tasks (purchases) dealt in turn to the 16 most trusted nodes."""
    top = trust_of(spark, sf_dir).orderBy(F.desc("trust"), "peer").limit(16)
    nodes = top.select(F.col("peer").alias("node"), (F.row_number().over(Window.orderBy(F.desc("trust"), "peer")) - 1).alias("slot"))  # 16 rows
    return events(spark, sf_dir).filter("event_type = 'purchase'").withColumn("slot", F.col("event_id") % 16).join(F.broadcast(nodes), "slot").select("event_id", "node")


_LEVEL_SQL = "CASE WHEN cpu > 95 OR mem > 95 THEN 'defensive' WHEN cpu > 90 OR mem > 90 THEN 'severe' WHEN cpu > 80 OR mem > 85 THEN 'overloaded' WHEN cpu > 60 OR mem > 70 THEN 'warning' ELSE 'normal' END"


@query("governor_level", f"WITH {EVENTS_SQL}, s AS (SELECT event_id, value % 101 AS cpu, (value * 7) % 101 AS mem FROM ev), l AS (SELECT *, {_LEVEL_SQL} AS level FROM s) SELECT event_id, level, round(CASE level WHEN 'defensive' THEN 0 WHEN 'severe' THEN 0 WHEN 'overloaded' THEN 0.25::DOUBLE WHEN 'warning' THEN 0.5::DOUBLE ELSE CASE WHEN cpu > 30 THEN greatest(0.3::DOUBLE, 1 - (cpu - 30) / 50 * 0.7::DOUBLE) ELSE 1 END END, 6) AS throttle FROM l")
def governor_level(spark, sf_dir):
    """Load level and throttle of samples (events' values stand for percentages)."""
    s = events(spark, sf_dir).select("event_id", (F.col("value") % 101).alias("cpu"), (F.col("value") * 7 % 101).alias("mem"))
    high = lambda c, m: (F.col("cpu") > c) | (F.col("mem") > m)
    level = F.when(high(95, 95), "defensive").when(high(90, 90), "severe").when(high(80, 85), "overloaded").when(high(60, 70), "warning").otherwise("normal")
    slow = F.when(F.col("cpu") > 30, F.greatest(F.lit(0.3), 1 - (F.col("cpu") - 30) / 50 * 0.7)).otherwise(1.0)
    factor = F.when(F.col("level").isin("defensive", "severe"), 0.0).when(F.col("level") == "overloaded", 0.25).when(F.col("level") == "warning", 0.5).otherwise(slow)
    return s.withColumn("level", level).select("event_id", "level", F.round(factor, 6).alias("throttle"))


@query("score_deviation", "WITH r AS (SELECT doc_id % 60 AS url_id, source AS peer, avg(n_chars % 100) AS score FROM documents GROUP BY ALL), u AS (SELECT url_id, count(*) AS seen, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS hi, min(score) AS lo FROM r GROUP BY url_id) SELECT url_id, seen, round(CASE WHEN seen <= 1 OR median <= 0 THEN 0 ELSE greatest(hi - median, median - lo) / median END, 4) AS deviation FROM u")
def score_deviation(spark, sf_dir):
    """How far the scores of a result are from their median at most, as a share of it; 0 for one score or a median of 0."""
    d = table(spark, sf_dir, "documents")
    scores = d.groupBy(F.pmod("doc_id", F.lit(60)).alias("url_id"), F.col("source").alias("peer")).agg(F.avg(F.col("n_chars") % 100).alias("score"))
    return peers.deviations(scores, "url_id", "score").select("url_id", "seen", F.round("deviation", 4).alias("deviation"))
