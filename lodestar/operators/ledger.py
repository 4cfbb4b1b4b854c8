"""Credit accounting over an action log (event_id, peer, action, quantity, ts in seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Credits of one unit of each action, and the rules around them.
WEIGHTS = {"crawl": 1.0, "query_process": 0.5, "network_uptime": 0.5, "llm_own": 1.5}
OFF_PEAK = (23, 7, 1.5)
LLM_SHARE, GRACE_SECONDS, DEBT_FACTOR = 0.6, 72 * 3600.0, 2.0
TIERS = [(1000.0, 0.033), (100.0, 0.05)]
BASE_COST = 0.1


def off_peak(hour: Column, start: int = OFF_PEAK[0], end: int = OFF_PEAK[1]) -> Column:
    """Whether an hour is in [start, end), which may wrap midnight."""
    return ((hour >= start) | (hour < end)) if start > end else ((hour >= start) & (hour < end))


def hour_of(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3600), F.lit(24)).cast("int")


def earned(log: DataFrame) -> DataFrame:
    """log with credits: weight x quantity, half as much again for language-model work off peak."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    bonus = F.when((F.col("action") == "llm_own") & off_peak(hour_of(F.col("ts"))), OFF_PEAK[2]).otherwise(1.0)
    return log.withColumn("credits", F.coalesce(F.element_at(weights, F.col("action")), F.lit(0.0)) * F.col("quantity") * bonus)


def balances(credited: DataFrame, spent: DataFrame) -> DataFrame:
    """peer, earned, spent and balance; a missing side counts 0."""
    e = credited.groupBy("peer").agg(F.sum("credits").alias("earned"))
    s = spent.groupBy("peer").agg(F.sum("amount").alias("spent"))
    both = e.join(s, "peer", "full").select("peer", F.coalesce("earned", F.lit(0.0)).alias("earned"), F.coalesce("spent", F.lit(0.0)).alias("spent"))
    return both.withColumn("balance", F.col("earned") - F.col("spent"))


def contribution(credited: DataFrame) -> DataFrame:
    """peer and score: language-model credits count up to 60 % of the whole."""
    llm = F.col("action").startswith("llm")
    rows = credited.groupBy("peer").agg(F.sum(F.when(llm, F.col("credits")).otherwise(0.0)).alias("llm"), F.sum(F.when(~llm, F.col("credits")).otherwise(0.0)).alias("other"))
    total = F.col("llm") + F.col("other")
    capped = F.when((total > 0) & (F.col("llm") / total > LLM_SHARE), F.col("other") * LLM_SHARE / (1 - LLM_SHARE)).otherwise(F.col("llm"))
    return rows.select("peer", (capped + F.col("other")).alias("score"))


def search_cost(score: Column) -> Column:
    out = F.lit(BASE_COST)
    for bound, cost in reversed(TIERS):
        out = F.when(score >= bound, cost).otherwise(out)
    return out


def grace(movements: DataFrame) -> DataFrame:
    """Last state of each peer from movements (peer, event_id, ts, delta): balance, and since when it is not positive."""
    run = Window.partitionBy("peer").orderBy("ts", "event_id")
    rows = movements.withColumn("balance", F.sum("delta").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("spell", F.sum((F.col("balance") > 0).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    start = rows.filter("balance <= 0").groupBy("peer", "spell").agg(F.min("ts").alias("since"))
    last = rows.groupBy("peer").agg(F.max_by(F.struct("balance", "spell", "ts"), F.struct("ts", "event_id")).alias("l"))
    out = last.select("peer", F.col("l.balance").alias("balance"), F.col("l.spell").alias("spell"), F.col("l.ts").alias("at")).join(start, ["peer", "spell"], "left")
    since = F.when(F.col("balance") <= 0, F.col("since"))
    state = F.when(F.col("balance") > 0, "normal").when(F.col("at") - since <= GRACE_SECONDS, "grace").otherwise("debt")
    return out.select("peer", "balance", since.alias("since"), state.alias("state"))
