"""Trust, audits, anomaly detection and service levels over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights, windows and limits of the trust rules.
W_UPTIME, W_CONTRIBUTION, W_AUDIT, W_SUMMARY = 0.15, 0.25, 0.40, 0.20
MOST_UPTIME, MOST_CONTRIBUTION = 720.0, 5000.0
EMA_ALPHA, EMA_START = 0.3, 0.5
BOOST_DECAY, BOOST = 0.95, {"fetch": 1.0, "skip": -0.3, "cite": 2.0}
BURST_SECONDS, BURST_COUNT, LEAST_CV, CV_ROWS = 300.0, 30, 0.15, 10


def decayed(rows: DataFrame, key: str, value: str, order: list[str], decay: float) -> DataFrame:
    """key, n, total (the sum of the key's values, each decayed once by every later one) and first (the first value, so decayed).

    The closed form of a running recurrence: a window gives ranks, sums stay partial, and no key's rows are ever gathered in an array.
    """
    ago = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1
    weighed = rows.withColumn("_ago", ago).withColumn("_w", F.pow(F.lit(decay), F.col("_ago")) * F.col(value))
    return weighed.groupBy(key).agg(F.count("*").alias("n"), F.sum("_w").alias("total"), F.max_by("_w", "_ago").alias("first"))


def ema(rows: DataFrame, key: str, value: str, order: list[str], alpha: float = EMA_ALPHA, start: float | None = EMA_START) -> DataFrame:
    """key, n, result: the exponential average of a key's values in order from a start, or from the first value without one."""
    d = decayed(rows, key, value, order, 1 - alpha)
    base = F.pow(F.lit(1 - alpha), F.col("n")) * start if start is not None else (1 - alpha) * F.col("first")
    return d.select(key, "n", (alpha * F.col("total") + base).alias("result"))


def trust_score(uptime: Column, contribution: Column, audit_rate: Column, summary: Column) -> Column:
    """Weighted sum of capped signals; an unknown audit rate or summary rating counts one half."""
    return (
        W_UPTIME * F.least(uptime / MOST_UPTIME, F.lit(1.0))
        + W_CONTRIBUTION * F.least(contribution / MOST_CONTRIBUTION, F.lit(1.0))
        + W_AUDIT * F.coalesce(audit_rate, F.lit(0.5))
        + W_SUMMARY * F.coalesce(summary, F.lit(0.5))
    )


def trust_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "trusted").when(score >= 0.5, "normal").when(score >= 0.3, "suspect").otherwise("untrusted")


def trust_grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A+").when(score >= 0.8, "A").when(score >= 0.65, "B").when(score >= 0.5, "C").when(score >= 0.3, "D").otherwise("F")


def trailing(log: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """log with in_window: the key's events of the last so many seconds, itself included."""
    w = Window.partitionBy(*keys).orderBy(F.round(F.col("ts") * 1000000).cast("long")).rangeBetween(-round(seconds * 1000000), 0)
    return log.withColumn("in_window", F.count("*").over(w))


def interval_cv(log: DataFrame) -> DataFrame:
    """peer, n, cv and regular: too even intervals between a peer's events mark a machine."""
    gaps = log.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("peer").orderBy("ts", "event_id")))
    rows = gaps.groupBy("peer").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd")).filter(F.col("n") >= CV_ROWS)
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean"))
    return rows.select("peer", "n", F.round(cv, 6).alias("cv"), F.coalesce(cv < LEAST_CV, F.lit(True)).alias("regular"))


def isolation(audits: DataFrame, least: int = 3) -> DataFrame:
    """peer, worst run of failures in a row, and whether it reached the isolation threshold; audits: peer, event_id, ts, passed."""
    w = Window.partitionBy("peer").orderBy("ts", "event_id")
    rows = audits.withColumn("run", F.sum(F.col("passed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("peer", "run").agg(F.sum((~F.col("passed")).cast("int")).alias("failures"))
    return runs.groupBy("peer").agg(F.max("failures").alias("worst")).withColumn("isolated", F.col("worst") >= least)
