"""Peers and keys by the exclusive or of their numbers; peers by latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .dedup import numbered

#: Bits of a number, and of a digit of its prefixes.
BITS, DIGIT = 60, 4


def _levels(rows: DataFrame, number: str) -> DataFrame:
    """A row for every prefix, by its digits: level, prefix."""
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(BITS // DIGIT - 1))).alias("level")).withColumn("prefix", F.expr(f"shiftrightunsigned({number}, {BITS} - {DIGIT} * level)"))


def candidates(keys: DataFrame, peers: DataFrame, n: int) -> DataFrame:
    """key, p, d: peers (p, id) among which are the n closest to each key (key, u), with their distance.

    A peer that shares a longer prefix is closer, so those of the longest prefix that n of them
    have are enough: with random numbers some 16 n at most, however many peers there are.
    """
    held = _levels(peers, "id")
    enough = held.groupBy("level", "prefix").agg(F.count("*").alias("n")).filter((F.col("n") >= n) | (F.col("level") == 0)).select("level", "prefix")
    deepest = _levels(keys, "u").join(enough, ["level", "prefix"], "left_semi").groupBy("key", "u").agg(F.max(F.struct("level", "prefix")).alias("m")).select("key", "u", "m.level", "m.prefix")
    return deepest.join(held, ["level", "prefix"]).select("key", "p", F.col("u").bitwiseXOR(F.col("id")).alias("d"))


def exact_mean(value: Column) -> Column:
    """The mean of a group by a sum of decimals, so that peers of equal values have equal means, in whatever order they are summed; by doubles where one is too large, or not a number."""
    small = F.when(F.abs(value) < 1e12, value).cast("decimal(27,12)")
    mean = (F.try_sum(small) / F.count(small)).cast("double")
    return F.when(F.count(small) == F.count(value), mean).otherwise(F.avg(value))


#: Share of the slow peers that are asked before the others, so that they are measured again.
DIVERSITY = 5


def by_latency(rows: DataFrame, peer: str = "peer", latency: str = "latency") -> DataFrame:
    """rows with place, from 1, by latency; null latencies are unknown and come last. No window over all rows."""
    keyed = rows.withColumn("_known", F.coalesce(latency, F.lit(float("inf"))))
    return numbered(keyed, ["_known", peer]).withColumn("place", F.col("pos") + 1).drop("pos", "_known")


def diverse(rows: DataFrame, peer: str = "peer", latency: str = "latency") -> DataFrame:
    """rows with place: the faster half by latency, then one in DIVERSITY of the slower ones, told by a hash of their names, then the rest; two peers or fewer just by latency."""
    placed = settle(by_latency(rows, peer, latency))
    n = placed.count()
    luck = F.conv(F.substring(F.md5(F.col(peer).cast("string")), 1, 8), 16, 10).cast("long") % DIVERSITY == 0
    group = F.when((F.col("place") <= max(1, n // 2)) | F.lit(n <= 2), 0).when(luck, 1).otherwise(2)
    out = numbered(placed.withColumn("_group", group), ["_group", "place"])
    return out.withColumn("place", F.col("pos") + 1).drop("pos", "_group")


def deviations(rows: DataFrame, key: str, score: str) -> DataFrame:
    """key, seen, median (the upper one), deviation: the largest distance of a score from the median over it. No key's scores are gathered."""
    by = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(by.orderBy(score)), "_n": F.count("*").over(by)})
    middle = F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col(score))
    u = placed.groupBy(key).agg(F.first("_n").alias("seen"), F.max(middle).alias("median"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    far = F.greatest(F.col("hi") - F.col("median"), F.col("median") - F.col("lo")) / F.col("median")
    return u.select(key, "seen", "median", F.when((F.col("seen") <= 1) | (F.col("median") <= 0), 0.0).otherwise(far).alias("deviation"))
