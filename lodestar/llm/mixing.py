"""Mixing sources to target weights with Pareto order sampling.

Every document first gets the whole copies that its source's ratio of target to size
contains. For the rest of the target the source's documents are ranked by random odds
over inclusion odds, u/(1-u) : p/(1-p), and taken in that order until the sample has its
size, which is fixed in words as the targets are. A document's inclusion odds are those of
its source over 1 + size / LONG, so that no few long documents decide what a mix
holds; the odds of a source are where its cut falls, the same for all its documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import settle, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often.
MOST_COPIES = 3
#: Steps into which the random numbers of a source are counted before its cut is sought.
STEPS = 65536
#: Words of a document that has half the inclusion odds of a very short one.
LONG = 4096
#: A round of the filling reads, from where the last one ended, steps that hold so many times the words left open, or so many rows; rounds go on to the last row.
ROUND_WORDS, ROUND_ROWS = 4, 1 << 18
STATE = "c string, room double, at int, segs array<struct<lo:double,hi:double,most:long>>, over double, over_u double, over_size long"
#: Plan rows (one a source) that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the row alone; equal rows have the same."""
    return ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 12)).cast("double") + 0.5) / float(1 << 52)


def rank(u: Column, size: Column) -> Column:
    """Pareto order: random odds over inclusion odds without the source's factor, as a number in (0, 1)."""
    ratio = u / (F.lit(1.0) - u) * (F.lit(1.0) + size / F.lit(float(LONG)))
    return ratio / (F.lit(1.0) + ratio)


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with target: water filling of all sizes by weight below the caps.

    Weights 1, 2, 3 repeat over the sources by code point, null last. With the sources
    ordered by cap over weight, those under the water stand at their cap and the level
    is what is left over the weight that is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double")).withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(rise), F.lit(0.0))).withColumn("left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rise), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("below")) / F.col("left"))
    # The first source whose cap is above the level ends the rise.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level")))).over(whole)["level"]
    return s.withColumn("target", F.coalesce(F.least(level * F.col("w"), F.col("cap")), F.col("cap"))).select("source", "source_size", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """One round of one source: along the random order, every unit that fits the room is taken and any other is skipped.

    The units taken are told by segments: from lo to hi those of at most `most` words. A segment ends where a taken
    unit is no shorter than a skipped one, by when at least half its room is used, so there are few. over is the
    least excess of a skipped unit, had it been taken and the filling ended with it.
    """
    rows = rows.sort_values("u")
    first = rows.iloc[0]
    room, segs = first["room"], list(first["segs"])
    over, over_u, over_size = first["over"], first["over_u"], first["over_size"]
    lo = hi = None
    most, least = 0, float("inf")
    for u, words, size in zip(rows["u"], rows["words"], rows["size"], strict=True):
        fits = words <= room
        if size >= least if fits else size <= most:
            if most:
                segs.append({"lo": lo, "hi": hi, "most": most})
            lo, most, least = None, 0, float("inf")
        if fits:
            room -= words
            most = max(most, size)
        else:
            least = min(least, size)
            if words - room < over:
                over, over_u, over_size = words - room, u, size
        lo, hi = u if lo is None else lo, u
    if most:
        segs.append({"lo": lo, "hi": hi, "most": most})
    return pd.DataFrame({"c": [first["c"]], "room": [room], "at": [first["next"]], "segs": [segs], "over": [over], "over_u": [over_u], "over_size": [over_size]})


def _in_segments(segs: Column, u: Column, size: Column) -> Column:
    return F.exists(segs, lambda s: (u >= s["lo"]) & (u <= s["hi"]) & (size <= s["most"]))


def filled(units: DataFrame, cut: DataFrame) -> DataFrame:
    """cut (c, room, at) with the segments that fill the room from step `at` on; no row is left unseen that could fit.

    At the end the rest is compared with its excess if the shortest unit left out were taken as well, and if the filling
    had ended with a unit that it skipped (such as the long one on the cut).
    """
    state = settle(cut.select("c", "room", "at", F.array().cast("array<struct<lo:double,hi:double,most:long>>").alias("segs"), F.lit(float("inf")).alias("over"), F.lit(0.0).alias("over_u"), F.lit(0).cast("long").alias("over_size")))
    ended = None
    while not state.isEmpty():
        # Repeated rows are seen even if they do not fit, as each of them alone may be short enough for a segment; so is all of the first step, where the long unit on the cut lies.
        open_ = small_side(state, BROADCAST_SOURCES)
        rows = units.join(open_, _same("source", "c")).filter((F.col("step") >= F.col("at")) & ((F.col("words") <= F.col("room")) | (F.col("words") > F.col("size")) | (F.col("step") == F.col("at")))).drop("source")
        fitting = F.sum(F.when(F.col("words") <= F.col("room"), F.col("words")).otherwise(0))
        steps = rows.groupBy("c", "step").agg(fitting.alias("words"), F.count("*").alias("n"), F.first("room").alias("room"))
        before = Window.partitionBy("c").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumns({"w0": F.coalesce(F.sum("words").over(before), F.lit(0)), "n0": F.coalesce(F.sum("n").over(before), F.lit(0))})
        ends = settle(steps.filter((F.col("w0") <= ROUND_WORDS * F.col("room")) & (F.col("n0") < ROUND_ROWS)).groupBy(F.col("c").alias("e")).agg((F.max("step") + 1).alias("next")))
        now = rows.join(small_side(ends, BROADCAST_SOURCES), _same("c", "e")).filter("step < next").drop("e")
        done = settle(now.groupBy("c").applyInPandas(fill, STATE).unionByName(state.join(ends, _same("c", "e"), "left_anti").withColumn("at", F.lit(STEPS))))
        over = done.filter((F.col("room") <= 0) | (F.col("at") >= STEPS))
        ended = over if ended is None else ended.unionByName(over)
        state = settle(done.filter((F.col("room") > 0) & (F.col("at") < STEPS)))
    if ended is None:
        return state
    ended = settle(ended)
    first = cut.select(F.col("c").alias("f"), F.col("at").alias("step0"))
    out = units.join(small_side(settle(ended.select("c", "segs").join(first, _same("c", "f")).drop("f")), BROADCAST_SOURCES), _same("source", "c")).filter((F.col("step") >= F.col("step0")) & ~_in_segments(F.col("segs"), F.col("u"), F.col("size")))
    least = out.groupBy(F.col("c").alias("l")).agg(F.min(F.struct("words", "u", "size")).alias("least"))
    e = ended.join(least, _same("c", "l"), "left").drop("l").withColumn("more", F.coalesce(F.col("least.words") - F.col("room"), F.lit(float("inf"))))
    point = lambda u, size: F.array(F.struct(u.alias("lo"), u.alias("hi"), size.alias("most")))
    stop = F.filter("segs", lambda s: s["lo"] <= F.col("over_u"))
    stop = F.transform(stop, lambda s: F.struct(s["lo"].alias("lo"), F.least(s["hi"], F.col("over_u")).alias("hi"), s["most"].alias("most")))
    segs = F.when((F.col("over") < F.col("room")) & (F.col("over") < F.col("more")), F.concat(stop, point(F.col("over_u"), F.col("over_size"))))
    segs = segs.when(F.col("more") < F.col("room"), F.concat("segs", point(F.col("least.u"), F.col("least.size")))).otherwise(F.col("segs"))
    return settle(e.select("c", segs.alias("segs")))


def plan(sized: DataFrame) -> DataFrame:
    """One row a source: whole copies of each document, the cut of the ranks, and segments filled after it.

    sized: source, size, u, where u is the rank.
    """
    # Rows of equal rank are one unit: they are repeated rows, taken together or not at all.
    units = settle(sized.filter("size > 0").groupBy("source", "u").agg(F.sum("size").alias("words"), F.max("size").alias("size")).withColumn("step", F.floor(F.col("u") * STEPS).cast("int")))
    counted = settle(units.groupBy("source", "step").agg(F.sum("words").alias("words")))
    empty = sized.select("source").distinct().withColumn("source_size", F.lit(0).cast("long"))
    totals = settle(targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")).unionByName(empty).groupBy("source").agg(F.sum("source_size").alias("source_size"))))
    p = totals.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(MOST_COPIES))).otherwise(0).cast("int")).withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    named = p.withColumnRenamed("source", "s")
    cum = counted.join(named, _same("source", "s")).withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("step")))
    cut = cum.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("step", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("room"))).alias("cut"))
    cut = settle(cut.select(F.col("source").alias("c"), F.col("cut.room").alias("room"), F.col("cut.step").alias("at")))
    out = p.join(cut.select(F.col("c").alias("n"), F.col("at").alias("step0")), _same("source", "n"), "left").join(filled(units, cut), _same("source", "c"), "left").drop("n", "c")
    # A source without a cut (its rest is all of it, or nothing) takes every row below rest, or none.
    return settle(out.select("source", "source_size", "target", "copies", F.coalesce(F.col("step0"), F.when(F.col("rest") > 0, F.lit(STEPS)).otherwise(0)).alias("step0"), "segs"))


def mix(docs: DataFrame, seed: int = 8, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies x size.

    Every document gets the whole copies that its source's ratio of target to size
    contains; the rest of the target is a Pareto order sample of the source's documents
    by permanent random numbers, cut where the words reach it. Long documents have lesser
    odds. A document that does not fit is skipped, and all later ones that still fit fill the
    gap. No document has more than three copies. Null texts
    and empty texts have size 0 and no copy beyond the whole ones; a null source is a
    source, the last. Repeated rows are taken together. Clashing columns are replaced.
    """
    sized = docs.withColumn("size", size_of(F.col(text))).withColumn("_u", rank(chance(F.col(key), F.col(text), seed), F.col("size")))
    planned = plan(sized.select(F.col(source).cast("string").alias("source"), "size", F.col("_u").alias("u")))
    planned = planned.select([F.col(c).alias(f"_p_{c}") for c in planned.columns])
    joined = sized.drop("source_size", "target", "copies", "taken").join(small_side(planned, BROADCAST_SOURCES), F.col(source).cast("string").eqNullSafe(F.col("_p_source")))
    chosen = (F.floor(F.col("_u") * STEPS) < F.col("_p_step0")) | F.coalesce(_in_segments(F.col("_p_segs"), F.col("_u"), F.col("size")), F.lit(False))
    copies = (F.col("_p_copies") + F.when((F.col("size") > 0) & chosen & (F.col("_p_copies") < MOST_COPIES), 1).otherwise(0)).cast("int")
    return joined.withColumns({"source_size": F.col("_p_source_size"), "target": F.col("_p_target"), "copies": copies}).withColumn("taken", F.col("copies") * F.col("size")).drop("_u", *planned.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
