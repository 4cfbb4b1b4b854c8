"""Streaming forms of the batch rules over an event stream (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import new_path

LATE = "10 minutes"
#: Days without events after which a key's state goes.
IDLE_DAYS = 60
#: The column of a replay that marks its last event, which moves the watermark past all others and is in no result.
CLOSING = "closing"
#: The first time, in microseconds, that a watermark does not take for late, and the column of the microseconds by which an event is earlier.
FIRST, EARLY = 1, "early"


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """events behind a watermark, without the one that closes a replay.

    The condition names the time, as one that does not would be moved before the watermark.
    """
    out = events.withWatermark("ts", late)
    return out.filter(~F.col(CLOSING) | F.col("ts").isNull()) if CLOSING in events.columns else out


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events of each user, kind and clock hour: the fixed-window rate limit."""
    return timed(events).groupBy(F.window("ts", "1 hour"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "user_id", "event_type", "n")


def bursts(events: DataFrame, least: int = 2) -> DataFrame:
    """Sliding five-minute windows, every minute, in which a user has at least `least` events."""
    return timed(events).groupBy(F.window("ts", "5 minutes", "1 minute"), "user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap without events."""
    return timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def summaries(events: DataFrame) -> DataFrame:
    """Count, sum and largest value of each kind and day: histograms of metrics."""
    return timed(events).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("window.start").alias("day"), "event_type", "n", "total", "most")


def unseen(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of every key within the watermark: unseen feed items, crawl dedup."""
    return timed(events).dropDuplicatesWithinWatermark(keys)


def by_key(events: DataFrame, keys: list[str], out: str, state: str, start: tuple, step: Callable, order: list[str], idle: float = IDLE_DAYS * 86400.0) -> DataFrame:
    """Rows that step(values of the state, rows of a key in order) -> (new state, frame) makes of each micro-batch.

    A key's state is given up after so many seconds without events. Keys may be null.
    A watermark begins at 1970 and what lies before it is late, so times before that go as
    EARLY, how long before FIRST they are, beside FIRST itself.
    """
    first = F.timestamp_micros(F.lit(FIRST))
    early = F.greatest(F.lit(FIRST) - F.unix_micros("ts"), F.lit(0))
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({EARLY: F.coalesce(early, F.lit(0)), "ts": F.when(F.col("ts") < first, first).otherwise(F.col("ts"))})

    def run(key, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches))
        if rows[EARLY].any():
            rows["ts"] = rows["ts"].astype("datetime64[us]") - rows[EARLY].astype("timedelta64[us]")
        rows = rows.sort_values(order)
        values, frame = step(held.get if held.exists else start, rows)
        held.update(values)
        # Never before the watermark, as that is not allowed.
        last = max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs())
        held.setTimeoutTimestamp(last + int(idle * 1000))
        yield frame

    return timed(events).groupBy(*keys).applyInPandasWithState(run, out, state, "append", "EventTimeTimeout")


def by_user(events: DataFrame, out: str, state: str, start: tuple, step: Callable) -> DataFrame:
    return by_key(events, ["user_id"], out, state, start, step, ["ts", "event_id"])


def _user(rows: pd.DataFrame, n: int = 1) -> pd.Series:
    """The user of a group's rows, null or not, so many times."""
    user = rows["user_id"].iloc[0]
    return pd.Series([None if pd.isna(user) else int(user)] * n, dtype="Int64")


def running_ema(events: DataFrame, alpha: float = 0.3, start: float = 0.5) -> DataFrame:
    """user_id, n, ema after each micro-batch; the state is one count and one number a user."""

    def step(held, rows):
        n, value = held
        for v in rows["value"]:
            value = value * (1 - alpha) + min(v / 100.0, 1.0) * alpha
        return (n + len(rows), value), pd.DataFrame({"user_id": _user(rows), "n": [n + len(rows)], "ema": [value]})

    return by_user(events, "user_id long, n long, ema double", "n long, ema double", (0, start), step)


def failures_in_a_row(events: DataFrame) -> DataFrame:
    """user_id, n, run, worst after each micro-batch: failed audits (errors) since the last passed one (click), and the longest such run so far."""

    def step(held, rows):
        n, run, worst = held
        for kind in rows["event_type"]:
            run = run + 1 if kind == "error" else 0
            worst = max(worst, run)
        n += len(rows)
        return (n, run, worst), pd.DataFrame({"user_id": _user(rows), "n": [n], "run": [run], "worst": [worst]})

    return by_user(events.filter(F.coalesce(F.col("event_type").isin("error", "click"), F.lit(False)) | closing(events)), "user_id long, n long, run long, worst long", "n long, run long, worst long", (0, 0, 0), step)


def admitted(events: DataFrame, most: int = 1, seconds: float = 60.0) -> DataFrame:
    """event_id, user_id of the events let through: at most so many of a user in the trailing seconds, refused ones not counted.

    With one and the time to live of a lock, these are the acquisitions of a lock a key.
    """

    def step(held, rows):
        kept, out = [float(x) for x in held[0].split()], []
        for i, t in zip(rows["event_id"], rows["ts"], strict=True):
            now = t.timestamp()
            kept = [x for x in kept if now - x < seconds]
            if len(kept) < most:
                kept.append(now)
                out.append(i)
        return (" ".join(map(repr, kept)),), pd.DataFrame({"event_id": out, "user_id": _user(rows, len(out))}).astype({"event_id": "int64"})

    return by_user(events, "event_id long, user_id long", "kept string", ("",), step)


def cached(events: DataFrame, seconds: float) -> DataFrame:
    """user_id, n, hits after each micro-batch: requests of a key, and those that its entry, made so many seconds ago at most, answers."""

    def step(held, rows):
        n, hits, made = held
        for t in rows["ts"]:
            now = t.timestamp()
            if now - made < seconds:
                hits += 1
            else:
                made = now
        n += len(rows)
        return (n, hits, made), pd.DataFrame({"user_id": _user(rows), "n": [n], "hits": [hits]})

    return by_user(events, "user_id long, n long, hits long", "n long, hits long, made double", (0, 0, -1e12), step)


def bucket(events: DataFrame, size: float, rate: float) -> DataFrame:
    """user_id, n, allowed after each micro-batch: a token bucket for each user, a value's worth of tokens for each event let through."""

    def step(held, rows):
        n, allowed, level, last = held
        for t, v in zip(rows["ts"], rows["value"], strict=True):
            now = t.timestamp()
            level, last = min(size, level + max(0.0, now - last) * rate), now
            if level >= v:
                level, allowed = level - v, allowed + 1
        n += len(rows)
        return (n, allowed, level, last), pd.DataFrame({"user_id": _user(rows), "n": [n], "allowed": [allowed]})

    return by_user(events, "user_id long, n long, allowed long", "n long, allowed long, level double, last double", (0, 0, size, 0.0), step)


def closing(events: DataFrame) -> Column:
    """Whether an event closes a replay; a filter before the watermark must let it pass."""
    return F.col(CLOSING) if CLOSING in events.columns else F.lit(False)


def replayed(events: DataFrame, operator: Callable, steps: int = 3, then: Callable | None = None, each: Callable | None = None) -> DataFrame:
    """What operator makes of events (with ts) as a stream: they come in so many steps in order of time, and at last one event a year later.

    The stream ends after every step and starts again from its checkpoint with the next,
    as after a restart. A step is read by as many tasks as it was written by. then is an
    operator on what the stream writes, a stream of its own: it runs after every step, too.
    each is called with what a micro-batch has written and its number.
    """
    spark = events.sparkSession
    base = new_path(spark, "replay")
    rows = events.withColumns({"ts": F.col("ts").cast("timestamp"), CLOSING: F.lit(False)})
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    span = (hi - lo) / steps if lo else None
    for i in range(steps if lo else 0):
        part = rows.filter(F.col("ts") >= F.lit(lo + i * span)) if i else rows  # what has no time comes first
        (part.filter((F.col("ts") < F.lit(lo + (i + 1) * span)) | F.col("ts").isNull()) if i < steps - 1 else part).write.parquet(f"{base}/step/{i}")
    hi = hi or datetime.datetime(1970, 1, 1)
    last = spark.range(1).select(*[(F.lit(True) if c == CLOSING else F.lit(hi).cast("timestamp") + F.expr("INTERVAL 365 DAYS") if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes])
    last.write.parquet(f"{base}/step/{steps}")
    stream = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/in/*"))
    after = then(spark.readStream.schema(stream.schema).parquet(f"{base}/out/*")) if then else None
    for step in storage.names(spark, f"{base}/step"):
        storage.move(spark, f"{base}/step/{step}", f"{base}/in/{step}")
        run(stream, f"{base}/out", f"{base}/state", each)
        if then:
            run(after, f"{base}/then", f"{base}/state-then")
    return spark.read.schema(after.schema).parquet(f"{base}/then/*") if then else spark.read.schema(stream.schema).parquet(f"{base}/out/*")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, for replayed()."""
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def run(stream: DataFrame, out: str, checkpoint: str, each: Callable | None = None) -> None:
    """Runs a stream over all there is, in append mode. Each micro-batch has a folder by its number and writes it over when it is tried again, so no row comes twice."""

    def write(df: DataFrame, i: int) -> None:
        path = f"{out}/{i:09d}"
        df.write.mode("overwrite").parquet(path)
        if each:
            each(df.sparkSession.read.schema(df.schema).parquet(path), i)

    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def run_to_end(stream: DataFrame) -> DataFrame:
    """Runs a stream once and returns what it wrote to the shared folder."""
    base = new_path(stream.sparkSession, "stream")
    run(stream, f"{base}/out", f"{base}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out/*")
