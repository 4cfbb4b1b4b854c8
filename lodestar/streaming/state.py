"""Operators with state of their own: pages seen before, caches of bounded size, quantiles, drops of peers, changing zones."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedup
from .operators import LATE, _user, by_key, by_user, closing, timed

#: Hours for which a crawled page is remembered.
REMEMBERED = 720.0
_BITS = (1 << 64) - 1


#: Keys to which the bits of all choices are dealt: each micro-batch calls Python for a key, not for each choice of bits, of which there are more than pages.
NEAR_KEYS = 256


def near_seen(pages: DataFrame, hours: float = REMEMBERED, most: int = dedup.MOST_BITS, agree: int = 2, keys: int = NEAR_KEYS) -> DataFrame:
    """doc_id, distance: pages (doc_id, ts, text) whose fingerprint is at most `most` bits from that of a page crawled in the hours before.

    A page comes once for every choice of bands that finds it, with the least distance
    there; the least of all is the distance. The state holds different fingerprints by the
    bits of a choice, so copies are one, and forgets those that are out of time. Many such
    bits share one of `keys` keys, but only fingerprints of equal bits are compared. Rows
    of one time go by doc_id; a null text is empty.
    """
    seconds = hours * 3600

    def step(held, rows):
        # The last time of each fingerprint, by choice and bits, the one seen longest ago first.
        known: dict[tuple[int, int], dict[int, float]] = {}
        for x in held[0].split():
            c, p, f, t = x.split(":")
            known.setdefault((int(c), int(p)), {})[int(f)] = float(t)
        out, now = [], 0.0
        for i, f, at, c, p in zip(rows["doc_id"], rows["simhash"], rows["ts"], rows["choice"], rows["part"], strict=True):
            now = at.timestamp()
            seen = known.setdefault((c, p), {})
            while seen and now - seen[first := next(iter(seen))] >= seconds:
                del seen[first]
            if len(seen) > 64:
                least = int(np.bitwise_count((np.fromiter(seen, np.int64, len(seen)) ^ np.int64(f)).view(np.uint64)).min())
            else:
                least = min((((f ^ g) & _BITS).bit_count() for g in seen), default=64)
            if least <= most:
                out.append((i, least))
            seen.pop(f, None)
            seen[f] = now
        kept = " ".join(f"{c}:{p}:{f}:{t!r}" for (c, p), seen in known.items() for f, t in seen.items() if now - t < seconds)
        return (kept,), pd.DataFrame(out, columns=["doc_id", "distance"]).astype({"doc_id": "Int64", "distance": "int32"})

    rows = pages.withColumn("simhash", dedup.fingerprint(F.col("text"))).drop("text")
    rows = rows.select("*", F.inline(dedup.choices(F.col("simhash"), most, agree)))
    rows = rows.withColumn("near_key", F.pmod(F.xxhash64("choice", "part"), F.lit(keys)))
    return by_key(rows, ["near_key"], "doc_id long, distance int", "seen string", ("",), step, ["ts", "doc_id"], seconds)


def lru(events: DataFrame, node: str, key: str, capacity: int, seconds: float) -> DataFrame:
    """node, n, hits, expired, evicted after each micro-batch: requests to the cache of each node for a key.

    An entry answers for so many seconds since it was made, and one that is older is made
    anew; each request makes its entry the most recent, and a new one takes the place of
    the least recent where a cache is full. The state is bounded by the capacity.
    """

    def step(held, rows):
        n, hits, expired, evicted = held[:4]
        cache = {k: made for k, made in json.loads(held[4])}
        for k, t in zip(rows[key], rows["ts"], strict=True):
            k, now = None if pd.isna(k) else str(k), t.timestamp()
            made = cache.pop(k, None)
            if made is not None and now - made <= seconds:
                hits += 1
            else:
                expired += made is not None
                if made is None and len(cache) >= capacity:
                    cache.pop(next(iter(cache)))
                    evicted += 1
                made = now
            cache[k] = made
        n += len(rows)
        name = rows[node].iloc[0]
        frame = pd.DataFrame({"node": [None if pd.isna(name) else str(name)], "n": [n], "hits": [hits], "expired": [expired], "evicted": [evicted]})
        return (n, hits, expired, evicted, json.dumps(list(cache.items()))), frame

    return by_key(events, [node], "node string, n long, hits long, expired long, evicted long", "n long, hits long, expired long, evicted long, cache string", (0, 0, 0, 0, "[]"), step, ["ts", "event_id"])


#: Size of a quantile sketch, for a rank error of well below one in a hundred.
SKETCH = 400


def quantile_sketches(events: DataFrame, window: str = "1 day") -> DataFrame:
    """start, event_type, n and a sketch of the values of each window and kind; sketches of any windows merge."""
    rows = timed(events).groupBy(F.window("ts", window), "event_type").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "sketch")


def quantiles(sketch: Column, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> Column:
    """About the values at these ranks."""
    return F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(r)) for r in ranks])


def hourly_peers(events: DataFrame) -> DataFrame:
    """start, peers: the different users of each hour with events, once the hour is over; two states in a row, the users of the hour and their number."""
    hours = timed(events).select(F.window("ts", "1 hour").alias("w"), "user_id").dropDuplicates(["w", "user_id"])
    return hours.groupBy("w").agg(F.count("user_id").alias("peers")).select(F.col("w.start").alias("start"), "peers")


def drop_alerts(hours: DataFrame, before: int = 9, least: int = 3) -> DataFrame:
    """hour, peers, alert of a stream of hourly_peers(): whether an hour's peers are far fewer than the mean of up to `before` hours with events before it.

    Hours come when they are over, so each micro-batch holds later ones than the last.
    """

    def step(held, rows):
        last = [float(x) for x in held[0].split()]
        out = []
        for hour, peers in zip(rows["hour"], rows["peers"], strict=True):
            base = sum(last) / len(last) if last else 0.0
            drop = 1 - peers / base if base else 0.0
            out.append((hour, peers, "none" if len(last) < 3 or base < least else "critical" if drop >= 0.8 else "warning" if drop >= 0.5 else "none"))
            last = [*last, float(peers)][-before:]
        return (" ".join(map(repr, last)),), pd.DataFrame(out, columns=["hour", "peers", "alert"])

    rows = hours.select(F.col("start").alias("ts"), F.floor(F.unix_seconds("start") / 3600).alias("hour"), "peers", F.lit(0).alias("network"))
    return by_key(rows, ["network"], "hour long, peers long, alert string", "last string", ("",), step, ["hour"])


def flapping(events: DataFrame, zone: str = "event_type", hours: float = 24.0, most: int = 3) -> DataFrame:
    """event_id, user_id, changes, suspicious: how often a user's claimed zone changed between the claims of the trailing hours, and whether that is `most` times or more.

    The state is the claims of that time.
    """
    seconds = hours * 3600

    def step(held, rows):
        claims, out = json.loads(held[0]), []
        for i, t, z in zip(rows["event_id"], rows["ts"], rows[zone], strict=True):
            now = t.timestamp()
            claims = [c for c in claims if c[0] >= now - seconds]
            claims.append([now, None if pd.isna(z) else str(z)])
            changes = sum(a[1] != b[1] for a, b in zip(claims, claims[1:], strict=False))
            out.append((i, changes, changes >= most))
        frame = pd.DataFrame(out, columns=["event_id", "changes", "suspicious"])
        frame.insert(1, "user_id", _user(rows, len(out)))
        return (json.dumps(claims),), frame

    return by_user(events, "event_id long, user_id long, changes long, suspicious boolean", "claims string", ("[]",), step)


def reformulations(events: DataFrame, kind: str = "view", seconds: float = 60.0) -> DataFrame:
    """event_id, user_id, gap: queries (events of a kind) of a user not later than so many seconds after the one before. The state is the time of the last."""

    def step(held, rows):
        last, out = held[0], []
        for i, t in zip(rows["event_id"], rows["ts"], strict=True):
            now = t.timestamp()
            if last >= 0 and now - last <= seconds:
                out.append((i, now - last))
            last = now
        frame = pd.DataFrame(out, columns=["event_id", "gap"]).astype({"event_id": "int64", "gap": "float64"})
        frame.insert(1, "user_id", _user(rows, len(out)))
        return (last,), frame

    asked = events.filter(F.coalesce(F.col("event_type") == kind, F.lit(False)) | closing(events))
    return by_key(asked, ["user_id"], "event_id long, user_id long, gap double", "last double", (-1.0,), step, ["ts", "event_id"])


def locks(events: DataFrame, lock: str, holder: str, release: Column, seconds: float = 300.0) -> DataFrame:
    """event_id, outcome of requests for locks: granted where the lock is free or out of time, renewed for its holder, refused for others; released by its holder, ignored from others."""

    def step(held, rows):
        owner, until = held
        out = []
        for i, who, t, free in zip(rows["event_id"], rows[holder], rows["ts"], rows["_release"], strict=True):
            who, now = "" if pd.isna(who) else str(who), t.timestamp()
            holds = now < until
            if free:
                out.append((i, "released" if holds and who == owner else "ignored"))
                until = 0.0 if holds and who == owner else until
            elif holds and who != owner:
                out.append((i, "refused"))
            else:
                out.append((i, "renewed" if holds else "granted"))
                owner, until = who, now + seconds
        return (owner, until), pd.DataFrame(out, columns=["event_id", "outcome"])

    return by_key(events.withColumn("_release", F.coalesce(release, F.lit(False))), [lock], "event_id long, outcome string", "owner string, until double", ("", 0.0), step, ["ts", "event_id"])


def log_files(events: DataFrame, writer: str, line: Column, most: int) -> DataFrame:
    """event_id, file: the number of the log file that each line of a writer goes to, in order of time; a file that has passed `most` bytes is followed by the next. The state is a size and a number."""

    def step(held, rows):
        file, size, out = held[0], held[1], []
        for i, n in zip(rows["event_id"], rows["_bytes"], strict=True):
            if size > most:
                file, size = file + 1, 0
            out.append((i, file))
            size += int(n) + 1
        return (file, size), pd.DataFrame(out, columns=["event_id", "file"])

    return by_key(events.withColumn("_bytes", F.coalesce(F.octet_length(line), F.lit(0))), [writer], "event_id long, file long", "file long, size long", (0, 0), step, ["ts", "event_id"])


__all__ = ["LATE", "REMEMBERED", "SKETCH", "drop_alerts", "flapping", "locks", "log_files", "hourly_peers", "lru", "near_seen", "quantile_sketches", "quantiles", "reformulations"]
