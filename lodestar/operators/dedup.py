"""URL and content identity, SimHash near duplicates, ingest."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import settle

# Query parameters that do not identify a page; shingle width; most differing bits.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid mc_cid mc_eid ref source".split()
SHINGLE, MOST_BITS = 3, 3


def _decoded(x: Column) -> Column:
    """Percent signs and plus signs of a query part read; what cannot be read stays."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encoded(x: Column) -> Column:
    """A query part as form encoding writes it: letters, digits and _.-~ as they are, blanks as plus signs."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the rest sorted by key and encoded anew, no trailing slash."""
    head = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p, i: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), i.alias("i"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


#: Bits of a counter, of which a long holds two.
COUNTER = 31


def simhash(docs: DataFrame, value: str = "text", key: str = "doc_id") -> DataFrame:
    """key, simhash over runs of SHINGLE words: bit i is set when the shingles' hashes (first 8 bytes of MD5) have it at least as often as not.

    A shorter text is one shingle, an empty one gives 0. Each long sums two bits' counters
    at once, and sums are partial before rows are dealt.
    """
    words = docs.select(key, text.words(F.col(value)).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, SHINGLE), " "))
    rows = words.select(key, F.explode_outer(F.when(F.size("w") > 0, runs)).alias("s"))
    rows = rows.select(key, F.conv(F.substring(F.md5("s"), 1, 16), 16, -10).cast("long").alias("h"))
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))
    packed = [bit(2 * c) + F.shiftleft(bit(2 * c + 1), COUNTER) for c in range(32)]
    sums = rows.groupBy(key).agg(F.count("h").alias("n"), *[F.sum(x).alias(f"c{c}") for c, x in enumerate(packed)])
    count = lambda b: F.shiftrightunsigned(f"c{b // 2}", COUNTER * (b % 2)).bitwiseAND(F.lit((1 << COUNTER) - 1))
    signed = lambda b: (1 << b) - (1 << 64 if b == 63 else 0)
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(2 * count(b) >= F.col("n"), F.lit(signed(b))).otherwise(F.lit(0).cast("long")))
    return sums.select(key, F.when(F.col("n") > 0, out).otherwise(F.lit(0).cast("long")).alias("simhash"))


def fingerprint(value: Column) -> Column:
    """simhash() of a text by itself, for streams and filters, where no rows are grouped."""

    @F.arrow_udf("long")
    def voted(lists: pa.Array) -> pa.Array:
        """The bits that at least half of the hashes of each row's runs of words have; no words give 0."""
        out = np.zeros(len(lists), ">i8")
        for i in range(len(lists)):
            w = lists[i].as_py()
            runs = [" ".join(w[j : j + SHINGLE]).encode() for j in range(max(1, len(w) - SHINGLE + 1))] if w else []
            if runs:
                bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(x).digest()[:8] for x in runs), np.uint8).reshape(-1, 8), axis=1)
                out[i : i + 1] = np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(runs)).view(">i8")
        return pa.array(out.astype(np.int64))

    # The runs are made there: Spark would take the words from the text anew for every run.
    return voted(text.words(F.coalesce(value, F.lit(""))))


def choices(simhash: Column, most: int = MOST_BITS, agree: int = 3) -> Column:
    """(choice, part): the bits of a fingerprint in each choice of `agree` of most + agree bands. Fingerprints at most `most` bits apart share one."""
    borders = [round(64 * i / (most + agree)) for i in range(most + agree + 1)]
    masks = [sum(((1 << (borders[i + 1] - borders[i])) - 1) << borders[i] for i in chosen) for chosen in itertools.combinations(range(most + agree), agree)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.struct(F.lit(i).alias("choice"), simhash.bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)])


def members(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a: the row that stands for each row's fingerprint in near_pairs(), itself included."""
    return hashes.join(hashes.groupBy("simhash").agg(F.min(key).alias("a")), "simhash").select(key, "a")


def near_pairs(hashes: DataFrame, key: str = "doc_id", most: int = MOST_BITS, agree: int = 3) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `most` bits apart, with the distance.

    Of most + agree bands, such fingerprints agree in `agree` at least, so they meet under one
    choice of so many: half of the bits with three of six, enough for any number of rows.
    Equal fingerprints are joined as one, the smallest key standing for them; members() tells for which rows.
    """
    reps = settle(hashes.groupBy("simhash").agg(F.min(key).alias("k")))
    rows = reps.select("k", "simhash", F.inline(choices(F.col("simhash"), most, agree)))
    x, y = rows.alias("x"), rows.alias("y")
    d = F.bit_count(F.col("x.simhash").bitwiseXOR(F.col("y.simhash")))
    both = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.k") < F.col("y.k")) & (d <= most))
    return both.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), d.alias("distance")).distinct()


def ingest(docs: DataFrame) -> DataFrame:
    """Documents that an empty index accepts in doc_id order: the first of every URL and of every text."""
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("doc_id"))
    once = docs.withColumn("text_hash", F.sha2("text", 256)).withColumn("u", first("url")).filter("u = 1").withColumn("t", first("text_hash")).filter("t = 1")
    return once.drop("u", "t")


def content_diff(old: Column, new: Column) -> dict[str, Column]:
    """Lines added, removed, and the share of changed lines over all distinct lines."""
    a, b = F.array_distinct(F.split(old, "\n")), F.array_distinct(F.split(new, "\n"))
    full = lambda x: F.size(F.filter(x, lambda v: F.trim(v) != ""))
    added, removed = full(F.array_except(b, a)), full(F.array_except(a, b))
    return {"added": added, "removed": removed, "ratio": F.round((added + removed) / F.greatest(F.lit(1), F.size(F.array_union(a, b))), 3)}


def _leaf(digest: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), digest), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in an order: a range partitioning and the counts of its parts, no window over all rows."""
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("base"))
    # A row a partition.
    before = sizes.select(F.col("_p"), "base", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("pos", F.col("_i") - F.col("base") + F.col("before")).drop("_p", "_i", "base", "before")


def _levels(leaves: DataFrame, n: int) -> list[DataFrame]:
    """(pos, h) of every level of a hash tree, the leaves first; the pairs of one level are the nodes of the next, a last single one is paired with itself."""
    out = [leaves]
    while n > 1:
        pairs = out[-1].groupBy(F.expr("pos div 2").alias("up")).agg(F.min_by("h", "pos").alias("l"), F.max_by("h", "pos").alias("r"))
        out.append(pairs.select(F.col("up").alias("pos"), F.sha2(F.concat("l", "r"), 256).alias("h")))
        n = (n + 1) // 2
    return out


def merkle_root(rows: DataFrame, order: str, leaf: str) -> DataFrame:
    """One row, root, over the digests `leaf` of rows in an order; no rows give none."""
    leaves = numbered(rows.select(order, leaf), [order, leaf]).select("pos", _leaf(F.col(leaf)).alias("h"))
    return _levels(leaves, leaves.count())[-1].select(F.col("h").alias("root"))


def merkle_proofs(rows: DataFrame, order: str, leaf: str) -> DataFrame:
    """order, leaf, pos, path, root: for every row the siblings from its leaf to the root, (h, left) each.

    Levels are settled, twice the rows in all. From the root down, the children of a node
    take its path and each other's digest, so a level is joined once, and a row with the
    paths of its own level alone.
    """
    named = settle(numbered(rows.select(order, leaf), [order, leaf]))
    n = named.count()
    levels = [named.select("pos", _leaf(F.col(leaf)).alias("h"))]
    while n > 1:
        levels.append(settle(_levels(levels[-1], 2)[1]))
        n = (n + 1) // 2
    step = "array<struct<h:string,left:boolean>>"
    paths = levels[-1].select("pos", F.array().cast(step).alias("path"))
    for level in reversed(levels[:-1]):
        pairs = level.groupBy(F.expr("pos div 2").alias("up")).agg(F.min_by("h", "pos").alias("l"), F.max_by("h", "pos").alias("r"), F.count("*").alias("n"))
        both = pairs.join(paths.withColumnRenamed("pos", "up"), "up")
        child = lambda side, sibling, left: F.struct((F.col("up") * 2 + side).alias("pos"), F.concat(F.array(F.struct(F.col(sibling).alias("h"), F.lit(left).alias("left"))), F.col("path")).alias("path"))
        paths = settle(both.select(F.inline(F.when(F.col("n") == 2, F.array(child(0, "r", False), child(1, "l", True))).otherwise(F.array(child(0, "l", False))))))
    root = levels[-1].select(F.col("h").alias("root"))
    return named.join(paths, "pos").crossJoin(F.broadcast(root))  # one row


def proof_holds(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from the digest of a row to the root."""
    return F.aggregate(path, _leaf(leaf), lambda h, s: F.sha2(F.when(s["left"], F.concat(s["h"], h)).otherwise(F.concat(h, s["h"])), 256)) == root
