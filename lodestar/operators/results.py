"""Result lists after ranking: merged, without look-alikes, packed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passages, scores, shaping, text

#: Share of words from which two results are the same to a reader.
ALIKE = 0.7


def merged(local: DataFrame, remote: DataFrame) -> DataFrame:
    """query_id, url, score, src (0 local, 1 remote) and place: local results win over remote ones of the same address, then the score orders all."""
    both = local.withColumn("src", F.lit(0)).unionByName(remote.withColumn("src", F.lit(1)))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("src", "rank"))).filter("n = 1")
    return first.select("query_id", "url", "score", "src", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "src", "url")).alias("place"))


def look_alikes(rows: pd.DataFrame, alike: float = ALIKE) -> pd.DataFrame:
    """The rows of one ranked list that no kept row before them resembles."""
    seen, kept, keep = set(), [], []
    for row in rows.sort_values("rank").itertuples():
        url, words = row.url.rstrip("/"), set(f"{row.title} {row.snippet}".lower().split())
        if url in seen or any(words and w and len(words & w) / len(words | w) >= alike for w in kept):
            continue
        seen.add(url)
        kept.append(words)
        keep.append(row.Index)
    return rows.loc[keep]


def without_look_alikes(hits: DataFrame, alike: float = ALIKE) -> DataFrame:
    """hits (query_id, rank, url, title, snippet) without look-alikes. Each row is compared with those kept before it, so lists, which are short, are walked in Python."""
    return hits.groupBy("query_id").applyInPandas(lambda rows: look_alikes(rows, alike), hits.schema)


def mismatches(rows: DataFrame, subject: str, key: str, words: str, least: float) -> DataFrame:
    """s (the subject), a, b (a < b): rows of one subject whose sets of words share less than `least`; an empty set shares nothing."""
    a, b = (rows.select(F.col(subject).alias("s"), F.col(key).alias(k), F.col(words).alias(f"w{k}")) for k in ("a", "b"))
    shared = F.when((F.size("wa") == 0) | (F.size("wb") == 0), 0.0).otherwise(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")))
    return a.join(b, "s").filter((F.col("a") < F.col("b")) & (shared < least)).select("s", "a", "b")


def dense_snippets(rows: DataFrame, keys: list[str], size: int = 40) -> DataFrame:
    """keys, n_terms, start, snippet of rows (keys, text, terms): the window of `size` words that holds the most different terms, the first of such.

    Every best window can begin at a term, so the terms' places are rows and each looks
    ahead. Words that the window has to spare go half before its first term. Without a
    term it is the start of the text.
    """
    places = rows.select(*keys, F.inline(shaping.hits(F.col("text"), F.col("terms"))))
    ahead = Window.partitionBy(*keys).orderBy("pos").rangeBetween(0, size - 1)
    seen = places.select(*keys, "pos", F.size(F.collect_set("term").over(ahead)).alias("n"), F.max("pos").over(ahead).alias("last"))
    best = seen.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("pos")).alias("back"), "last")).alias("b"))
    first = -F.col("b.back")
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b.n").alias("n_terms"), F.greatest(first - F.floor((size - (F.col("b.last") - first + 1)) / 2), F.lit(0)).cast("int").alias("start"))
    both = rows.join(best, F.expr(" and ".join(f"{k} <=> _{k}" for k in keys)), "left").withColumns({"start": F.coalesce("start", F.lit(0)), "n_terms": F.coalesce("n_terms", F.lit(0))})
    return both.select(*keys, "n_terms", "start", shaping.shown_window(F.col("text"), F.col("terms"), F.col("start"), size).alias("snippet"))


def best_passages(rows: DataFrame, keys: list[str], most: int = 300) -> DataFrame:
    """keys, passage, score of rows (keys, text, wanted tokens): the passage of at most so many characters that fits best, the first at a tie; the start of the text where none fits."""
    cut = rows.select(*keys, F.substring("text", 1, 200).alias("start"), "wanted", F.posexplode_outer(passages.passages(F.col("text"), most)).alias("pos", "passage"))
    score = F.coalesce(scores.passage_score(text.ascii_tokens(F.col("passage")), F.col("wanted")), F.lit(0.0))
    best = cut.withColumn("score", score).groupBy(*keys).agg(F.max_by(F.struct("passage", "score", "start"), F.struct("score", -F.coalesce("pos", F.lit(0)))).alias("b"))
    return best.select(*keys, F.when(F.col("b.score") > 0, F.substring("b.passage", 1, most)).otherwise(F.col("b.start")).alias("passage"), F.col("b.score").alias("score"))


def enhanced(rows: DataFrame, keys: list[str], long: int = 80, most: int = 300) -> DataFrame:
    """rows (keys, text, wanted, snippet) with better snippets: a short one, or one without a wanted word, gives way to the best passage of the text if that is longer."""
    good = (F.length("snippet") >= long) & F.arrays_overlap(text.ascii_tokens(F.col("snippet")), F.col("wanted"))
    poor = rows.filter(~F.coalesce(good, F.lit(False)) & F.col("text").isNotNull())
    found = best_passages(poor.select(*keys, "text", "wanted"), keys, most).select(*[F.col(k).alias(f"_{k}") for k in keys], "passage")
    both = rows.join(found, F.expr(" and ".join(f"{k} <=> _{k}" for k in keys)), "left")
    better = F.length("passage") > F.coalesce(F.length("snippet"), F.lit(0))
    return both.select(*[F.when(better, F.col("passage")).otherwise(F.col(c)).alias(c) if c == "snippet" else F.col(c) for c in rows.columns])


def packed(rows: DataFrame, most: int) -> DataFrame:
    """query_id, context: the entries (query_id, rank, entry) in order until the next would exceed so many characters."""
    used = F.sum(F.length("entry")).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = rows.withColumn("used", used).filter(F.col("used") <= most)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n\n").alias("context"))
