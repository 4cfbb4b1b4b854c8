"""Links between pages, degrees and domain authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Damping, rounds, weight of links inside a domain.
DAMPING, ROUNDS, SELF_WEIGHT = 0.85, 20, 0.1


#: Endings of targets that are no pages.
SKIPPED = ".pdf .jpg .jpeg .png .gif .svg .webp .mp3 .mp4 .avi .mov .zip .tar .gz .exe .dmg .iso .css .js .woff .woff2".split()


def resolved(link: Column, page: Column) -> Column:
    """The absolute form of a link on a page: dot segments are followed, fragments dropped; null if it is no address."""
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    base = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1))
    bare = F.regexp_replace(link, "#.*$", "")
    own, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    full = F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = F.split(F.regexp_replace(full, "^/", ""), "/")
    last = F.element_at(steps, -1)
    walk = lambda done, x: F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    flat = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))
    flat = F.when(last.isin("..", ".") & ~flat.endswith("/"), F.concat(flat, F.lit("/"))).otherwise(flat)
    return (
        F.when(F.rlike(bare, F.lit("^(?i)https?://")), bare)
        .when(F.rlike(bare, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), None)
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(F.rlike(base, F.lit("^(?i)https?://.")), F.concat(base, flat, query))
    )


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """source_url, target_url, source_domain, target_domain: distinct http links, resolved against the page, fragments dropped."""
    href = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#][^"']*)"""), 1)
    rows = pages.select(F.col(url).alias("source_url"), F.explode(F.array_distinct(href)).alias("h"))
    rows = rows.select("source_url", resolved(F.trim("h"), F.col("source_url")).alias("target_url")).filter("target_url is not null").distinct()
    path = F.lower(F.regexp_extract("target_url", "://[^/?#]*([^?#]*)", 1))
    host = lambda c: F.lower(F.regexp_extract(c, "://([^/?#]*)", 1))
    rows = rows.filter(~F.rlike(path, F.lit("(" + "|".join(x.replace(".", r"\.") for x in SKIPPED) + ")$")))
    return rows.withColumns({"source_domain": host(F.col("source_url")), "target_domain": host(F.col("target_url"))}).filter("target_domain <> ''")


def degrees(edges: DataFrame) -> DataFrame:
    """domain, n_in (distinct other domains that link to it) and n_out (distinct other domains it links to)."""
    e = edges.filter("source_domain <> target_domain").select("source_domain", "target_domain").distinct()
    names = edges.select(F.col("source_domain").alias("domain")).union(edges.select("target_domain")).distinct()
    n_in = e.groupBy(F.col("target_domain").alias("domain")).agg(F.count("*").alias("n_in"))
    n_out = e.groupBy(F.col("source_domain").alias("domain")).agg(F.count("*").alias("n_out"))
    return names.join(n_in, "domain", "left").join(n_out, "domain", "left").na.fill(0, ["n_in", "n_out"])


def authority(edges: DataFrame, rounds: int = ROUNDS, every: int = 5) -> DataFrame:
    """domain, score: PageRank over weighted domain links, dangling mass dropped, divided by the largest, rounded to 6.

    Ranks are one row a domain; lineage is cut with a reliable checkpoint every few rounds
    if the session has a checkpoint folder.
    """
    w = edges.groupBy("source_domain", "target_domain").agg(F.count("*").alias("n"))
    w = w.withColumn("w", F.when(F.col("source_domain") == F.col("target_domain"), F.col("n") * SELF_WEIGHT).otherwise(F.col("n").cast("double")))
    total = w.groupBy("source_domain").agg(F.sum("w").alias("total"))
    share = w.join(total, "source_domain").select("source_domain", "target_domain", (F.col("w") / F.col("total")).alias("share"))
    names = edges.select(F.col("source_domain").alias("domain")).union(edges.select("target_domain")).distinct()
    n = names.count()
    ranks = names.withColumn("score", F.lit(1.0 / max(1, n)))
    folder = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not edges.sparkSession.sparkContext.getCheckpointDir():
        edges.sparkSession.sparkContext.setCheckpointDir(folder)
    if folder:
        share = share.checkpoint()
    for i in range(rounds):
        got = share.join(ranks, share["source_domain"] == ranks["domain"]).groupBy("target_domain").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        ranks = names.join(got, names["domain"] == got["target_domain"], "left").select("domain", ((1 - DAMPING) / max(1, n) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"))
        if folder and (i + 1) % every == 0:
            ranks = ranks.checkpoint()
    top = ranks.agg(F.max("score").alias("top"))
    return ranks.join(F.broadcast(top)).select("domain", F.round(F.col("score") / F.col("top"), 6).alias("score"))


def merged_pointers(existing: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """term, peer, doc_id, score, place: two lists of pointers (term, peer, doc_id, score, place) as one of a keyword's first `limit`, the new ones first; a peer and document once, as the first has it. Pointers without a peer or document go."""
    both = new.withColumn("_old", F.lit(0)).unionByName(existing.withColumn("_old", F.lit(1))).filter("peer is not null and doc_id is not null")
    first = both.groupBy("term", "peer", "doc_id").agg(F.min_by("score", F.struct("_old", "place")).alias("score"), F.min(F.struct("_old", "place")).alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("at", "peer", "doc_id")))
    return placed.filter(F.col("place") <= limit).select("term", "peer", "doc_id", "score", "place")
