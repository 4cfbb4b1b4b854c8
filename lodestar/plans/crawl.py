"""When to fetch what again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedup
from ..registry import query
from ..sources.tables import DOCUMENTS_SQL, NOW, documents

_FREQ = "(doc_id % 20) / 20.0"
_INTERVAL = f"CASE WHEN {_FREQ} = 0 THEN 2592000 WHEN {_FREQ} < 0.1 THEN 604800 WHEN {_FREQ} <= 0.5 THEN 86400 ELSE 21600 END"
_DUE_SQL = f"{DOCUMENTS_SQL}, du AS (SELECT doc_id, url, source, crawled_at, {NOW}::DOUBLE - (crawled_at + {_INTERVAL}) AS overdue FROM docs)"


def due(spark, sf_dir):
    """Documents whose recrawl period is over, with the seconds since then."""
    d = documents(spark, sf_dir)
    return d.withColumn("overdue", F.lit(NOW) - (F.col("crawled_at") + F.expr(_INTERVAL)))


@query("recrawl_due", f"WITH {_DUE_SQL} SELECT doc_id, overdue FROM du WHERE overdue >= 0 ORDER BY overdue DESC, doc_id LIMIT 50")
def recrawl_due(spark, sf_dir):
    return due(spark, sf_dir).filter("overdue >= 0").orderBy(F.desc("overdue"), "doc_id").limit(50).select("doc_id", "overdue")


_PRIORITY = "CASE WHEN overdue > 2592000 THEN 1 WHEN overdue > 604800 THEN 2 ELSE 3 END"


@query("recrawl_queue", f"WITH {_DUE_SQL}, q AS (SELECT url, {_PRIORITY} AS priority, crawled_at FROM du WHERE overdue >= 0) SELECT url, priority, row_number() OVER (PARTITION BY priority ORDER BY crawled_at, url) AS place FROM q")
def recrawl_queue(spark, sf_dir):
    """Unique URLs by priority, then age; places count within a priority."""
    rows = due(spark, sf_dir).filter("overdue >= 0").withColumn("priority", F.expr(_PRIORITY)).groupBy("url", "priority").agg(F.min("crawled_at").alias("crawled_at"))
    return rows.select("url", "priority", F.row_number().over(Window.partitionBy("priority").orderBy("crawled_at", "url")).alias("place"))


@query(
    "feeds_due",
    f"WITH {DOCUMENTS_SQL}, f AS (SELECT source AS feed, length(source) % 3 AS priority, CASE WHEN max(doc_id) % 5 = 0 THEN NULL ELSE min(crawled_at) END AS polled FROM docs GROUP BY source), o AS (SELECT feed, priority, CASE WHEN polled IS NULL THEN 0 ELSE {NOW}::DOUBLE - polled - 3600 END AS overdue FROM f) SELECT feed, priority, overdue, row_number() OVER (ORDER BY priority, overdue DESC, feed) AS place FROM o WHERE overdue >= 0",
)
def feeds_due(spark, sf_dir):
    """Feeds (sources) by priority, then most overdue; a feed never polled is due but not overdue, hence after those that are."""
    f = documents(spark, sf_dir).groupBy(F.col("source").alias("feed")).agg(F.when(F.max("doc_id") % 5 == 0, None).otherwise(F.min("crawled_at")).alias("polled"))
    rows = f.select("feed", (F.length("feed") % 3).alias("priority"), F.when(F.col("polled").isNull(), 0.0).otherwise(F.lit(NOW) - F.col("polled") - 3600).alias("overdue")).filter("overdue >= 0")
    placed = dedup.numbered(rows.withColumn("_late", -F.col("overdue")), ["priority", "_late", "feed"])
    return placed.select("feed", "priority", "overdue", (F.col("pos") + 1).alias("place"))
