"""The input tables and the columns derived from them; SQL twins of the derivations are beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scoring time of every query, in seconds since the epoch: 2024-01-31 00:00:00 UTC.
NOW = 1706659200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source with title (first line), url, domain and crawled_at (seconds)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumns(
        {
            "title": F.trim(F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 200)),
            "url": F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")),
            "domain": F.col("source"),
            "crawled_at": F.lit(NOW) - F.col("doc_id") * 3600.0,
        }
    )


DOCUMENTS_SQL = f"""docs AS (SELECT doc_id, text, lang, source, trim(substr(split_part(text, chr(10), 1), 1, 200)) AS title,
 'https://' || source || '/' || doc_id AS url, source AS domain, {NOW}::DOUBLE - doc_id * 3600.0::DOUBLE AS crawled_at FROM documents)"""

#: Literal queries, beside which the first words of every benchmark text are queries as well.
LITERAL_QUERIES = [(-1, "the of and"), (-2, "tion the"), (-3, "le de la")]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: three literal queries and the first three words of every benchmark text."""
    literal = spark.createDataFrame(LITERAL_QUERIES, "query_id long, query string")
    words = F.array_join(F.slice(F.split("text", r"[ \n]+"), 1, 3), " ")
    return literal.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query")))


QUERIES_SQL = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in LITERAL_QUERIES) + """) v(query_id, query)
 UNION ALL SELECT item_id, array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ') FROM benchmark)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, peer, action, value and ts (seconds) of every event."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("peer"), "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


EVENTS_SQL = "ev AS (SELECT event_id, user_id AS peer, event_type, value, epoch_us(ts) / 1e6 AS ts FROM events)"
