"""Files from outside, written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance
from ..registry import query
from ..sources import records
from ..sources.tables import DOCUMENTS_SQL, documents, table
from ..storage import new_path

_BLANK = "chr(32) || chr(10) || chr(13) || chr(9)"


@query("wet_files", f"WITH {DOCUMENTS_SQL}, b AS (SELECT url, substr(trim(text, {_BLANK}), 1, 102400) AS body FROM docs) SELECT url, length(body) AS n_chars, sha256(body) AS digest FROM b WHERE length(body) >= 50")
def wet_files(spark, sf_dir):
    """All documents written as gzipped web archives of several records and read by record, whatever a file's size."""
    path = new_path(spark, "wet")
    record = F.concat(F.lit("WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: "), "url", F.lit("\nContent-Type: text/plain\n\n"), "text", F.lit("\n"))
    documents(spark, sf_dir).filter("text is not null").select(record).write.option("compression", "gzip").text(path)
    rows = records.wet(spark, path)
    return rows.select(F.col("target").alias("url"), F.length("body").alias("n_chars"), F.sha2("body", 256).alias("digest"))


@query("seed_files", "SELECT DISTINCT trim(url) AS url FROM pages WHERE regexp_matches(url, '^https?://')")
def seed_files(spark, sf_dir):
    """The addresses of all pages written as seed lists with comments, one file for each of four categories, and read again."""
    path = new_path(spark, "seeds")
    pages = table(spark, sf_dir, "pages").select("url", F.pmod("page_id", F.lit(4)).alias("category"))
    for c in range(4):
        lines = pages.filter(F.col("category") == c).select(F.explode(F.array(F.lit("# seeds"), F.concat("url", F.lit(" ")), F.lit(""))).alias("value"))
        lines.write.text(f"{path}/{c}.txt")
    return records.seeds(spark, path)


@query("snapshot_files", f"WITH {DOCUMENTS_SQL} SELECT doc_id, url, sha256(text) AS text_hash FROM docs WHERE doc_id % 3 > 0")
def snapshot_files(spark, sf_dir):
    """A snapshot of all documents, written with its version and size, read, and imported where a third is known already."""
    path = new_path(spark, "snapshot")
    docs = documents(spark, sf_dir).select("doc_id", "url", F.sha2("text", 256).alias("text_hash"))
    maintenance.write_snapshot(docs, path)
    known = docs.filter("doc_id % 3 = 0").select("url", F.lit(None).cast("string").alias("text_hash"))
    return maintenance.imported(known, maintenance.read_snapshot(spark, path))


@query("compacted_files", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, 1 AS files FROM events GROUP BY event_type")
def compacted_files(spark, sf_dir):
    """The events, written as many small files and compacted into one, as large as files may be here."""
    path, to = new_path(spark, "many"), new_path(spark, "few")
    table(spark, sf_dir, "events").repartition(16).write.parquet(path)
    files = records.compact(spark, path, to, 1 << 40)
    return spark.read.parquet(to).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).withColumn("files", F.lit(files))
