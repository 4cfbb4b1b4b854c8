"""Files from outside: web archives, address lists, seeds, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction, maintenance

#: Bytes of a file above which it is not read whole.
MOST_BYTES = 256 << 20


def whole_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path and content of text files; Spark's codecs read .gz and others. A file of more than so many bytes is an error, as a row must fit a task: wet() reads such by record."""
    large = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") > most).orderBy(F.desc("length")).first()  # contents are not read
    if large is not None:
        raise ValueError(f"{large['path']} has {large['length']} bytes, more than {most}; read it by record")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def wet(spark: SparkSession, path: str) -> DataFrame:
    """target and body of the conversion records of WET files, plain or .gz, of any size: a record is a row as it is read."""
    records = spark.read.text(path, lineSep="WARC/1.0")
    return extraction.wet_records(records.select(F.concat(F.lit("WARC/1.0"), "value").alias("content")))


def seeds(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """url: the addresses of seed files, NAME.txt for each category."""
    return maintenance.addresses(spark.read.text(f"{path.rstrip('/')}/{category or '*'}.txt"))


def write_warc(pages: DataFrame, path: str, date: str) -> None:
    """Pages (page_id, url, html) as gzipped archive files, a record after the other."""
    # The last line end of a record is the writer's.
    records = extraction.warc_records(pages, date).select(F.regexp_replace("record", "\r\n\\z", "").alias("record"))
    records.write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def compact(spark: SparkSession, path: str, to: str, bytes_a_file: int = 128 << 20) -> int:
    """Writes a table of many small files as one of files of about so many bytes, and returns their number."""
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // bytes_a_file))
    spark.read.parquet(path).repartition(int(n)).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return int(n)
