"""Changing a stored collection: updates, deletions, batches, snapshots, retention. Tables in, tables out; the caller writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(docs: DataFrame, changes: DataFrame, key: str = "url") -> DataFrame:
    """docs with the non-null fields of changes (key and some columns of docs, one row a key) written over."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = docs.join(new, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns])


def delete(docs: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    return docs.join(keys.select(key).distinct(), key, "left_anti").select(*docs.columns)


def ingested(batch: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """batch with its outcome: failed without url or text, duplicate if url or text_hash is known or came earlier in the batch, else added.

    As an insert that adds nothing still succeeds, duplicates count as done.
    """
    first = lambda k: F.row_number().over(Window.partitionBy(k).orderBy(order)) > 1
    ok = F.col("url").isNotNull() & F.col("text").isNotNull()
    good, bad = batch.filter(ok), batch.filter(~ok).withColumn("outcome", F.lit("failed"))
    fresh = good.join(known.select("url", F.lit(True).alias("_u")).distinct(), "url", "left").join(known.select("text_hash", F.lit(True).alias("_h")).distinct(), "text_hash", "left")
    old = F.coalesce("_u", F.lit(False)) | F.coalesce("_h", F.lit(False))
    # Rows that the collection already has do not hide later ones of the batch.
    new = fresh.filter(~old).withColumn("_again", first("url")).withColumn("_twice", first("text_hash"))
    named = new.withColumn("outcome", F.when(F.col("_again") | F.col("_twice"), "duplicate").otherwise("added")).select(*batch.columns, "outcome")
    return named.unionByName(fresh.filter(old).withColumn("outcome", F.lit("duplicate")).select(*batch.columns, "outcome")).unionByName(bad.select(*batch.columns, "outcome"))


def migrated(docs: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """docs with every missing column of {name: (type, default)} added."""
    return docs.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in docs.columns})


def imported(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The rows of a snapshot that docs has neither by url nor by text_hash."""
    return snapshot.join(docs.select("url").distinct(), "url", "left_anti").join(docs.select("text_hash").distinct(), "text_hash", "left_anti").select(*snapshot.columns)


def write_snapshot(docs: DataFrame, path: str, version: int = 1) -> None:
    """docs as zstd Parquet, with a metadata file of version and size beside it."""
    docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    n = docs.sparkSession.read.parquet(f"{path}/rows").agg(F.count("*").alias("n_docs"), F.lit(version).alias("version"))
    n.coalesce(1).write.mode("overwrite").json(f"{path}/meta")  # one row


def read_snapshot(spark, path: str, version: int = 1) -> DataFrame:
    """The rows of a snapshot; another version or a wrong size is an error."""
    meta, rows = spark.read.json(f"{path}/meta").first(), spark.read.parquet(f"{path}/rows")
    if meta["version"] != version:
        raise ValueError(f"snapshot version {meta['version']}, expected {version}")
    if rows.count() != meta["n_docs"]:
        raise ValueError("snapshot is incomplete")
    return rows


def addresses(lines: DataFrame, line: str = "value") -> DataFrame:
    """url: lines of a list that are http addresses, without comments, once each."""
    return lines.select(F.trim(F.regexp_replace(line, r"\r$", "")).alias("url")).filter(F.rlike("url", F.lit("^https?://")) & ~F.col("url").startswith("#")).distinct()


def retained(rows: DataFrame, ts: str, cutoff: float, most: int, tie: str) -> DataFrame:
    """Rows not older than the cutoff, of those the newest `most`; older ones never reach the shuffle."""
    return rows.filter(F.col(ts) >= cutoff).orderBy(F.desc(ts), tie).limit(most)


def audit_line(tool: Column, key: Column, args: Column) -> dict[str, Column]:
    """tool, key_hash (16 hex digits) and the arguments without secrets, at most 1000 characters of JSON."""
    given = F.from_json(args, "map<string,string>")
    safe = F.map_filter(given, lambda k, _: ~k.isin("api_key", "password", "secret"))
    return {"tool": tool, "key_hash": F.when(key != "", F.substring(F.sha2(key, 256), 1, 16)), "arguments": F.when(F.size(given) > 0, F.substring(F.to_json(safe), 1, 1000))}


def metric_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def exposition(metrics: DataFrame) -> DataFrame:
    """name, kind, line order and text of metrics (name, kind, value, n): counters and gauges as they are, summaries with count, sum and average."""
    safe, number = metric_name(F.col("name")), F.format_string("%.3f", F.col("value"))
    head = F.format_string("# TYPE %s %s", safe, F.col("kind"))
    lines = F.when(F.col("kind") == "summary", F.array(head, F.format_string("%s_count %d", safe, F.col("n")), F.concat(safe, F.lit("_sum "), number), F.concat(safe, F.lit("_avg "), F.format_string("%.3f", F.col("value") / F.col("n"))))).otherwise(F.array(head, F.concat(safe, F.lit(" "), number)))
    return metrics.select("name", "kind", F.posexplode(lines).alias("pos", "line"))
