"""Sample listening history and physical layouts of a keyed table, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUTS = ("unsorted", "sorted", "key_pages", "cogrouped", "blob")
_BASE_MS, _DAY_MS, _GAP_MS = 1_700_000_000_000, 86_400_000, 180_000


def _draw(seed: int, what: str, below: int):
    """A number from 0 to below - 1 by hash, the same whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "u", "i"), F.lit(below))


def sample_listens(spark: SparkSession, users: int = 24, per_user: int = 6, seed: int = 42, prefix: str = "user") -> DataFrame:
    """user_id, timestamp, track_uri, duration_ms; seeded."""
    rows = spark.range(users).select(F.col("id").alias("u")).crossJoin(F.broadcast(spark.range(per_user).select(F.col("id").alias("i"))))
    ms = F.lit(_BASE_MS) + F.col("u") * _DAY_MS + F.col("i") * _GAP_MS + _draw(seed, "t", 60_000)
    return rows.select(
        F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("u").cast("string"), 4, "0") if users <= 10_000 else F.col("u").cast("string")).alias("user_id"),
        F.timestamp_millis(ms).cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("track:"), F.lpad(_draw(seed, "track", 5000).cast("string"), 8, "0")).alias("track_uri"),
        (_draw(seed, "d", 300_000) + 60_000).alias("duration_ms"),
    )


def cogrouped(rows: DataFrame, key: str, order: str, items: str = "listens") -> DataFrame:
    """A row per key with its other columns as a list of structs, by order. A key's list is one value: the layout is for keys of bounded size."""
    rest = [order, *[c for c in rows.columns if c not in (key, order)]]
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(items))


def blob(rows: DataFrame, key: str, time: str, items: str = "listens") -> DataFrame:
    """A row per key with a JSON document of its items, and the same as bytes."""
    rest = [c for c in rows.columns if c not in (key, time)]
    stamped = rows.select(key, F.unix_millis(F.col(time).cast("timestamp")).alias("timestamp_ms"), *rest)
    out = cogrouped(stamped, key, "timestamp_ms", items)
    doc = F.to_json(F.struct(F.col(items)))
    return out.select(key, doc.alias("payload"), doc.cast("binary").alias("payload_bytes"))


def write_layout(rows: DataFrame, path: str, layout: str, key: str = "user_id", time: str = "timestamp", files: int = 2, partition_by: tuple = (), page_rows: int = 100) -> None:
    """Writes rows in one of LAYOUTS; key_pages: sorted, with pages of few rows, so that a key's rows stand on few pages."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    if layout == "unsorted":
        out = rows.repartition(files, F.xxhash64(*rows.columns))
    else:
        wide = cogrouped(rows, key, time) if layout == "cogrouped" else blob(rows, key, time) if layout == "blob" else rows
        out = wide.repartition(files, key).sortWithinPartitions(*([key, time] if time in wide.columns else [key]))
    w = out.write.mode("overwrite").option("compression", "zstd")
    if layout == "key_pages":
        w = w.option("parquet.page.row.count.limit", page_rows).option("parquet.page.size.row.check.min", min(page_rows, 100))
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def lake(spark: SparkSession, path: str, users: int, per_user: int, days: int = 1, buckets: int = 8, seed: int = 42, layout: str = "sorted") -> None:
    """A lake of date=…/bucket=… folders."""
    rows = sample_listens(spark, users, per_user, seed)
    h = F.pmod(F.xxhash64("user_id"), F.lit(days * buckets))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (h % days).cast("int")), "yyyy-MM-dd")
    rows = rows.withColumn("date", day).withColumn("bucket", F.lpad((h / days).cast("int").cast("string"), 3, "0"))
    rows = rows.repartition(days * buckets, "date", "bucket").sortWithinPartitions("user_id", "timestamp")
    rows.write.mode("overwrite").partitionBy("date", "bucket").parquet(path)
