"""JSON rows out, and entries of the JSON-lines index format in."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import covering as cov


def _plain(c: Column, kind: T.DataType) -> Column:
    """A value as JSON can hold it: bytes as lower-case hex, what is not finite as null, maps, decimals and intervals as text."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.MapType):
        return F.to_json(c)
    if isinstance(kind, (T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return c.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object per row (column `json`); nulls are written."""
    cols = [_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


_V1 = "key string, file bigint, row_numbers array<bigint>, value_count bigint, covering struct<listen_count:bigint,total_duration_ms:bigint,min_ts:bigint,max_ts:bigint>, tombstone boolean, file_etag string, file_size bigint, file_mtime_ms bigint"


def read_v1_fragment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Entries and files of a fragment folder with manifest.json and buckets/*.jsonl, for Store.append().

    Where the manifest has no key columns, an entry with one row number and a larger count stands for a run of rows."""
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest.json").first()[0])
    idents = {i["path"]: i for i in manifest.get("file_idents") or []}
    names = manifest.get("files") or []
    files = spark.createDataFrame([(k, n, *((idents.get(n) or {}).get(x) for x in ("size", "mtime_ms", "etag"))) for k, n in enumerate(names)], "file bigint, file_path string, size bigint, mtime bigint, etag string")
    e = spark.read.schema(_V1).json(f"{path}/buckets/*.jsonl").join(files, "file", "left")
    if not manifest.get("key_columns"):
        run = (F.size("row_numbers") == 1) & (F.col("value_count") > 1)
        first = F.element_at("row_numbers", 1)
        e = e.withColumn("row_numbers", F.when(run, F.sequence(first, first + F.col("value_count") - 1)).otherwise(F.col("row_numbers")))
    c = F.col("covering")
    covering = F.when(c.isNotNull(), F.struct(c["listen_count"].alias("value_count"), c["total_duration_ms"].cast("decimal(38,6)").alias("total"), c["min_ts"].alias("min_ts"), c["max_ts"].alias("max_ts"))).cast(cov.TYPE)
    entries = e.select("key", "file_path", "row_numbers", F.coalesce("value_count", "covering.listen_count", F.size("row_numbers").cast("long")).alias("value_count"), covering.alias("covering"), F.coalesce("file_size", "size").alias("file_size"), F.coalesce("file_mtime_ms", "mtime").alias("file_mtime_ms"), F.coalesce("file_etag", "etag").alias("file_etag"), F.coalesce("tombstone", F.lit(False)).alias("tombstone"))
    live = files.select("file_path", F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime_ms"), F.col("etag").alias("file_etag"), F.lit("live").alias("role"))
    return entries, live, manifest
