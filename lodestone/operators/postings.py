"""Key -> (file, row numbers) postings of a table, and deletes applied to them."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import covering as cov
from ..functions.keys import key_expr

_COVERING = T.StructType([T.StructField("value_count", T.LongType()), T.StructField("total", T.DecimalType(38, 6)), T.StructField("min_ts", T.LongType()), T.StructField("max_ts", T.LongType())])
SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("fragment_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("row_numbers", T.ArrayType(T.LongType())),
        T.StructField("value_count", T.LongType()),
        T.StructField("covering", _COVERING),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_mtime_ms", T.LongType()),
        T.StructField("file_etag", T.StringType()),
        T.StructField("tombstone", T.BooleanType()),
    ]
)


def with_address(data: DataFrame) -> DataFrame:
    """A Parquet scan with the address of each row: _file, _row, _size, _mtime."""
    m = F.col("_metadata")
    return data.select("*", m["file_path"].alias("_file"), m["row_index"].alias("_row"), m["file_size"].alias("_size"), F.unix_millis(m["file_modification_time"]).alias("_mtime"))


def canonical(path: Column) -> Column:
    """One spelling for the ways in which a file's path is written: file:/a, file:///a and /a are the same; s3a and s3n are s3."""
    p = F.regexp_replace(path, r"^file:/*", "/")
    return F.regexp_replace(p, r"^s3[an]://", "s3://")


def readable(path: str) -> str:
    """A metadata path as the reader wants it: not percent-encoded."""
    return unquote(path)


def apply_position_deletes(rows: DataFrame, deletes: DataFrame, file_col: str = "_file", row_col: str = "_row", seq_col: str | None = None) -> DataFrame:
    """rows without those at (file_path, pos) of deletes. With seq_col, a delete touches rows of its sequence number or less."""
    d = deletes.select(canonical(F.col("file_path")).alias("_df"), F.col("pos").cast("long").alias("_dp"), *([F.col("seq").alias("_ds")] if seq_col else [])).distinct()
    on = (canonical(F.col(file_col)) == F.col("_df")) & (F.col(row_col) == F.col("_dp"))
    return rows.join(d, on & (F.col(seq_col) <= F.col("_ds")) if seq_col else on, "left_anti")


def apply_equality_deletes(rows: DataFrame, deletes: Sequence[DataFrame], seq_col: str | None = None) -> DataFrame:
    """rows that equal no delete record on all its columns, nulls being equal; a join for each set of columns.

    With seq_col, a delete (its column `seq`) touches rows of a smaller sequence number only."""
    for k, d in enumerate(deletes):
        names = [c for c in d.columns if c != "seq"]
        missing = [c for c in names if c not in rows.columns]
        if missing:
            raise ValueError(f"equality delete on unknown column `{missing[0]}`")
        x = d.select(*[F.col(f"`{c}`").alias(f"_d{k}_{c}") for c in names], *([F.col("seq").alias("_dseq")] if seq_col else [])).distinct()
        on = None
        for c in names:
            test = F.col(f"`{c}`").eqNullSafe(F.col(f"`_d{k}_{c}`").cast(rows.schema[c].dataType))
            on = test if on is None else on & test
        rows = rows.join(x, on & (F.col(seq_col) < F.col("_dseq")) if seq_col else on, "left_anti")
    return rows


def postings(data: DataFrame, keys: Sequence[str], covering: cov.Covering | None = None, position_deletes: DataFrame | None = None, equality_deletes: Sequence[DataFrame] = ()) -> DataFrame:
    """One row per (key, file) of a Parquet scan: key, file_path, row_numbers, value_count, covering, file_size, file_mtime_ms.

    Only key, time and measure columns (and those of equality deletes) are read."""
    extra = cov.columns(covering, data.schema) if covering else {}
    key = key_expr(data.schema, keys)
    rows = with_address(data)
    if position_deletes is not None:
        rows = apply_position_deletes(rows, position_deletes)
    rows = apply_equality_deletes(rows, equality_deletes)
    rows = rows.select(key.alias("key"), "_file", "_row", "_size", "_mtime", *[v.alias(k) for k, v in extra.items()]).filter("key is not null")
    out = rows.groupBy("key", F.col("_file").alias("file_path")).agg(
        F.sort_array(F.collect_list("_row")).alias("row_numbers"),  # no more than the rows of one file
        F.count(F.lit(1)).alias("_rows"),
        F.max("_size").alias("file_size"),
        F.max("_mtime").alias("file_mtime_ms"),
        *([cov.aggregate().alias("covering")] if covering else []),
    )
    if not covering:
        out = out.withColumn("covering", F.lit(None).cast(cov.TYPE))
    return out.withColumn("value_count", F.coalesce("covering.value_count", "_rows")).drop("_rows")


def join_at(rows: DataFrame, at: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """rows at addresses that come from lists of row numbers. few: they are sent to all tasks; otherwise both sides are dealt by address.

    Never left to Spark: it takes the addresses for as large as the compressed lists, a small part of what they need in each task's memory."""
    return rows.join(F.broadcast(at) if few else at.hint("merge"), list(on))


def rows_at(data: DataFrame, entries: DataFrame, few: bool = False) -> DataFrame:
    """The rows of data that entries name, once for each time they name it; with _file, _row."""
    at = entries.select(F.col("file_path").alias("_file"), F.explode("row_numbers").alias("_row"))
    return join_at(with_address(data).drop("_size", "_mtime"), at, ["_file", "_row"], few)
