"""Shared helpers: reading inputs, shared scratch tables, folds."""

from __future__ import annotations

import atexit
import contextlib
import io
import math
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (fixed values).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on a local master, as in tests, a folder of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once per application, so that executors need no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package, code = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(code, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}.zip"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(code.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor.

    Tables that no lazy result needs are dropped with drop(); the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            pass


def fold(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def first_by_hash(df: DataFrame, id_col: str, n: int, of: int, *ties: str) -> DataFrame:
    """The n rows of df (it has `of`) that come first by their id's hash, then by ties.

    Hashes are spread over 2^64, so all but surely four times n rows have one under 4 n / of of that range: only those are sorted,
    and the driver gets no n rows from every task."""
    return likely_first(df, id_col, n, of).orderBy(F.xxhash64(F.col(f"`{id_col}`")), id_col, *ties).limit(n)


def likely_first(df: DataFrame, id_col: str, n: int, of: int) -> DataFrame:
    """The rows of df among which first_by_hash looks for its n."""
    below = min(1.0, 4 * n / max(1, of)) * 2.0**64 - 2.0**63
    return df.filter(F.xxhash64(F.col(f"`{id_col}`")).cast("double") <= below)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(spark: SparkSession, size: int, each: int = 32 << 20) -> int:
    """Partitions of about `each` bytes, and no fewer than the session's."""
    return partitions(spark, math.ceil(size / each))


def plan_bytes(df: DataFrame) -> int:
    """What Spark takes the size of df to be: of files, their bytes; nothing is read. 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int):
    """Arrow batches of about size bytes for the jobs that run within; then the session's setting is as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def at_most_batches(spark: SparkSession, size: int) -> None:
    """Lowers the session's Arrow batches to size bytes if they may be larger, for lazy results; no order of calls raises them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))


def slices(batch, column: int, size: int = 8 << 20):
    """An Arrow batch in runs of rows whose text in column is of about size bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pack(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns in one struct, so that columns an operator adds can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpack(df: DataFrame, replaced: dict[str, Column], added: dict[str, Column], name: str = "_row") -> DataFrame:
    """The packed columns in their order, some replaced, then the added ones; an added column replaces an input column of its name."""
    inner = df.schema[name].dataType.names
    out = [replaced.get(c, F.col(f"{name}.`{c}`")).alias(c) for c in inner if c not in added]
    return df.select(*out, *[v.alias(k) for k, v in added.items()])
