"""Indexing files as they arrive: a file stream whose batches become fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import covering as cov
from ..operators.index import Index


def index_new_files(index: Index, path: str, key_columns: list[str], checkpoint: str, *, buckets: int = 16, covering: cov.Covering | None = None, max_files: int = 1000):
    """Indexes what has arrived since the last run and stops; a batch that is run again overwrites its own fragment."""
    spark = index.spark
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(path)

    def append(batch: DataFrame, number: int) -> None:
        # the batch names its files; they are read again as a table, so that row numbers are those of the files
        files = [r[0] for r in batch.select(F.col("_file")).distinct().toLocalIterator()]
        if files:
            index.build(files, key_columns, fragment_id=f"stream-{number:06d}", buckets=buckets, covering=covering or False, note="stream")

    named = stream.select(F.col("_metadata.file_path").alias("_file"))
    query = named.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


