"""Secondary indexes: values of any column -> primary keys, files and rows, over the live set."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.covering import blob_items
from ..functions.keys import key_expr, key_text
from .index import Index
from .postings import join_at, rows_at, with_address

REFS = "dim string, key string, file_path string, row_numbers array<bigint>, value_count bigint, seq bigint"


def _dimension(data: DataFrame, dimension: str, items: str | None, payload: str | None) -> Column:
    """The value of a row, or one per item."""
    if payload:
        return F.explode(F.transform(blob_items(F.col(f"`{payload}`"), items or "listens"), lambda x: x[dimension]))
    if items:
        return F.explode(F.col(f"`{items}`.`{dimension}`"))
    if dimension not in data.columns:
        raise ValueError(f"missing column `{dimension}`")
    return key_text(dimension, data.schema[dimension].dataType)


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    rows = rows.filter("key is not null and dim is not null")
    return rows.groupBy("dim", "key", "file_path", *by).agg(F.sort_array(F.collect_list("_row")).alias("row_numbers"), F.count(F.lit(1)).alias("value_count"))


def secondary_postings(data: DataFrame, dimension: str, keys: list[str], items: str | None = None, payload: str | None = None) -> DataFrame:
    """dim, key, file_path, row_numbers, value_count. dimension: a column; or a field of a list of structs (items), or of the list in a JSON payload, one value per item."""
    rows = with_address(data)
    return _grouped(rows.select(key_expr(data.schema, keys).alias("key"), _dimension(data, dimension, items, payload).alias("dim"), F.col("_file").alias("file_path"), "_row"))


class Secondary:
    """The refs of a dimension, a folder per fragment of the index: of the rows that the fragment's entries name, so deleted rows have none.

    A fragment that has come, or was written again, since the last use is indexed before anything is read."""

    def __init__(self, index: Index, dimension: str):
        self.index, self.dimension = index, dimension
        self.path = f"secondary/{dimension}"

    def build(self, items: str | None = None, payload: str | None = None) -> Secondary:
        """Over every fragment; items, payload: where the dimension is a field of a row's items, as in secondary_postings()."""
        fs, spec = self.index.store.fs, json.dumps({"items": items, "payload": payload})
        if not fs.exists(f"{self.path}/spec.json") or fs.read(f"{self.path}/spec.json") != spec:
            fs.delete(self.path)
            fs.write(f"{self.path}/spec.json", spec)
        self._extend()
        return self

    def _folders(self) -> dict[str, dict]:
        """The manifests of fragments with entries, by folder; a fragment that is written again has a new one."""
        return {f"{self.path}/{m['fragment_id']}@{''.join(c for c in m['created_at'] if c.isdigit())}": m for m in self.index.store.manifests() if m["key_columns"]}

    def _extend(self) -> list[str]:
        """Indexes the fragments that have no folder yet; each is published whole, by rename. Sorted by value, so that ranges skip row groups."""
        fs, folders = self.index.store.fs, self._folders()
        there = set(fs.list(self.path))
        spec = json.loads(fs.read(f"{self.path}/spec.json")) if "spec.json" in there else {"items": None, "payload": None}
        for folder, m in folders.items():
            if folder.rsplit("/", 1)[1] in there:
                continue
            refs = self._refs_of(m, spec)
            refs.repartitionByRange(F.col("dim"), F.col("key")).sortWithinPartitions("dim", "key").write.mode("overwrite").parquet(fs.path(f"{folder}.new"))
            fs.rename(f"{folder}.new", folder)
        for name in there - {"spec.json", *(f.rsplit("/", 1)[1] for f in folders)}:
            if not name.startswith("."):
                fs.delete(f"{self.path}/{name}")
        return list(folders)

    def _refs_of(self, m: dict, spec: dict) -> DataFrame:
        """The refs of a fragment, of its manifest."""
        entries = self.index.store.entries().filter((F.col("fragment_id") == m["fragment_id"]) & ~F.col("tombstone"))
        data, few = self.index.data_of(entries)
        if data is None:
            return self.index.spark.createDataFrame([], REFS)
        at = entries.select("key", "file_path", F.explode("row_numbers").alias("_row"))
        dim = _dimension(data, self.dimension, **spec).alias("dim")
        rows = join_at(with_address(data).select(F.col("_file").alias("file_path"), "_row", dim), at, ["file_path", "_row"], few)
        return _grouped(rows).withColumn("seq", F.lit(m["seq"]).cast("long"))

    def _live(self, test: Column | None = None) -> DataFrame:
        """Refs whose entry is live now: forgotten keys, dropped and superseded files do not show."""
        index = self.index
        folders = [index.store.fs.path(f) for f in self._extend()]
        refs = reduce(DataFrame.unionByName, [index.spark.read.schema(REFS).parquet(f) for f in folders]) if folders else index.spark.createDataFrame([], REFS)
        refs = refs if test is None else refs.filter(test)
        return refs.join(index.entries().select("key", "file_path", "seq"), ["key", "file_path", "seq"], "left_semi")

    def refs(self, test: Column) -> DataFrame:
        return self._live(test).orderBy("dim", "key", "file_path")

    def lookup_exact(self, value: str) -> DataFrame:
        return self.refs(F.col("dim") == value)

    def lookup_range(self, start: str, end: str) -> DataFrame:
        """Inclusive, in byte order; empty if start is after end."""
        return self.refs(F.col("dim").between(start, end))

    def lookup_prefix(self, prefix: str) -> DataFrame:
        return self.refs(F.col("dim").startswith(prefix))

    def lookup(self, value: str) -> DataFrame:
        """Exact, or if nothing is, by prefix."""
        found = self.lookup_exact(value)
        return self.lookup_prefix(value) if found.isEmpty() else found

    def num_keys(self) -> int:
        return self._live().select("dim").distinct().count()

    def rows(self, refs: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
        """The data rows that refs name, by file and row, each once; pages count rows."""
        data, few = self.index.data_of(refs)
        if data is None:
            return self.index.spark.createDataFrame([], self.index.table_schema())
        out = rows_at(data, refs, few).dropDuplicates(["_file", "_row"]).orderBy("_file", "_row").offset(offset)
        return (out.limit(limit) if limit is not None else out).drop("_file", "_row")
