"""The index of a table: build, look up, explain, forget, compact, verify."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RemoteStaleFile, StaleFile
from ..functions import covering as cov
from ..functions.keys import bucket_of, key_expr, typed_any, typed_predicate
from ..functions.times import millis
from ..plans.liveness import last_wins
from ..plans.store import Store
from ..sources.pages import coalesce_ranges, page_locations
from .postings import SCHEMA, join_at, postings, readable, with_address

#: Keys of one batch that are sent as literals; more are joined.
MANY_KEYS = 200
#: Rows that one task puts in order, or that are sent to all tasks.
FEW_ROWS = 20_000
#: Data files whose names the driver holds at a time.
LISTED = 100_000
PARQUET = "*.[pP][aA][rR][qQ][uU][eE][tT]"
_ALIASES = {"timestamp_ms": "timestamp"}


@dataclass
class QueryOptions:
    offset: int = 0
    limit: int | None = None
    columns: Sequence[str] | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    covering_only: bool = False
    min_count: int | None = None
    verify: bool = True
    dedupe: bool = False

    def __post_init__(self):
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("offset and limit must not be negative")


@dataclass
class QueryResult:
    """rows: sorted by time, file and row; covering: an entry per (fragment, file); metrics: counts and milliseconds."""

    key: str
    rows: DataFrame
    covering: DataFrame
    metrics: dict = field(default_factory=dict)


def entry_predicate(opts: QueryOptions) -> Column:
    """Entries that the covering values do not rule out; without covering values, none is."""
    keep = F.lit(True)
    c = F.col("covering")
    if opts.min_count is not None:
        keep = keep & (c.isNull() | (c["value_count"] >= opts.min_count))
    if opts.since_ms is not None:
        keep = keep & (c.isNull() | c["max_ts"].isNull() | (c["max_ts"] >= opts.since_ms))
    if opts.until_ms is not None:
        keep = keep & (c.isNull() | c["min_ts"].isNull() | (c["min_ts"] <= opts.until_ms))
    return keep


def time_window(ms: Column, opts: QueryOptions) -> Column:
    """Rows within the inclusive window; a null time counts as 0."""
    keep, ms = F.lit(True), F.coalesce(ms, F.lit(0))
    if opts.since_ms is not None:
        keep = keep & (ms >= opts.since_ms)
    if opts.until_ms is not None:
        keep = keep & (ms <= opts.until_ms)
    return keep


def layout_of(schema: T.StructType, time_column: str | None) -> str:
    """flat, nested (a list of structs `listens`) or blob (JSON in `payload`); a table with the time column at top level is flat."""
    if time_column in schema.names:
        return "flat"
    if "payload" in schema.names and "track_uri" not in schema.names:
        return "blob"
    kind = schema["listens"].dataType if "listens" in schema.names else None
    return "nested" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else "flat"


def expand_items(rows: DataFrame, schema: T.StructType, time_column: str | None) -> tuple[DataFrame, list[str], Column | None]:
    """rows (the columns of schema and others) with a row per item of a nested or blob layout, its place as _item; the data columns; and the time in ms, if there is one.

    An item's fields stand for the list; a top-level column of a field's name wins. A null or empty list has no items. A payload
    without such a list stays a row with its payload, as covering values count it; those of expanded rows are null."""
    layout = layout_of(schema, time_column)
    if layout == "flat":
        ms = millis(time_column, schema[time_column].dataType) if time_column in schema.names else None
        return rows.withColumn("_item", F.lit(0)), schema.names, ms
    if layout == "nested":
        item = schema["listens"].dataType.elementType
        rows, own = rows.select("*", F.posexplode("listens").alias("_item", "_x")), [c for c in schema.names if c != "listens"]
        values = {c: F.col("_x")[c] for c in item.names}
        ms = millis(F.col("_x")[time_column], item[time_column].dataType) if time_column in item.names else None
    else:
        rows, own = rows.withColumn("_list", cov.blob_items(F.col("payload"))), schema.names
        payloads = [c for c in own if c in ("payload", "payload_bytes")]
        rows = rows.select("*", F.posexplode(F.coalesce("_list", F.array(F.lit(None)))).alias("_item", "_x"))
        rows = rows.withColumns({c: F.when(F.col("_list").isNull(), F.col(c)) for c in payloads})
        x = F.col("_x")
        values = {"timestamp_ms": F.coalesce(x["timestamp_ms"], x["timestamp"]), "track_uri": x["track_uri"], "duration_ms": x["duration_ms"]}
        ms = values["timestamp_ms"]
    fields = [c for c in values if c not in own]
    rows = rows.withColumns({"_ms": ms if ms is not None else F.lit(None).cast("long"), **{c: values[c] for c in fields}})
    return rows.drop("_x", "_list"), own + fields, F.col("_ms") if ms is not None else None


class Index:
    """An index at root over Parquet data. key_columns and the time column come from its fragments."""

    def __init__(self, spark: SparkSession, root: str, time_column: str | None = "timestamp"):
        self.spark, self.store, self.time_column = spark, Store(spark, root), time_column

    # ---- build

    def build(self, paths: Sequence[str] | str, key_columns: Sequence[str], *, fragment_id: str | None = None, buckets: int = 16, covering: cov.Covering | bool = False, value_columns: Sequence[str] = (), note: str | None = None, position_deletes: DataFrame | None = None, equality_deletes: Sequence[DataFrame] = (), kind: str = "plain", snapshot_id=None, dropped: Sequence[str] = (), delete_files: Sequence[str] = ()) -> str:
        """Indexes Parquet files (or folders) and appends the fragment."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        none = self.spark.createDataFrame([], SCHEMA)
        if paths:
            reader = self.spark.read.option("pathGlobFilter", PARQUET)
            data = reader.parquet(*paths)
            if covering is True:
                covering = cov.Covering.sniff(data.schema, self.time_column)
            entries = postings(data, key_columns, covering or None, position_deletes, equality_deletes)
            m = F.col("_metadata")
            files = data.select(m["file_path"].alias("file_path"), m["file_size"].alias("file_size"), F.unix_millis(m["file_modification_time"]).alias("file_mtime_ms")).groupBy("file_path").agg(F.max("file_size").alias("file_size"), F.max("file_mtime_ms").alias("file_mtime_ms")).withColumn("role", F.lit("live"))
        else:
            reader, entries, files = None, none, none.select("file_path", "file_size", "file_mtime_ms").withColumn("role", F.lit("live"))
        extra = [(p, "dropped") for p in dropped] + [(p, "delete") for p in delete_files]
        if extra:
            files = files.unionByName(self.spark.createDataFrame(extra, "file_path string, role string"), allowMissingColumns=True)
        subset = position_deletes is not None or bool(equality_deletes)
        return self.store.append(fragment_id, entries, files, buckets, key_columns=key_columns, value_columns=value_columns, note=note, kind=kind, snapshot_id=snapshot_id, subset=subset, drops=bool(dropped), tombstones=False, schema=reader and reader.option("recursiveFileLookup", "true").parquet(*paths).schema.json(), paths=paths if len(paths) <= 100 else ())

    # ---- reading

    def key_columns(self) -> list[str]:
        for m in reversed(self.store.manifests()):
            if m["key_columns"]:
                return m["key_columns"]
        raise ValueError("the index has no fragment")

    def _buckets(self, keys: Sequence[str]) -> dict[str, list[int]]:
        return {m["fragment_id"]: sorted({bucket_of(k, m["num_buckets"]) for k in keys}) for m in self.store.manifests()}

    def entries(self, keys: Sequence[str] | None = None, opts: QueryOptions | None = None) -> DataFrame:
        """Live entries, of some keys: only their buckets are read."""
        if keys is None:
            out = self.store.live()
        else:
            out = self.store.live(list(keys), self._buckets(keys))
        return last_wins(out) if opts is not None and opts.dedupe else out

    def covering(self, key: str, opts: QueryOptions | None = None) -> DataFrame:
        """Index-only answer: no data file is opened or checked."""
        opts = opts or QueryOptions()
        c = F.col("covering")
        return self.entries([key], opts).filter(entry_predicate(opts)).filter(c.isNotNull()).select(F.col("file_path").alias("file"), c["value_count"].alias("value_count"), c["value_count"].alias("count"), c["total"].alias("total"), c["min_ts"].alias("min_ts"), c["max_ts"].alias("max_ts"))

    def _empty(self, opts: QueryOptions) -> DataFrame:
        """No rows, in the table's own schema."""
        schema = self.table_schema()
        rows, names, _ = expand_items(self.spark.createDataFrame([], schema), schema, self.time_column)
        return self._project(rows.select(*[F.col(f"`{c}`") for c in names]).withColumn("source_file", F.lit("")).withColumn("row_number", F.lit(0).cast("long")), opts)

    def table_schema(self) -> T.StructType:
        known = [m["schema"] for m in self.store.manifests() if m.get("schema")]
        if known:
            return T.StructType.fromJson(json.loads(known[-1]))
        f = self.store.files().filter("role = 'live'").select("file_path").limit(1).collect()
        if not f:
            raise ValueError("the index has no file")
        return self.spark.read.parquet(readable(f[0][0])).schema

    def read_files(self, files: Sequence[str], fragments: Iterable[str]) -> DataFrame:
        """Data files of some fragments. With one schema in their manifests, no footer is read to plan."""
        fragments = set(fragments)
        known = {m.get("schema") for m in self.store.manifests() if m["fragment_id"] in fragments}
        reader = self.spark.read
        if len(known) == 1 and None not in known:
            reader = reader.schema(T.StructType.fromJson(json.loads(known.pop())))
        return reader.parquet(*[readable(f) for f in files])

    def data_of(self, entries: DataFrame) -> tuple[DataFrame | None, bool]:
        """The data that entries name, or None if they name none; and whether the rows that they name are few enough to be sent to all tasks.

        Up to LISTED files are listed; beyond, the folders that the fragments were built from are read, if the manifests have them, so
        that the driver holds no list that grows with the lake."""
        named = entries.groupBy("file_path").agg(F.sum(F.size("row_numbers")).alias("n"))
        found = named.limit(LISTED + 1).collect()
        files, few = [r.file_path for r in found], len(found) <= LISTED and sum(r.n or 0 for r in found) <= FEW_ROWS
        ms = self.store.manifests()
        if len(files) > LISTED:
            whole = {m["fragment_id"]: m.get("paths") for m in ms if m["key_columns"]}
            if all(whole.values()):
                paths = list(dict.fromkeys(p for v in whole.values() for p in v))
                return self.spark.read.schema(self.table_schema()).option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET).parquet(*paths), few
            files = [r.file_path for r in named.toLocalIterator()]
        return self.read_files(files, [m["fragment_id"] for m in ms if m["key_columns"]]) if files else None, few

    def _project(self, rows: DataFrame, opts: QueryOptions) -> DataFrame:
        if opts.columns and "*" not in opts.columns:
            wanted = {_ALIASES.get(c, c) for c in opts.columns} | set(opts.columns)
            rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in wanted or c in ("source_file", "row_number")])
        return rows

    def check_fresh(self, files: DataFrame | Iterable) -> None:
        """StaleFile for a file whose size, time or etag is not what the index has; both sides must know a value for it to count.

        files: rows with file_path, file_size, file_mtime_ms, file_etag; asked of the file system in parallel."""
        if isinstance(files, DataFrame):
            files = files.select("file_path", "file_size", "file_mtime_ms", "file_etag").distinct().toLocalIterator()

        def check(r) -> None:
            live = self.store.fs.status(readable(r.file_path))
            now = dict(zip(("size", "mtime_ms", "etag"), live or (None, None, None)))
            stored = {"etag": r.file_etag, "size": r.file_size, "mtime_ms": r.file_mtime_ms}
            if live is None or any(stored[k] is not None and now[k] is not None and stored[k] != now[k] for k in stored):
                error = StaleFile if r.file_path.startswith(("file:", "/")) else RemoteStaleFile
                raise error("an indexed file is missing or has changed", path=r.file_path, stored=stored, live=None if live is None else now)

        with ThreadPoolExecutor(8) as pool:
            while part := list(itertools.islice(files := iter(files), 1024)):
                list(pool.map(check, part))

    def lookup(self, key: str, opts: QueryOptions | None = None, **kw) -> QueryResult:
        """The rows of one key. Order: entry predicates, covering, identity check, pages, read, items, time window, limit.

        One job reads the key's entries (one per file, without row numbers) to the driver, which cuts the page by their counts; the result is
        one scan. Nested and blob layouts give a row per item: pages count physical rows, the limit then cuts items."""
        opts = opts or QueryOptions(**kw)
        begun = time.perf_counter()
        marks = {}

        def mark(name):
            marks[name] = round((time.perf_counter() - begun) * 1000, 3)

        manifests = self.store.manifests()
        entries = self.entries([key], opts)
        found = entries.select("file_path", "fragment_id", "seq", "value_count", F.size("row_numbers").alias("n"), "file_size", "file_mtime_ms", "file_etag", entry_predicate(opts).alias("keep")).collect()
        kept = sorted((r for r in found if r.keep), key=lambda r: (r.seq, r.file_path))
        covering = self.covering(key, opts)
        mark("index_lookup_ms")
        values = sum(r.value_count or 0 for r in kept)
        totals = {"value_count": values, "skipped_by_predicate": len(found) - len(kept), "files_touched": 0, "offset": opts.offset, "limit": opts.limit}
        if opts.covering_only or not kept:
            rows = self._empty(opts) if manifests else None
            return QueryResult(key, rows, covering, {"timings": marks, "totals": totals})
        if opts.verify:
            self.check_fresh(kept)
        mark("metadata_resolve_ms")
        files, spans = list(dict.fromkeys(r.file_path for r in kept)), None
        if opts.offset or opts.limit is not None or len(files) < len(kept) or any(m["subset"] for m in manifests):
            spans, skip, left = [], opts.offset, opts.limit
            for r in kept:
                a = min(skip, r.n)
                b = r.n if left is None else min(r.n, a + left)
                skip, left = skip - a, None if left is None else left - (b - a)
                if b > a:
                    spans.append((r.seq, r.file_path, a, b - a))
            files = list(dict.fromkeys(p for _, p, _, _ in spans))
        totals["files_touched"] = len(files)
        if not files:
            return QueryResult(key, self._empty(opts), covering, {"timings": marks, "totals": totals})
        data = self.read_files(files, (r.fragment_id for r in kept))
        rows = with_address(data).drop("_size", "_mtime").filter(typed_predicate(data.schema, self.key_columns(), key))
        if spans is not None:
            cut = F.broadcast(self.spark.createDataFrame(spans, "seq long, file_path string, _from int, _n int"))  # a row per entry, as collected above
            at = entries.join(cut, ["seq", "file_path"]).select(F.col("file_path").alias("_file"), F.explode(F.slice("row_numbers", F.col("_from") + 1, F.col("_n"))).alias("_row"))
            few = sum(n for _, _, _, n in spans) <= FEW_ROWS
            rows = join_at(rows, at, ["_file", "_row"], few)
        rows, names, ms = expand_items(rows, data.schema, self.time_column)
        order = [F.col("_file"), F.col("_row"), F.col("_item")]
        if ms is not None:
            rows = rows.filter(time_window(ms, opts))
            order = [F.coalesce(ms, F.lit(0)), *order]
        # few rows by the index's own count need no sampling to be put in order
        rows = rows.repartition(1).sortWithinPartitions(*order) if values <= FEW_ROWS else rows.orderBy(*order)
        if opts.limit is not None:
            rows = rows.limit(opts.limit)
        rows = rows.select(*[F.col(f"`{c}`") for c in names], F.col("_file").alias("source_file"), F.col("_row").alias("row_number"))
        mark("plan_ms")
        return QueryResult(key, self._project(rows, opts), covering, {"timings": marks, "totals": totals})

    def lookup_many(self, keys: Sequence[str] | DataFrame, opts: QueryOptions | None = None) -> DataFrame:
        """The rows of many keys in one job, with `key`, source_file and row_number; each key paged on its own, items as in lookup().

        keys: a list, whose typed literals reach the scan, or a DataFrame with a column `key`, which is joined and never collected."""
        opts = opts or QueryOptions()
        literal = None
        if isinstance(keys, DataFrame):
            wanted = keys.select("key").distinct()
            entries = self.entries(opts=opts).join(wanted, "key", "left_semi")
        elif len(keys) > MANY_KEYS:
            return self.lookup_many(self.spark.createDataFrame([(k,) for k in keys], "key string"), opts)
        else:
            literal = list(dict.fromkeys(keys))
            entries = self.entries(literal, opts)
        entries = entries.filter(entry_predicate(opts))
        if opts.verify:
            self.check_fresh(entries)
        at = entries.select("key", "seq", F.col("file_path").alias("_file"), F.posexplode("row_numbers").alias("_pos", "_row"))
        if opts.offset or opts.limit is not None:
            at = at.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("seq", "_file", "_pos"))).filter(F.col("_n") > opts.offset)
            at = at.filter(F.col("_n") <= opts.offset + opts.limit) if opts.limit is not None else at
        data, few = self.data_of(entries)
        if data is None:
            return self._empty(opts).withColumn("key", F.lit(""))
        few = few or (literal is not None and opts.limit is not None and len(literal) * opts.limit <= FEW_ROWS)
        columns = self.key_columns()
        rows = with_address(data).drop("_size", "_mtime")
        if literal is not None:
            rows = rows.filter(typed_any(data.schema, columns, literal))
        # the key is no more than the address tells, but a filter on it can be made from the keys' side before rows travel
        rows = join_at(rows.withColumn("_key", key_expr(data.schema, columns)), at.select(F.col("key").alias("_key"), "_file", "_row"), ["_key", "_file", "_row"], few)
        rows, names, ms = expand_items(rows, data.schema, self.time_column)
        if ms is not None:
            rows = rows.filter(time_window(ms, opts))
        if opts.limit is not None and layout_of(data.schema, self.time_column) != "flat":
            by = [F.coalesce(ms, F.lit(0))] if ms is not None else []
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*by, "_file", "_row", "_item"))).filter(F.col("_n") <= opts.limit)
        names = [c for c in names if c != "key"]
        out = rows.select(F.col("_key").alias("key"), *[F.col(f"`{c}`") for c in names], F.col("_file").alias("source_file"), F.col("_row").alias("row_number"))
        return self._project(out, opts) if not opts.columns else self._project(out, QueryOptions(columns=[*opts.columns, "key"]))

    def explain(self, key: str, opts: QueryOptions | None = None, pages: bool = False) -> dict:
        """What a lookup would touch. No data file is opened, but with pages the footers of the key's files are, for the pages that hold its rows."""
        opts = opts or QueryOptions()
        found = self.entries([key], opts).withColumn("_keep", entry_predicate(opts))
        n, kept, rows = found.agg(F.count(F.lit(1)), F.sum(F.col("_keep").cast("long")), F.sum(F.when(F.col("_keep"), F.size("row_numbers")))).first()
        per_file = found.filter("_keep").groupBy("file_path").agg(F.max("file_size").alias("size")).orderBy("file_path").collect()
        manifests = self.store.manifests()
        described, size, gets = [], sum(r.size or 0 for r in per_file), len(per_file)
        if pages and not opts.covering_only:
            size, gets, sizes = 0, 0, {r.file_path: r.size for r in per_file}
            for r in found.filter("_keep").groupBy("file_path").agg(F.flatten(F.collect_list("row_numbers")).alias("rows")).orderBy("file_path").toLocalIterator():
                at = page_locations(self.spark, readable(r.file_path), r.rows, list(opts.columns) if opts.columns else None)
                ranges = coalesce_ranges([(p["offset"], p["offset"] + p["size"]) for p in at])
                described += [{"file": r.file_path, **p} for p in at]
                size += sum(b - a for a, b in ranges) if at else sizes.get(r.file_path) or 0  # no page index: the whole file
                gets += len(ranges) or 1
        return {
            "key": key,
            "bucket": bucket_of(key, manifests[0]["num_buckets"]) if manifests else None,
            "num_entries": n,
            "num_entries_after_predicates": kept or 0,
            "files": [r.file_path for r in per_file],
            "covering": [r.asDict() for r in self.covering(key, opts).collect()],
            "page_descriptions": described,
            "estimated_bytes": 0 if opts.covering_only else size,
            "estimated_range_gets": 0 if opts.covering_only else gets,
            "estimated_rows": rows or 0,
            "covering_only": opts.covering_only,
            "columns": list(opts.columns or []),
            "since_ms": opts.since_ms,
            "until_ms": opts.until_ms,
            "skipped_by_predicate": n - (kept or 0),
        }

    def stats(self) -> dict:
        per = {r.fragment_id: r.n for r in self.store.files().filter("role = 'live'").groupBy("fragment_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        ms = self.store.manifests()
        names = ("fragment_id", "num_buckets", "created_at", "key_columns", "value_columns")
        frags = [{k: m[k] for k in names} | {"num_files": per.get(m["fragment_id"], 0)} for m in ms]
        return {"index": self.store.fs.root, "lazy_buckets": True, "num_files": sum(per.values()), "num_fragments": len(ms), "fragments": frags}

    def counts(self) -> DataFrame:
        """num_keys and num_entries of the live set."""
        return self.entries().agg(F.countDistinct("key").alias("num_keys"), F.count(F.lit(1)).alias("num_entries"))

    # ---- maintenance

    def forget(self, keys: Sequence[str] | DataFrame, fragment_id: str | None = None) -> str:
        """Hides keys for good; no data file changes."""
        df = keys.select("key") if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "key string")
        df = df.filter("key is not null").distinct()
        stones = df.select("key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name not in ("key", "tombstone")], F.lit(True).alias("tombstone"))
        none = self.spark.createDataFrame([], "file_path string, role string")
        buckets = max([m["num_buckets"] for m in self.store.manifests()], default=16)
        df.write.mode("append").json(self.store.fs.path("forgotten"))
        return self.store.append(fragment_id or f"forget-{time.time_ns() // 1_000_000}", stones, none, buckets, kind="forget", note="forget", drops=False)

    def compact(self, fragment_id: str | None = None) -> dict:
        """Rewrites the live set as one fragment; the last entry of a (key, file) wins."""
        ms = self.store.manifests()
        last = next((m for m in reversed(ms) if m["kind"] != "forget"), None)
        if last is None:
            raise ValueError("the index has no fragment")
        live = last_wins(self.store.live())
        stones = self.store.entries().filter("tombstone").select("key").distinct()
        hidden = self.store.forgotten()
        forgotten = (stones if hidden is None else hidden.select("key").unionByName(stones)).distinct().count()
        files = live.groupBy("file_path").agg(F.max_by("file_size", "seq").alias("file_size"), F.max_by("file_mtime_ms", "seq").alias("file_mtime_ms"), F.max_by("file_etag", "seq").alias("file_etag")).withColumn("role", F.lit("live"))
        events = self.store.files()
        last_seq = events.filter("snapshot").agg(F.max("seq").alias("seq"))
        deletes = events.filter("role = 'delete'").join(F.broadcast(last_seq), "seq", "left_semi")  # one row; the next snapshot is compared with these
        files = files.unionByName(deletes.select(*files.columns))
        snapshot = max((m["seq"], m["snapshot_id"]) for m in ms if m["snapshot_id"] is not None)[1] if any(m["snapshot_id"] is not None for m in ms) else None
        fragment_id = fragment_id or f"compact-{time.time_ns() // 1_000_000}"
        self.store.append(fragment_id, live, files, last["num_buckets"], key_columns=last["key_columns"], value_columns=last["value_columns"], snapshot_id=snapshot, kind="snapshot" if snapshot is not None else "compact", note="compact", subset=any(m["subset"] for m in ms), replace=True, drops=False, tombstones=False, schema=last.get("schema") if len({m.get("schema") for m in ms if m["key_columns"]}) == 1 else None, paths=list(dict.fromkeys(p for m in ms for p in m.get("paths") or ())) if all(m.get("paths") for m in ms if m["key_columns"]) else ())
        n = self.store.entries().agg(F.countDistinct("key"), F.count(F.lit(1)), F.countDistinct("file_path")).first()
        return {"fragment_id": fragment_id, "keys": n[0], "entries": n[1], "files": n[2], "dropped_tombstoned_keys": forgotten}

    def verify(self) -> DataFrame:
        """A row per live file event: file_path, fragment_id, status ('ok', 'stale', 'skipped'). Folders are listed by Spark, not one file at a time."""
        files = self.store.files().filter("role = 'live'").withColumn("_path", F.col("file_path"))
        folders = [readable(r[0]) for r in files.select(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("d")).distinct().toLocalIterator()]
        folders = [d for d in folders if self.store.fs.exists(d)]
        if folders:
            # binaryFile lists without opening as long as content is not selected
            now = self.spark.read.format("binaryFile").load(folders).select("path", "length", F.unix_millis("modificationTime").alias("mtime"))
        else:
            now = self.spark.createDataFrame([], "path string, length bigint, mtime bigint")
        same = F.regexp_replace(F.url_decode(F.regexp_replace("_path", r"\+", "%2B")), r"^file:/*", "/")
        out = files.join(now.withColumn("_now", F.regexp_replace("path", r"^file:/*", "/")), same == F.col("_now"), "left")
        stale = F.col("_now").isNull() | (F.col("length") != F.col("file_size")) | (F.col("mtime") != F.col("file_mtime_ms"))
        known = F.col("file_size").isNotNull() | F.col("file_mtime_ms").isNotNull()
        status = F.when(F.col("_now").isNull(), "stale").when(~known, "skipped").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ok")
        return out.select("file_path", "fragment_id", status.alias("status"))


def naive_scan(spark: SparkSession, paths: Sequence[str] | str, key_columns: Sequence[str], key: str, order: str | None = None, time_column: str | None = "timestamp") -> DataFrame:
    """The rows of a key by a scan of all files, items of nested and blob layouts as rows: what a lookup must equal."""
    data = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    rows, names, _ = expand_items(data.filter(key_expr(data.schema, key_columns) == F.lit(key)), data.schema, time_column)
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    return rows.orderBy(order) if order else rows
