"""One query per operator, over the driver's tables, and the SQL that each must equal.

Indexes are built once per session and input folder, as an index is in use; the build itself is a query too.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LodestoneError
from .functions import covering as cov
from .functions.keys import bucket_expr, key_text
from .functions.times import millis, parse_time_ms
from .operators.index import Index, QueryOptions, entry_predicate, naive_scan
from .operators.postings import apply_equality_deletes, apply_position_deletes, postings
from .operators.secondary import Secondary, secondary_postings
from .operators.sql_scope import run_sql
from .plans.fs import Fs
from .plans.liveness import last_wins, live_entries
from .session import shared_folder
from .sources import layouts
from .sources.sinks import json_rows, read_v1_fragment
from .sources.snapshots import Snapshot, index_snapshot, index_table, snapshot_diff
from .stress import percentile
from .streaming.incremental import index_new_files

_BUILT: dict[tuple, Index] = {}
EVENTS = cov.Covering("ts", "value")
ORDERS = cov.Covering("o_orderdate", "o_totalprice")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new(spark: SparkSession, time_column: str) -> Index:
    return Index(spark, shared_folder(spark, "index"), time_column)


def _events(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = _new(spark, "ts")
        _BUILT[key].build(f"{sf_dir}/events.parquet", ["user_id"], covering=EVENTS)
    return _BUILT[key]


def _covering(df: DataFrame) -> DataFrame:
    c = F.col("covering")
    return df.select("key", c["value_count"].alias("value_count"), F.round(c["total"].cast("double"), 2).alias("total"), c["min_ts"].alias("min_ts"), c["max_ts"].alias("max_ts"))


def _plain_events(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "event_id", millis("ts", df.schema["ts"].dataType).alias("ts_ms"), "user_id", "event_type", F.round("value", 4).alias("value"), "props")


_EVENT_SQL = "event_id, (epoch_us(ts) // 1000)::bigint ts_ms, user_id, event_type, round(value, 4) as value, props"
_T0, _T1 = 1704500000000, 1705500000000


# ---- keys, postings, covering


def key_bucket(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key")).distinct().withColumn("bucket", bucket_expr(F.col("key"), 16))


def key_text_timestamp(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select("event_id", key_text("ts", ev.schema["ts"].dataType).alias("key"))


def postings_by_key(spark, sf_dir):
    out = postings(_t(spark, sf_dir, "events"), ["user_id"])
    return out.groupBy("key").agg(F.sum("value_count").alias("value_count"), F.sum(F.size("row_numbers")).alias("n_rows"))


def compound_key_index(spark, sf_dir):
    out = postings(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.groupBy("key").agg(F.sum("value_count").alias("value_count"))


def timestamp_key_index(spark, sf_dir):
    return postings(_t(spark, sf_dir, "orders"), ["o_orderdate"]).groupBy("key").agg(F.sum("value_count").alias("value_count"))


def covering_flat(spark, sf_dir):
    return _covering(_merged(postings(_t(spark, sf_dir, "events"), ["user_id"], EVENTS)))


def covering_orders(spark, sf_dir):
    return _covering(_merged(postings(_t(spark, sf_dir, "orders"), ["o_custkey"], ORDERS)))


def _merged(entries: DataFrame) -> DataFrame:
    """Covering values of a key over all its files."""
    c = F.col("covering")
    return entries.groupBy("key").agg(F.struct(F.sum(c["value_count"]).alias("value_count"), F.sum(c["total"]).alias("total"), F.min(c["min_ts"]).alias("min_ts"), F.max(c["max_ts"]).alias("max_ts")).alias("covering"))


def _layout(spark, sf_dir, layout: str) -> str:
    ev = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("track_uri"), F.floor(F.col("value") * 100).cast("long").alias("duration_ms"))
    path = shared_folder(spark, layout)
    layouts.write_layout(ev, path, layout, files=4)
    return path


def _layout_covering(layout: str, shape: str):
    def query(spark, sf_dir):
        index = _new(spark, "timestamp")
        path = _layout(spark, sf_dir, layout)
        index.build(path, ["user_id"], covering=cov.Covering("timestamp", "duration_ms", shape))
        return _covering(_merged(index.entries()))

    return query


def _layout_lookup(layout: str, shape: str, time: str):
    """A key's items within a window, of which the limit keeps the first."""

    def query(spark, sf_dir):
        index = _new(spark, "timestamp")
        index.build(_layout(spark, sf_dir, layout), ["user_id"], covering=cov.Covering("timestamp", "duration_ms", shape))
        rows = index.lookup("13", since_ms=_T0, until_ms=_T1, limit=5).rows
        return rows.select(millis(time, rows.schema[time].dataType).alias("ts_ms"), "track_uri", "duration_ms")

    return query


def cogroup_sizes(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return layouts.cogrouped(ev, "user_id", "ts").select("user_id", F.size("listens").cast("long").alias("n"), F.element_at("listens.event_id", 1).alias("first_event"))


def blob_expand(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ---- lookups


def index_build(spark, sf_dir):
    """Build and publish, then read the live set back."""
    index = _new(spark, "ts")
    index.build(f"{sf_dir}/events.parquet", ["user_id"], covering=EVENTS)
    return index.entries().groupBy("bucket").agg(F.countDistinct("key").alias("n_keys"), F.sum("value_count").alias("value_count"))


def point_lookup(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup("13").rows)


def point_lookup_projection(spark, sf_dir):
    return _events(spark, sf_dir).lookup("13", columns=["event_id", "event_type", "no_such"]).rows.select("event_id", "event_type")


def point_lookup_time_window(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup("13", since_ms=_T0, until_ms=_T1).rows)


def point_lookup_missing(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup("no such key").rows)


def paginate(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup("13", offset=2, limit=5).rows)


def paginate_then_window(spark, sf_dir):
    """Pages come before the time window, so a page may come out short."""
    return _plain_events(_events(spark, sf_dir).lookup("13", offset=1, limit=40, since_ms=_T0).rows)


def multi_key_lookup(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup_many(["1", "13", "14", "x"]), "key")


def multi_key_join(spark, sf_dir):
    """Keys that are a table: joined, never collected."""
    keys = _t(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 150").select(F.col("user_id").cast("string").alias("key"))
    out = _events(spark, sf_dir).lookup_many(keys, QueryOptions(verify=False))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("total"))


def multi_key_paged(spark, sf_dir):
    return _plain_events(_events(spark, sf_dir).lookup_many(["1", "13", "14"], QueryOptions(offset=1, limit=3)), "key")


def covering_only(spark, sf_dir):
    c = _events(spark, sf_dir).covering("13")
    return c.groupBy().agg(F.sum("value_count").alias("value_count"), F.round(F.sum("total").cast("double"), 2).alias("total"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def min_count_entries(spark, sf_dir):
    c = F.col("covering")
    return _events(spark, sf_dir).entries().filter(c["value_count"] >= 60).select("key", "value_count")


def explain_counts(spark, sf_dir):
    e = _events(spark, sf_dir).explain("13", QueryOptions(since_ms=_T0))
    return spark.createDataFrame([(e["key"], e["bucket"], e["num_entries_after_predicates"], e["estimated_rows"])], "key string, bucket int, entries long, n_rows long")


def index_stats(spark, sf_dir):
    return _events(spark, sf_dir).counts()


def verify_files(spark, sf_dir):
    return _events(spark, sf_dir).verify().filter("status = 'ok'").select(F.lit("events").alias("name"), "status").distinct()


def verify_changed(spark, sf_dir):
    """A file as it was, one that was written again, and one that is gone."""
    folder = shared_folder(spark, "verify")
    ev = _t(spark, sf_dir, "events")
    for k in range(3):
        ev.filter(f"event_id % 3 = {k}").coalesce(1).write.parquet(f"{folder}/d{k}")
    index = _new(spark, "ts")
    index.build([f"{folder}/d{k}" for k in range(3)], ["user_id"])
    for r in index.store.files().filter("file_path like '%/d1/%' or file_path like '%/d2/%'").collect():
        index.store.fs.delete(r.file_path)
        if "/d1/" in r.file_path:
            index.store.fs.write(r.file_path, "another file")
    return index.verify().select(F.regexp_extract("file_path", r"/(d\d)/[^/]*$", 1).alias("name"), "status")


def stats_of_fragments(spark, sf_dir):
    s = _events(spark, sf_dir).stats()
    return spark.createDataFrame([(s["num_files"], s["num_fragments"], f["num_buckets"], ",".join(f["key_columns"])) for f in s["fragments"]], "num_files long, num_fragments long, num_buckets long, key_columns string")


def entries_by_predicate(spark, sf_dir):
    """The entries that a minimum count and a time window leave, by covering values alone."""
    keep = entry_predicate(QueryOptions(min_count=60, since_ms=_T1, until_ms=_T1 + 86_400_000))
    return _events(spark, sf_dir).entries().filter(keep).select("key", "value_count")


def verify_rows(spark, sf_dir):
    """A row per indexed file, whatever its status; a file under the table's folder counts by the table's name."""
    name = F.regexp_extract(F.regexp_replace("file_path", r"[.]parquet/[^/]*$", ".parquet"), r"([^/]*)[.]parquet$", 1)
    return _events(spark, sf_dir).verify().select(name.alias("name"), "status")


def lookup_order(spark, sf_dir):
    """Rows with their place in the result: by time, file and row."""
    return _events(spark, sf_dir).lookup("13").rows.select("event_id", F.monotonically_increasing_id().alias("at"))


def lookup_alias(spark, sf_dir):
    """A column asked for by the other name of the time column."""
    index = _new(spark, "timestamp")
    index.build(_layout(spark, sf_dir, "sorted"), ["user_id"])
    rows = index.lookup("13", columns=["timestamp_ms", "duration_ms"]).rows
    return rows.select(millis("timestamp", rows.schema["timestamp"].dataType).alias("ts_ms"), "duration_ms")


def lookup_dedupe(spark, sf_dir):
    """Two plain fragments of one file, of which the last entry of a key and file is read."""
    index = _new(spark, "ts")
    for _ in range(2):
        index.build(f"{sf_dir}/events.parquet", ["user_id"], buckets=4)
    return _plain_events(index.lookup("13", dedupe=True).rows)


def lookup_totals(spark, sf_dir):
    """What lookups say of the index: values, entries that predicates leave out, files touched."""
    index, out = _events(spark, sf_dir), []
    for name, opts in (("all", {}), ("late", {"since_ms": 4_000_000_000_000}), ("few", {"min_count": 1_000_000_000}), ("index", {"covering_only": True})):
        t = index.lookup("13", **opts).metrics["totals"]
        out.append((name, t["value_count"], t["skipped_by_predicate"], t["files_touched"]))
    return spark.createDataFrame(out, "name string, value_count long, skipped long, files long")


def explain_pages(spark, sf_dir):
    """The rows of a key on the layout with pages of 100 rows; whether each column has as few pages as a run of so many rows can stand on; whether ranges are no more than pages and bytes no more than the files."""
    index = _new(spark, "timestamp")
    index.build(_layout(spark, sf_dir, "key_pages"), ["user_id"])
    e = index.explain("13", pages=True)
    n, pages = e["estimated_rows"], [p["column"] for p in e["page_descriptions"]]
    size = index.store.files().filter("role = 'live'").agg(F.sum("file_size")).first()[0]
    few = all(-(-n // 100) <= pages.count(c) <= (n - 2) // 100 + 2 for c in set(pages))
    return spark.createDataFrame([(n, len(set(pages)), few, 0 < e["estimated_range_gets"] <= len(pages) and e["estimated_bytes"] < size)], "n_rows long, n_columns long, few boolean, within boolean")


def lookup_changed_file(spark, sf_dir):
    """A lookup before and after its file is another one."""
    folder = shared_folder(spark, "changed")
    _t(spark, sf_dir, "events").coalesce(1).write.parquet(folder)
    index = _new(spark, "ts")
    index.build(folder, ["user_id"])
    out = [("before", str(index.lookup("13").rows.count()))]
    for r in index.store.files().collect():
        index.store.fs.delete(r.file_path)
        index.store.fs.write(r.file_path, "another file")
    try:
        index.lookup("13")
    except LodestoneError as e:
        out.append(("after", e.code))
    return spark.createDataFrame(out, "name string, found string")


def time_arguments(spark, sf_dir):
    """Milliseconds of times as a user writes them: whole days begin or end, others are points."""
    texts = [(t, end) for t in _TIMES for end in (False, True)]
    return spark.createDataFrame([(t, end, parse_time_ms(t, end)) for t, end in texts], "text string, end_of_day boolean, ms long")


_TIMES = ["1704067200123", "-5", "2024-02-29", "1969-12-31", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678+05:30", "1969-12-31T23:59:59.999Z"]


def percentiles(spark, sf_dir):
    """Percentiles of the nations' numbers, by nearest rank."""
    values = [r[0] for r in _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double")).collect()]
    return spark.createDataFrame([(p, percentile(values, p)) for p in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)], "p double, value double")


def full_scan(spark, sf_dir):
    return _plain_events(naive_scan(spark, f"{sf_dir}/events.parquet", ["user_id"], "13"))


def compound_lookup(spark, sf_dir):
    index = _new(spark, "l_shipdate")
    index.build(f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber"])
    return index.lookup("7\x1f1").rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def json_sink(spark, sf_dir):
    rows = _events(spark, sf_dir).lookup("13").rows.select("event_id", "event_type")
    return json_rows(rows).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), F.get_json_object("json", "$.event_type").alias("event_type"))


def json_sink_types(spark, sf_dir):
    """Lists of structs, bytes, decimals, numbers that are not finite, times and nulls as JSON."""
    ev = _t(spark, sf_dir, "events")
    pair = F.array(F.struct(F.col("event_type").alias("t"), F.col("value").cast("decimal(12,2)").alias("d")), F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).cast("decimal(12,2)").alias("d")))
    rows = ev.select("event_id", pair.alias("items"), F.col("event_type").cast("binary").alias("raw"), F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("x"), "ts")
    get = lambda p: F.get_json_object("json", p)
    return json_rows(rows).select(get("$.event_id").cast("long").alias("event_id"), get("$.items[0].t").alias("t"), get("$.items[0].d").alias("d"), get("$.items[1].d").alias("zero"), get("$.raw").alias("raw"), get("$.x").cast("double").alias("x"), get("$.ts").alias("ts"))


# ---- secondary


def _secondary(spark, sf_dir) -> Secondary:
    key = (spark.sparkContext.applicationId, sf_dir, "event_type")
    if key not in _BUILT:
        _BUILT[key] = Secondary(_events(spark, sf_dir), "event_type").build()
    return _BUILT[key]


def _refs(df: DataFrame) -> DataFrame:
    return df.groupBy("dim", "key").agg(F.sum("value_count").alias("value_count"))


def secondary_exact(spark, sf_dir):
    return _refs(_secondary(spark, sf_dir).lookup_exact("click"))


def secondary_range(spark, sf_dir):
    return _refs(_secondary(spark, sf_dir).lookup_range("c", "p"))


def secondary_prefix(spark, sf_dir):
    return _refs(_secondary(spark, sf_dir).lookup("p"))


def secondary_rows(spark, sf_dir):
    s = _secondary(spark, sf_dir)
    return _plain_events(s.rows(s.lookup_exact("error").filter("key in ('13', '14')")).filter("event_type = 'error'"))


def secondary_rows_all(spark, sf_dir):
    """All rows of a value, of every key."""
    s = _secondary(spark, sf_dir)
    return _plain_events(s.rows(s.lookup_exact("error")))


def secondary_lineitem(spark, sf_dir):
    return _refs(secondary_postings(_t(spark, sf_dir, "lineitem"), "l_returnflag", ["l_suppkey"]))


def secondary_page(spark, sf_dir):
    s = _secondary(spark, sf_dir)
    return _plain_events(s.rows(s.lookup_exact("view"), offset=3, limit=7))


def secondary_items(spark, sf_dir):
    """A secondary index of a field of the items in a JSON payload: a value per item."""
    index = _new(spark, "timestamp")
    index.build(_layout(spark, sf_dir, "blob"), ["user_id"])
    return _refs(Secondary(index, "track_uri").build(payload="payload").lookup_prefix(""))


def _with_deletes(spark, sf_dir) -> Index:
    """Events without rows that a position delete of the real file names, and without those that equal a delete record."""
    ev = _t(spark, sf_dir, "events")
    at = ev.filter("event_id % 7 = 0").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    gone = ev.filter("event_id % 10 = 3").select("user_id", "event_type").distinct()
    index = _new(spark, "ts")
    index.build(f"{sf_dir}/events.parquet", ["user_id"], position_deletes=at, equality_deletes=[gone])
    return index


def lookup_deleted(spark, sf_dir):
    return _plain_events(_with_deletes(spark, sf_dir).lookup("13").rows)


def secondary_deleted(spark, sf_dir):
    """The rows of a value, those without the deleted ones."""
    s = Secondary(_with_deletes(spark, sf_dir), "event_type").build()
    return _plain_events(s.rows(s.lookup_prefix("")))


def secondary_second_fragment(spark, sf_dir):
    """A secondary index, then a fragment that comes later, a forgotten key, and all rows of a value."""
    folder = shared_folder(spark, "halves")
    ev = _t(spark, sf_dir, "events")
    for k in (0, 1):
        ev.filter(f"event_id % 2 = {k}").write.parquet(f"{folder}/d{k}")
    index = _new(spark, "ts")
    index.build(f"{folder}/d0", ["user_id"])
    s = Secondary(index, "event_type").build()
    index.build(f"{folder}/d1", ["user_id"])
    index.forget(["13"])
    return _plain_events(s.rows(s.lookup_exact("error")))


# ---- deletes, liveness, maintenance


def equality_delete(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    d = ev.filter("event_id % 10 = 0").select("user_id", "event_type").distinct()
    return apply_equality_deletes(ev, [d]).select("event_id")


def position_delete(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("*", F.lit("file:/a").alias("_file"), F.col("event_id").alias("_row"))
    d = ev.filter("event_id % 7 = 0").select(F.lit("/a").alias("file_path"), F.col("event_id").alias("pos"))
    return apply_position_deletes(ev, d).select("event_id")


def _as_entries(spark, sf_dir) -> DataFrame:
    """Orders as index entries: a key's customer, a file per priority, a fragment per year."""
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("file_path"), F.year("o_orderdate").cast("long").alias("seq"), F.lit(False).alias("tombstone"), F.col("o_orderkey").alias("entry"))


_ENTRY_SQL = "entries as (select o_custkey::varchar as key, o_orderpriority file_path, year(o_orderdate)::bigint seq, o_orderkey entry from orders)"
_FILES = [("1-URGENT", 1994, False, "dropped"), ("2-HIGH", 1995, True, "dropped"), ("3-MEDIUM", 1996, True, "live"), ("3-MEDIUM", 1992, False, "live"), ("5-LOW", 1993, False, "live")]


def _files(spark):
    return spark.createDataFrame(_FILES, "file_path string, seq long, snapshot boolean, role string")


def dropped_and_superseded(spark, sf_dir):
    none = spark.createDataFrame([], "key string")
    return live_entries(_as_entries(spark, sf_dir), _files(spark), none).select("key", "file_path", "seq", "entry")


def tombstones_and_forgotten(spark, sf_dir):
    e = _as_entries(spark, sf_dir)
    stones = spark.createDataFrame([(str(k), None, 1995, True, None) for k in range(1, 60, 3)], e.schema)
    hidden = spark.createDataFrame([(str(k),) for k in range(2, 60, 3)], "key string")
    return live_entries(e.unionByName(stones), _files(spark).limit(0), hidden).select("key", "seq", "entry")


def compact_last_wins(spark, sf_dir):
    e = _as_entries(spark, sf_dir).groupBy("key", "file_path", "seq").agg(F.max("entry").alias("entry"))
    return last_wins(e)


def forget_and_compact(spark, sf_dir):
    index = _new(spark, "ts")
    for _ in range(2):
        index.build(f"{sf_dir}/events.parquet", ["user_id"], covering=EVENTS, buckets=4)
    index.forget(["1", "13"])
    index.compact()
    return index.entries().select("key", "value_count")


def duplicate_fragments(spark, sf_dir):
    """Two plain fragments of one file show its rows twice until they are compacted."""
    index = _new(spark, "ts")
    for _ in range(2):
        index.build(f"{sf_dir}/events.parquet", ["user_id"], buckets=4)
    return _plain_events(index.lookup("13").rows)


def snapshot_files_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    now = o.filter("year(o_orderdate) >= 1994").select(F.concat(F.lit("/d/"), "o_orderpriority", F.lit("-"), F.col("o_orderkey").cast("string")).alias("file_path"))
    was = o.filter("year(o_orderdate) <= 1996").select(F.concat(F.lit("file:///d/"), "o_orderpriority", F.lit("-"), F.col("o_orderkey").cast("string")).alias("file_path"))
    added, gone = snapshot_diff(now, was)
    out = added.withColumn("what", F.lit("added")).unionByName(gone.withColumn("what", F.lit("gone")))
    return out.select("what", F.regexp_replace("file_path", "^file:/*", "/").alias("file_path"))


def snapshot_index(spark, sf_dir):
    """A snapshot with an equality delete, then one in which a second file has come."""
    index = _new(spark, "ts")
    folder = shared_folder(spark, "snapshots")
    ev = _t(spark, sf_dir, "events")
    for k in (0, 1):
        ev.filter(f"event_id % 2 = {k}").coalesce(1).write.parquet(f"{folder}/d{k}")
    ev.filter("user_id < 5").select("user_id").distinct().coalesce(1).write.parquet(f"{folder}/eq")
    f = lambda name: [r[0] for r in spark.read.parquet(f"{folder}/{name}").select("_metadata.file_path").distinct().collect()]
    first = Snapshot(1, folder, [(p, 1) for p in f("d0")], [], [(p, 2) for p in f("eq")])
    index_snapshot(index, first, ["user_id"])
    index_snapshot(index, Snapshot(2, folder, first.data + [(p, 3) for p in f("d1")], [], first.equalities), ["user_id"])
    return index.entries().groupBy("key").agg(F.sum("value_count").alias("value_count"))


def v1_import(spark, sf_dir):
    """Entries of a JSON-lines fragment, whose runs of rows are a first row and a count."""
    folder, ev = shared_folder(spark, "v1"), _t(spark, sf_dir, "events")
    lines = ev.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.array(F.max("user_id").cast("long") * 1000).alias("row_numbers"), F.count(F.lit(1)).alias("value_count"))
    lines.select("key", F.lit(0).alias("file"), "row_numbers", "value_count").write.json(f"{folder}/buckets")
    fs = Fs(spark, folder)
    for name in fs.list("buckets"):
        if name.endswith(".json"):
            fs.rename(f"buckets/{name}", f"buckets/{name}l")
    fs.write("manifest.json", json.dumps({"fragment_id": "old", "files": ["/d/a.parquet"], "num_buckets": 1, "file_idents": [{"path": "/d/a.parquet", "size": 5}]}))
    entries, files, manifest = read_v1_fragment(spark, folder)
    index = _new(spark, "ts")
    index.store.append(manifest["fragment_id"], entries, files, 4, key_columns=["user_id"])
    rows = F.col("row_numbers")
    return index.entries().select("key", "value_count", F.size(rows).cast("long").alias("n_rows"), F.element_at(rows, 1).alias("first_row"), F.element_at(rows, -1).alias("last_row"), "file_size")


def fragments_on_disk(spark, sf_dir):
    """A fragment, the same id again, another one, and what compaction leaves of them on disk."""
    index, out = _new(spark, "ts"), []
    for name in ("a", "a", "b", None):
        if name is None:
            index.compact()
        else:
            index.build(f"{sf_dir}/events.parquet", ["user_id"], fragment_id=name, buckets=4)
        out.append((len(out), len(index.store.registry()), len(index.store.fs.list("fragments")), index.entries().count()))
    return spark.createDataFrame(out, "step int, n_fragments int, n_folders int, n_entries long")


def lake_index(spark, sf_dir):
    """An index over a generated lake of date and bucket folders."""
    folder = shared_folder(spark, "lake")
    layouts.lake(spark, folder, users=40, per_user=6, days=2, buckets=3)
    index = _new(spark, "timestamp")
    index.build(folder, ["user_id"], covering=cov.Covering("timestamp", "duration_ms"))
    c = F.col("covering")
    return index.entries().groupBy("key").agg(F.sum("value_count").alias("value_count"), F.sum(((c["max_ts"] - c["min_ts"]) / 180_000 >= 4).cast("long")).alias("spans"))


def covering_refused(spark, sf_dir):
    """Covering values of a table that has nothing to cover, and of one that has."""
    out = []
    for table, key in (("region", "r_regionkey"), ("events", "user_id")):
        try:
            _new(spark, "ts").build(f"{sf_dir}/{table}.parquet", [key], covering=True)
            out.append((table, True))
        except ValueError:
            out.append((table, False))
    return spark.createDataFrame(out, "name string, built boolean")


def _avro(spark, path: str, schema: dict, records: list[dict]) -> None:
    """Writes an Avro file, by the library that Spark has."""
    jvm, fs = spark._jvm, Fs(spark, "")
    generic, kind = jvm.org.apache.avro.generic, jvm.org.apache.avro.Schema.Parser().parse(json.dumps(schema))
    system, at = fs._p(path)
    out = system.create(at, True)
    writer = jvm.org.apache.avro.file.DataFileWriter(generic.GenericDatumWriter(kind)).create(kind, out)

    def record(kind, value):
        r = generic.GenericData.Record(kind)
        for k, v in value.items():
            r.put(k, record(kind.getField(k).schema(), v) if isinstance(v, dict) else v)
        return r

    for value in records:
        writer.append(record(kind, value))
    writer.close()


def snapshot_of_a_table(spark, sf_dir):
    """A table's current snapshot by its metadata folder and Avro manifests: two data files, one that is gone and a position delete; then the same snapshot again."""
    folder, ev = shared_folder(spark, "table"), _t(spark, sf_dir, "events")

    def file(name, df):
        df.coalesce(1).write.parquet(f"{folder}/data/{name}")
        return spark.read.parquet(f"{folder}/data/{name}").select("_metadata.file_path").first()[0]

    d0, d1 = (file(f"d{k}", ev.filter(f"event_id % 2 = {k}")) for k in (0, 1))
    at = spark.read.parquet(d0).filter("event_id % 7 = 0").select(F.lit(d0).alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    data = {"type": "record", "name": "f", "fields": [{"name": "file_path", "type": "string"}, {"name": "content", "type": "int"}]}
    entry = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": data}]}
    listed = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}]}
    files = [(1, d0, 0), (1, d1, 0), (2, f"{folder}/data/gone.parquet", 0), (1, file("pos", at), 1)]
    meta = Fs(spark, f"{folder}/metadata")
    meta.write("version-hint.text", "1")
    _avro(spark, meta.path("m.avro"), entry, [{"status": s, "data_file": {"file_path": p, "content": c}} for s, p, c in files])
    _avro(spark, meta.path("list.avro"), listed, [{"manifest_path": meta.path("m.avro"), "sequence_number": 1}])
    meta.write("v1.metadata.json", json.dumps({"location": folder, "current-snapshot-id": 7, "snapshots": [{"snapshot-id": 7, "manifest-list": meta.path("list.avro")}]}))
    index = _new(spark, "ts")
    first, again = (index_table(index, ["user_id"], folder) for _ in range(2))
    out = index.entries().groupBy("key").agg(F.sum("value_count").alias("value_count"))
    return out.withColumns({"files_indexed": F.lit(first.files_indexed), "skipped_again": F.lit(again.skipped)})


def stream_index(spark, sf_dir):
    index = _new(spark, "ts")
    folder = shared_folder(spark, "arriving")
    _t(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(folder)
    index_new_files(index, folder, ["user_id"], shared_folder(spark, "stream"), max_files=2)
    return index.entries().groupBy("key").agg(F.sum("value_count").alias("value_count"))


# ---- SQL over looked-up rows

_SQLS = {
    "sql_hits_group_by": "select event_type, count(*) as n from hits group by event_type order by n desc, event_type",
    "sql_hits_window": "select event_id, event_type, cast(row_number() over (partition by event_type order by event_id) as bigint) as rn, coalesce(lag(event_id) over (order by event_id), -1) as before_id from hits",
    "sql_hits_rollup": "select event_type, count(*) as n, min(event_id) as lo from hits group by rollup(event_type)",
    "sql_hits_sets": "select event_id from hits where event_type = 'click' union select event_id from hits where value > 100 except select event_id from hits where event_type = 'view'",
    "sql_hits_join": "with c as (select event_type, max(value) as m from hits group by event_type) select h.event_id, h.event_type from hits h join c on h.event_type = c.event_type and h.value = c.m",
    "sql_hits_subquery": "select event_id from hits where value > (select avg(value) from hits) and exists (select 1 from hits x where x.event_type = hits.event_type and x.event_id < hits.event_id)",
}


def _sql(text: str):
    return lambda spark, sf_dir: run_sql(_events(spark, sf_dir), text, "13")


def sql_key_lookup(spark, sf_dir):
    return run_sql(_events(spark, sf_dir), "select a.event_type, count(*) as n from key_lookup('14') a join (select distinct event_type from hits) b on a.event_type = b.event_type group by a.event_type", "13")


def sql_no_key(spark, sf_dir):
    return run_sql(_events(spark, sf_dir), "select count(*) as n from hits")


def sql_accepted(spark, sf_dir):
    """Which statements run over the rows of a key."""
    out = []
    for text in _STATEMENTS:
        try:
            run_sql(_events(spark, sf_dir), text, "13")
            out.append((text, True))
        except LodestoneError:
            out.append((text, False))
    return spark.createDataFrame(out, "statement string, accepted boolean")


_STATEMENTS = {
    "select count(*) from hits": True,
    "with h as (select * from hits) select * from h": True,
    "select * from key_lookup('14')": True,
    "select 1": False,
    "select * from other": False,
    "select * from hits join parquet.`/tmp/x` p on true": False,
    "insert overwrite directory '/tmp/x' using parquet select * from hits": False,
    "create temporary view v as select * from hits": False,
    "select (select max(a) from other) from hits": False,
    "show tables": False,
    "set spark.sql.ansi.enabled = false": False,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        key_bucket, key_text_timestamp, postings_by_key, compound_key_index, timestamp_key_index, covering_flat, covering_orders, cogroup_sizes, blob_expand,
        index_build, point_lookup, point_lookup_projection, point_lookup_time_window, point_lookup_missing, paginate, paginate_then_window, multi_key_lookup, multi_key_join, multi_key_paged,
        covering_only, min_count_entries, entries_by_predicate, explain_counts, index_stats, stats_of_fragments, verify_files, verify_rows, verify_changed, full_scan, compound_lookup, json_sink, json_sink_types,
        secondary_exact, secondary_range, secondary_prefix, secondary_rows, secondary_rows_all, secondary_page, secondary_deleted, secondary_second_fragment, secondary_lineitem,
        equality_delete, position_delete, lookup_deleted, dropped_and_superseded, tombstones_and_forgotten, compact_last_wins, forget_and_compact, duplicate_fragments, snapshot_files_diff, snapshot_index, stream_index,
        sql_key_lookup, sql_no_key, sql_accepted,
        lookup_order, lookup_alias, lookup_dedupe, lookup_totals, lookup_changed_file, explain_pages, time_arguments, percentiles, secondary_items,
        v1_import, fragments_on_disk, lake_index, covering_refused, snapshot_of_a_table,
    ]
    out = {f.__name__: f for f in plain}
    out |= {f"layout_{n}": _layout_covering(n, s) for n, s in (("unsorted", "flat"), ("sorted", "flat"), ("key_pages", "flat"), ("cogrouped", "nested"), ("blob", "blob"))}
    out |= {f"lookup_{n}": _layout_lookup(n, s, t) for n, s, t in (("cogrouped", "nested", "timestamp"), ("blob", "blob", "timestamp_ms"))}
    return out | {k: _sql(v) for k, v in _SQLS.items()}


def oracle_sql() -> dict[str, str]:
    hits = "hits as (select * from events where user_id = 13)"
    covering = "select {k}::varchar as key, count(*)::bigint value_count, round(sum(greatest({v}, 0)::decimal(38,6))::double, 2) as total, min(epoch_us({t}) // 1000)::bigint min_ts, max(epoch_us({t}) // 1000)::bigint max_ts from {f} group by 1"
    bucket = "(('0x' || substr(sha256({0}), 1, 16))::ubigint % {1})::integer"
    layout = "select user_id::varchar as key, count(*)::bigint value_count, sum(greatest(floor(value * 100)::bigint, 0))::double as total, min(epoch_us(ts) // 1000)::bigint min_ts, max(epoch_us(ts) // 1000)::bigint max_ts from events group by 1"
    kept = "kept as (select * from events e where event_id % 7 <> 0 and not exists (select 1 from events d where d.event_id % 10 = 3 and d.user_id is not distinct from e.user_id and d.event_type is not distinct from e.event_type))"
    path = "'/d/' || o_orderpriority || '-' || o_orderkey::varchar"
    out = {
        "key_bucket": f"select distinct user_id::varchar as key, {bucket.format('user_id::varchar', 16)} bucket from events",
        "key_text_timestamp": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as key from events",
        "postings_by_key": "select user_id::varchar as key, count(*)::bigint value_count, count(*)::bigint n_rows from events group by 1",
        "compound_key_index": "select concat(l_orderkey::varchar, chr(31), l_linenumber::varchar) as key, count(*)::bigint value_count from lineitem group by 1",
        "timestamp_key_index": "select strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') as key, count(*)::bigint value_count from orders group by 1",
        "covering_flat": covering.format(k="user_id", v="value", t="ts", f="events"),
        "covering_orders": covering.format(k="o_custkey", v="o_totalprice", t="o_orderdate", f="orders"),
        "cogroup_sizes": "select user_id, count(*)::bigint n, arg_min(event_id, (ts, event_id)) first_event from events group by 1",
        "blob_expand": "select event_id, json_extract_string(props, '$.k') k from events",
        "index_build": f"select {bucket.format('user_id::varchar', 16)} bucket, count(distinct user_id)::bigint n_keys, count(*)::bigint value_count from events group by 1",
        "point_lookup": f"select {_EVENT_SQL} from events where user_id = 13",
        "point_lookup_projection": "select event_id, event_type from events where user_id = 13",
        "point_lookup_time_window": f"select {_EVENT_SQL} from events where user_id = 13 and epoch_us(ts) // 1000 between {_T0} and {_T1}",
        "point_lookup_missing": f"select {_EVENT_SQL} from events where false",
        "paginate": f"select {_EVENT_SQL} from events where user_id = 13 order by event_id limit 5 offset 2",
        "paginate_then_window": f"select {_EVENT_SQL} from (select * from events where user_id = 13 order by event_id limit 40 offset 1) where epoch_us(ts) // 1000 >= {_T0}",
        "multi_key_lookup": f"select user_id::varchar as key, {_EVENT_SQL} from events where user_id in (1, 13, 14)",
        "multi_key_join": "select user_id::varchar as key, count(*)::bigint n, round(sum(value::decimal(18,4))::double, 2) total from events where user_id in (select user_id from events where event_type = 'purchase' and value > 150) group by 1",
        "multi_key_paged": f"select key, event_id, ts_ms, user_id, event_type, value, props from (select user_id::varchar as key, {_EVENT_SQL}, row_number() over (partition by user_id order by event_id) rn from events where user_id in (1, 13, 14)) where rn between 2 and 4",
        "covering_only": "select count(*)::bigint value_count, round(sum(greatest(value, 0)::decimal(38,6))::double, 2) total, min(epoch_us(ts) // 1000)::bigint min_ts, max(epoch_us(ts) // 1000)::bigint max_ts from events where user_id = 13",
        "min_count_entries": "select user_id::varchar as key, count(*)::bigint value_count from events group by 1 having count(*) >= 60",
        "explain_counts": f"select '13' as key, {bucket.format(chr(39) + '13' + chr(39), 16)} bucket, 1::bigint entries, count(*)::bigint n_rows from events where user_id = 13",
        "index_stats": "select count(distinct user_id)::bigint num_keys, count(distinct user_id)::bigint num_entries from events",
        "verify_files": "select 'events' as name, 'ok' as status",
        "verify_rows": "select 'events' as name, 'ok' as status",
        "verify_changed": "select * from (values ('d0', 'ok'), ('d1', 'stale'), ('d2', 'stale')) v(name, status)",
        "stats_of_fragments": "select 1::bigint num_files, 1::bigint num_fragments, 16::bigint num_buckets, 'user_id' key_columns",
        "entries_by_predicate": f"select user_id::varchar as key, count(*)::bigint value_count from events group by 1 having count(*) >= 60 and max(epoch_us(ts) // 1000) >= {_T1} and min(epoch_us(ts) // 1000) <= {_T1 + 86_400_000}",
        "json_sink_types": "select event_id, event_type t, value::decimal(12,2)::varchar d, '0.00' zero, lower(hex(event_type::blob)) raw, case when value > 50 then null else 0.5::double end x, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') ts from events",
        "sql_accepted": "select * from (values " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {str(ok).lower()})" for t, ok in _STATEMENTS.items()) + ") v(statement, accepted)",
        "lookup_order": "select event_id, row_number() over (order by epoch_us(ts) // 1000, event_id) - 1 as at from events where user_id = 13",
        "lookup_alias": "select epoch_us(ts) // 1000 ts_ms, floor(value * 100)::bigint duration_ms from events where user_id = 13",
        "lookup_dedupe": f"select {_EVENT_SQL} from events where user_id = 13",
        "lookup_totals": "select v.name, case when v.skipped = 0 then (select count(*) from events where user_id = 13) else 0 end::bigint value_count, v.skipped::bigint skipped, v.files::bigint files from (values ('all', 0, 1), ('late', 1, 0), ('few', 1, 0), ('index', 0, 0)) v(name, skipped, files)",
        "lookup_changed_file": "select 'before' as name, count(*)::varchar found from events where user_id = 13 union all select 'after', 'stale_file_identity'",
        "explain_pages": 'select count(*)::bigint n_rows, 4::bigint n_columns, true as few, true as "within" from events where user_id = 13',
        "time_arguments": "select * from (select text, e end_of_day, case when text ~ '^-?[0-9]+$' then text::bigint when length(text) = 10 then epoch_ms(text::timestamp) + case when e then 86399999 else 0 end else epoch_ms(text::timestamptz) end ms from (values " + ", ".join(f"('{t}')" for t in _TIMES) + ") t(text), (values (false), (true)) b(e))",
        "percentiles": "select p::double p, list_extract(list_sort(vs), (round_even((len(vs) - 1) * p::double, 0) + 1)::bigint) as value from (select list(n_nationkey::double) vs from nation), (values (0.0), (0.25), (0.5), (0.9), (0.99), (1.0)) v(p)",
        "secondary_items": "select event_type dim, user_id::varchar as key, count(*)::bigint value_count from events group by 1, 2",
        "v1_import": "select user_id::varchar as key, count(*)::bigint value_count, count(*)::bigint n_rows, user_id::bigint * 1000 first_row, user_id::bigint * 1000 + count(*) - 1 last_row, 5::bigint file_size from events group by user_id",
        "fragments_on_disk": "select v.step::integer step, v.n::integer n_fragments, v.n::integer n_folders, (v.e * (select count(distinct user_id) from events))::bigint n_entries from (values (0, 1, 1), (1, 1, 1), (2, 2, 2), (3, 1, 1)) v(step, n, e)",
        "lake_index": "select 'user_' || lpad(i::varchar, 4, '0') as key, 6::bigint value_count, 1::bigint spans from range(40) r(i)",
        "covering_refused": "select * from (values ('region', false), ('events', true)) v(name, built)",
        "snapshot_of_a_table": "select user_id::varchar as key, count(*)::bigint value_count, 2::integer files_indexed, true skipped_again from events where event_id % 14 <> 0 group by 1",
        "full_scan": f"select {_EVENT_SQL} from events where user_id = 13",
        "compound_lookup": "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_orderkey = 7 and l_linenumber = 1",
        "json_sink": "select event_id, event_type from events where user_id = 13",
        "secondary_exact": "select event_type dim, user_id::varchar as key, count(*)::bigint value_count from events where event_type = 'click' group by 1, 2",
        "secondary_range": "select event_type dim, user_id::varchar as key, count(*)::bigint value_count from events where event_type between 'c' and 'p' group by 1, 2",
        "secondary_prefix": "select event_type dim, user_id::varchar as key, count(*)::bigint value_count from events where starts_with(event_type, 'p') group by 1, 2",
        "secondary_rows": f"select {_EVENT_SQL} from events where event_type = 'error' and user_id in (13, 14)",
        "secondary_rows_all": f"select {_EVENT_SQL} from events where event_type = 'error'",
        "secondary_page": f"select {_EVENT_SQL} from events where event_type = 'view' order by event_id limit 7 offset 3",
        "lookup_deleted": f"with {kept} select {_EVENT_SQL} from kept where user_id = 13",
        "secondary_deleted": f"with {kept} select {_EVENT_SQL} from kept",
        "secondary_second_fragment": f"select {_EVENT_SQL} from events where event_type = 'error' and user_id <> 13",
        "secondary_lineitem": "select l_returnflag dim, l_suppkey::varchar as key, count(*)::bigint value_count from lineitem group by 1, 2",
        "equality_delete": "select event_id from events e where not exists (select 1 from events d where d.event_id % 10 = 0 and d.user_id is not distinct from e.user_id and d.event_type is not distinct from e.event_type)",
        "position_delete": "select event_id from events where event_id % 7 <> 0",
        "dropped_and_superseded": f"with {_ENTRY_SQL} select key, file_path, seq, entry from entries where not (file_path = '1-URGENT' and seq <= 1994) and not (file_path = '2-HIGH' and seq < 1995) and not (file_path = '3-MEDIUM' and seq < 1996)",
        "tombstones_and_forgotten": f"with {_ENTRY_SQL} select key, seq, entry from entries where not (key::bigint < 60 and key::bigint % 3 = 1 and seq <= 1995) and not (key::bigint < 60 and key::bigint % 3 = 2)",
        "compact_last_wins": f"with {_ENTRY_SQL}, e as (select key, file_path, seq, max(entry) entry from entries group by all) select key, file_path, seq, entry from (select *, row_number() over (partition by key, file_path order by seq desc) r from e) where r = 1",
        "forget_and_compact": "select user_id::varchar as key, count(*)::bigint value_count from events where user_id not in (1, 13) group by 1",
        "duplicate_fragments": f"select {_EVENT_SQL} from events where user_id = 13 union all select {_EVENT_SQL} from events where user_id = 13",
        "snapshot_files_diff": f"(select 'added' what, {path} file_path from orders where year(o_orderdate) > 1996) union all (select 'gone' what, {path} file_path from orders where year(o_orderdate) < 1994)",
        "snapshot_index": "select user_id::varchar as key, count(*)::bigint value_count from events where event_id % 2 = 1 or user_id >= 5 group by 1",
        "stream_index": "select user_id::varchar as key, count(*)::bigint value_count from events group by 1",
        "sql_key_lookup": "select event_type, count(*)::bigint n from events where user_id = 14 and event_type in (select event_type from events where user_id = 13) group by 1",
        "sql_no_key": "select 0::bigint n",
    }
    items = f"select epoch_us(ts) // 1000 ts_ms, event_type track_uri, floor(value * 100)::bigint duration_ms from events where user_id = 13 and ts_ms between {_T0} and {_T1} order by 1, 2, 3 limit 5"
    out |= {"lookup_cogrouped": items, "lookup_blob": items}
    out |= {f"layout_{n}": layout for n in ("unsorted", "sorted", "key_pages", "cogrouped", "blob")}
    return out | {k: f"with {hits}, {v[5:]}" if v.startswith("with ") else f"with {hits} {v}" for k, v in _SQLS.items()}
