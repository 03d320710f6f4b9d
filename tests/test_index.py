import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.errors import IndexLocked, SqlScopeError, StaleFile, UnsupportedFormat
from lodestone.functions.covering import Covering
from lodestone.operators.index import Index, QueryOptions, naive_scan
from lodestone.operators.postings import apply_equality_deletes, canonical
from lodestone.operators.secondary import Secondary
from lodestone.operators.sql_scope import run_sql
from lodestone.plans import store
from lodestone.plans.fs import Fs
from lodestone.plans.liveness import live_entries
from lodestone.sources import layouts
from lodestone.sources.pages import coalesce_ranges
from lodestone.sources.sinks import json_rows, read_v1_fragment


@pytest.fixture(scope="module")
def built(spark, listens, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("ix") / "index"))
    index.build(listens, ["user_id"], covering=True, buckets=4)
    return index


def bag(df, *drop):
    return sorted(map(repr, df.drop("source_file", "row_number", *drop).collect()))


def test_lookup_equals_scan(spark, listens, built):
    for key in ("user_0000", "user_0023", "nobody"):
        assert bag(built.lookup(key).rows) == bag(naive_scan(spark, listens, ["user_id"], key))
    r = built.lookup("user_0003")
    times = [x.timestamp for x in r.rows.collect()]
    assert times == sorted(times) and r.metrics["totals"]["value_count"] == 6


@pytest.mark.parametrize("layout", layouts.LAYOUTS)
def test_layouts(spark, tmp_path, layout):
    rows = layouts.sample_listens(spark, 8, 5, seed=7)
    path = str(tmp_path / "d")
    layouts.write_layout(rows, path, layout)
    index = Index(spark, str(tmp_path / "i"))
    index.build(path, ["user_id"], covering=True)
    c = index.covering("user_0002").agg(F.sum("value_count").alias("value_count"), F.sum("total").alias("total"), F.min("min_ts").alias("min_ts")).first()
    want = rows.filter("user_id = 'user_0002'").agg(F.count("*"), F.sum("duration_ms"), F.min(F.unix_millis(F.col("timestamp").cast("timestamp")))).first()
    assert (c.value_count, int(c.total), c.min_ts) == tuple(want)
    assert bag(index.lookup("user_0002").rows) == bag(naive_scan(spark, path, ["user_id"], "user_0002"))


def test_pages_are_disjoint_and_complete(built):
    pages = [bag(built.lookup("user_0001", offset=o, limit=2).rows) for o in (0, 2, 4, 6)]
    assert [len(p) for p in pages] == [2, 2, 2, 0]
    assert sorted(sum(pages, [])) == bag(built.lookup("user_0001").rows)
    with pytest.raises(ValueError):
        QueryOptions(offset=-1)


def test_predicates(built):
    c = built.covering("user_0001").first()
    assert built.lookup("user_0001", since_ms=c.max_ts, until_ms=c.max_ts).rows.count() == 1
    r = built.lookup("user_0001", since_ms=c.max_ts + 1)
    assert r.rows.count() == 0 and r.metrics["totals"]["skipped_by_predicate"] == 1
    assert built.lookup("user_0001", min_count=7).metrics["totals"]["value_count"] == 0
    assert built.lookup("user_0001", covering_only=True).covering.first().value_count == 6
    e = built.explain("user_0001", QueryOptions(since_ms=c.max_ts + 1))
    assert (e["num_entries"], e["num_entries_after_predicates"], e["skipped_by_predicate"]) == (1, 0, 1)


def test_pages_within_files(spark, tmp_path):
    path = str(tmp_path / "d")
    layouts.write_layout(layouts.sample_listens(spark, 60, 50), path, "key_pages", files=1, page_rows=100)
    index = Index(spark, str(tmp_path / "i"))
    index.build(path, ["user_id"])
    e, whole = index.explain("user_0007", QueryOptions(columns=["track_uri"]), pages=True), index.explain("user_0007")
    assert e["page_descriptions"] and {p["column"] for p in e["page_descriptions"]} == {"track_uri"}
    assert 0 < e["estimated_bytes"] < whole["estimated_bytes"] / 4 and e["estimated_range_gets"] >= 1
    assert coalesce_ranges([(5, 9), (0, 2), (2, 4), (20, 30)], gap=1) == [(0, 9), (20, 30)]


def test_page_before_window(built):
    """A page may hold fewer rows than its limit, as the time window comes after it."""
    c = built.covering("user_0001").first()
    assert built.lookup("user_0001", limit=2, since_ms=c.max_ts).rows.count() == 0


def test_projection(built):
    rows = built.lookup("user_0001", columns=["track_uri", "timestamp_ms", "nothing"]).rows
    assert rows.columns == ["timestamp", "track_uri", "source_file", "row_number"]


def test_lookup_many(spark, listens, built):
    keys = spark.createDataFrame([("user_0001",), ("user_0002",), ("x",), ("user_0001",)], "key string")
    for asked in (["user_0001", "user_0002", "x"], keys):
        out = built.lookup_many(asked)
        assert {r.key: r["count"] for r in out.groupBy("key").count().collect()} == {"user_0001": 6, "user_0002": 6}
    paged = built.lookup_many(["user_0001", "user_0002"], QueryOptions(offset=4, limit=5))
    assert paged.count() == 4


def test_only_the_keys_buckets_are_read(built):
    plan = built.entries(["user_0001"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    plan = built.lookup("user_0001").rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,user_0001)" in plan


def test_compound_and_other_keys(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(listens, ["user_id", "track_uri"])
    one = spark.read.parquet(listens).first()
    assert index.lookup(f"{one.user_id}\x1f{one.track_uri}").rows.count() >= 1
    by_time = Index(spark, str(tmp_path / "t"))
    by_time.build(listens, ["duration_ms"])
    assert by_time.lookup(str(one.duration_ms)).rows.count() >= 1


def test_lifecycle(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    for _ in range(2):
        index.build(listens, ["user_id"], covering=True, buckets=4)
    assert index.lookup("user_0001").rows.count() == 12
    assert index.lookup("user_0001", dedupe=True).rows.count() == 6
    s = Secondary(index, "track_uri").build()
    index.forget(["user_0002"])
    assert index.lookup("user_0002").rows.count() == 0
    index.build(listens, ["user_id"], covering=True, buckets=4)
    assert index.lookup("user_0002").rows.count() == 0  # sticky
    report = index.compact("c1")
    assert (report["keys"], report["entries"], report["dropped_tombstoned_keys"]) == (23, 23, 1)
    assert os.listdir(tmp_path / "i" / "fragments") == ["c1"]
    assert index.lookup("user_0001").rows.count() == 6 and index.lookup("user_0002").rows.count() == 0
    assert s.lookup_prefix("track").filter("key = 'user_0002'").count() == 0
    assert s.lookup_prefix("track").select("key").distinct().count() == 23


def test_large_buckets_are_written_by_many_tasks(spark, listens, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "TASK_BYTES", 64)
    index = Index(spark, str(tmp_path / "i"))
    index.build(listens, ["user_id"], buckets=2, fragment_id="a")
    per = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "i" / "fragments" / "a" / "entries").glob("bucket=*")]
    assert len(per) == 2 and max(per) > 1
    plain = Index(spark, str(tmp_path / "j"))
    monkeypatch.undo()
    plain.build(listens, ["user_id"], buckets=2, fragment_id="a")
    rows = lambda i: sorted((r.key, r.file_path, r.row_numbers) for r in i.entries().collect())
    assert rows(index) == rows(plain) and rows(index)


def test_same_fragment_id_overwrites(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    for _ in range(2):
        index.build(listens, ["user_id"], fragment_id="f")
    assert index.stats()["num_fragments"] == 1 and index.lookup("user_0001").rows.count() == 6


def test_secondary(spark, listens, built):
    s = Secondary(built, "track_uri").build()
    some = spark.read.parquet(listens).first().track_uri
    refs = s.lookup_exact(some)
    assert s.rows(refs).filter(F.col("track_uri") == some).count() >= 1
    assert s.lookup_range("track:", "track:~").agg(F.sum("value_count")).first()[0] == 144
    assert s.lookup_range("z", "a").isEmpty()
    assert s.lookup("track:0000").count() == s.lookup_prefix("track:0000").count()


def test_staleness(spark, tmp_path):
    path = str(tmp_path / "d")
    layouts.write_layout(layouts.sample_listens(spark, 3, 2), path, "sorted", files=1)
    index = Index(spark, str(tmp_path / "i"))
    index.build(path, ["user_id"], covering=True)
    name = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet"))
    assert index.verify().first().status == "ok"
    os.utime(name, (time.time() + 60,) * 2)
    with pytest.raises(StaleFile) as e:
        index.lookup("user_0001")
    assert e.value.extra["stored"]["size"] == e.value.extra["live"]["size"]
    assert index.verify().first().status == "stale"
    assert index.lookup("user_0001", covering_only=True).covering.count() == 1
    assert index.lookup("user_0001", verify=False).rows.count() == 2
    os.remove(name)
    with pytest.raises(StaleFile) as e:
        index.lookup("user_0001")
    assert e.value.extra["live"] is None


def test_fail_closed(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="missing key column"):
        index.build(listens, ["nope"])
    assert index.store.registry() == []
    index.store.fs.write("registry.json", json.dumps({"format_version": 2, "fragments": []}))
    with pytest.raises(UnsupportedFormat):
        index.store.registry()
    index.store.fs.write("registry.json", "[]")
    assert index.store.registry() == []
    with Fs(spark, str(tmp_path / "i")).lock(), pytest.raises(IndexLocked):
        index.build(listens, ["user_id"])


def test_sql_scope(spark, built):
    assert run_sql(built, "select count(*) as n from hits", "user_0001").first().n == 6
    assert run_sql(built, "select count(*) as n from hits").first().n == 0
    assert run_sql(built, "with x as (select * from key_lookup('user_0002')) select count(*) as n from x").first().n == 6
    spark.range(3).createOrReplaceTempView("other")
    for bad in ("select 'hits'", "select 1", "select * from other, hits", f"select * from parquet.`/tmp`", "select * from hits where user_id in (select id from other)"):  # noqa: F541
        with pytest.raises(Exception) as e:
            run_sql(built, bad, "user_0001").collect()
        assert isinstance(e.value, SqlScopeError), bad


def test_liveness_orders(spark):
    e = spark.createDataFrame([("k", s, "f", False) for s in (1, 2, 3)] + [("k", s, "g", False) for s in (1, 3)], "key string, seq long, file_path string, tombstone boolean")
    none = spark.createDataFrame([], "key string")
    files = lambda *r: spark.createDataFrame(list(r), "file_path string, seq long, snapshot boolean, role string")
    live = lambda f, h=none: sorted((r.file_path, r.seq) for r in live_entries(e, f, h).collect())
    assert live(files(("f", 2, False, "dropped"))) == [("f", 3), ("g", 1), ("g", 3)]
    assert live(files(("f", 2, True, "dropped"))) == [("f", 2), ("f", 3), ("g", 1), ("g", 3)]
    assert live(files(("f", 3, True, "live"))) == [("f", 3), ("g", 1), ("g", 3)]
    assert live(files(("f", 3, False, "live"))) == [("f", 1), ("f", 2), ("f", 3), ("g", 1), ("g", 3)]
    assert live(files(("f", 9, False, "live")), spark.createDataFrame([("k",)], "key string")) == []


def test_deletes_are_null_safe(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    d = spark.createDataFrame([(1, None)], "a int, b string")
    assert apply_equality_deletes(df, [d]).count() == 2
    paths = spark.createDataFrame([("file:///a",), ("/a",), ("file:/a",), ("s3n://b/c",), ("s3://b/c",)], "p string")
    assert paths.select(canonical(F.col("p"))).distinct().count() == 2


def test_json_rows(spark):
    df = spark.sql("select 1 as a, cast(null as int) as b, double('nan') as c, X'01FF' as d, array(struct(float('inf') as x)) as e, map('k', 1) as f, 1.50bd as g")
    assert json.loads(json_rows(df).first()[0]) == {"a": 1, "b": None, "c": None, "d": "01ff", "e": [{"x": None}], "f": '{"k":1}', "g": "1.50"}


def test_v1_import(spark, tmp_path):
    f = tmp_path / "frag"
    (f / "buckets").mkdir(parents=True)
    (f / "manifest.json").write_text(json.dumps({"fragment_id": "f", "files": ["/d/a.parquet"], "num_buckets": 1, "file_idents": [{"path": "/d/a.parquet", "size": 5}]}))
    (f / "buckets" / "bucket_000.jsonl").write_text('{"key":"a","file":0,"row_numbers":[3],"value_count":4}\n{"key":"b","file":0,"row_numbers":[0,2]}\n')
    entries, files, manifest = read_v1_fragment(spark, str(f))
    assert {r.key: (r.row_numbers, r.value_count) for r in entries.collect()} == {"a": ([3, 4, 5, 6], 4), "b": ([0, 2], 2)}
    index = Index(spark, str(tmp_path / "i"))
    index.store.append("f", entries, files, 2, key_columns=["user_id"])
    assert index.entries(["a"]).first().file_size == 5


def test_empty_and_odd_inputs(spark, tmp_path):
    spark.createDataFrame([], "user_id string, timestamp timestamp_ntz, duration_ms long").write.parquet(str(tmp_path / "e"))
    index = Index(spark, str(tmp_path / "i"))
    index.build(str(tmp_path / "e"), ["user_id"], covering=Covering())
    assert index.entries().count() == 0
    with pytest.raises(ValueError):
        index.build(str(tmp_path / "e"), ["user_id"], buckets=0)


@pytest.mark.parametrize("layout, time", [("cogrouped", "timestamp"), ("blob", "timestamp_ms")])
def test_lookup_expands_items(spark, tmp_path, layout, time):
    flat = layouts.sample_listens(spark)
    layouts.write_layout(flat, str(tmp_path / "data"), layout)
    index = Index(spark, str(tmp_path / "index"))
    index.build(str(tmp_path / "data"), ["user_id"], covering=True)
    listens = flat.selectExpr("user_id", "unix_millis(cast(timestamp as timestamp)) as ms", "track_uri", "duration_ms").collect()
    want = {u: sorted(tuple(r)[1:] for r in listens if r.user_id == u) for u in ("user_0001", "user_0002")}

    def items(rows):
        when = F.col(time) if time == "timestamp_ms" else F.unix_millis(F.col(time).cast("timestamp"))
        return [tuple(r) for r in rows.select(when, "track_uri", "duration_ms").collect()]

    all_ = want["user_0001"]
    assert items(index.lookup("user_0001").rows) == all_
    window = {"since_ms": all_[1][0], "until_ms": all_[4][0]}
    assert items(index.lookup("user_0001", **window).rows) == all_[1:5]
    assert items(index.lookup("user_0001", limit=3, **window).rows) == all_[1:4]
    assert items(index.lookup("user_0001", offset=1).rows) == []  # pages count physical rows
    many = index.lookup_many(list(want), QueryOptions(limit=3))
    for u, rows in want.items():
        assert sorted(items(many.filter(F.col("key") == u))) == rows[:3]
    assert sorted(items(index.lookup_many(["user_0001"], QueryOptions(**window)))) == all_[1:5]
    assert index.lookup("none").rows.columns == index.lookup("user_0001").rows.columns
    n = run_sql(index, "select (select count(*) from hits) a, (select count(*) from key_lookup('user_0002')) b", "user_0001").first()
    assert tuple(n) == (6, 6)


def test_payload_without_items_stays(spark, tmp_path):
    rows = [("a", "no json"), ("a", '{"listens":[{"timestamp_ms":5,"track_uri":"t","duration_ms":3},{"timestamp":9}]}'), ("a", '{"listens":[]}')]
    spark.createDataFrame(rows, "user_id string, payload string").coalesce(1).write.parquet(str(tmp_path / "data"))
    index = Index(spark, str(tmp_path / "index"))
    index.build(str(tmp_path / "data"), ["user_id"], covering=True)
    out = index.lookup("a").rows.select("payload", "timestamp_ms", "track_uri", "duration_ms").collect()
    assert [tuple(r) for r in out] == [("no json", None, None, None), (None, 5, "t", 3), (None, 9, None, None)]
