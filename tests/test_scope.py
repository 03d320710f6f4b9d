"""What SQL over looked-up keys may do, and what secondary indexes and lookups show after deletes and later fragments."""

import pytest
from pyspark.sql import functions as F

from lodestone.errors import SqlScopeError
from lodestone.operators.index import Index, QueryOptions
from lodestone.operators.secondary import Secondary
from lodestone.operators.sql_scope import run_sql


@pytest.fixture(scope="module")
def index(spark, listens, tmp_path_factory):
    out = Index(spark, str(tmp_path_factory.mktemp("scope") / "index"))
    out.build(listens, ["user_id"])
    return out


@pytest.mark.parametrize(
    "sql",
    [
        "insert overwrite directory '{0}' using parquet select * from hits",
        "from hits insert overwrite directory '{0}' using parquet select *",
        "create table t as select * from hits",
        "create temporary view v as select * from hits",
        "cache table hits",
        "explain select * from hits",
        "set spark.sql.ansi.enabled=false",
        "select * from (with secret as (select * from hits) select * from secret) a join secret",
        "select * from hits where exists (select 1 from secret)",
        "select (select max(x) from secret) from hits",
        "with a as (select * from secret), secret as (select * from hits) select * from a",
        "select * from hits, lateral (select * from secret)",
    ],
)
def test_only_queries_over_the_scope(spark, index, tmp_path, sql):
    spark.range(3).withColumnRenamed("id", "x").createOrReplaceGlobalTempView("secret")
    with pytest.raises(SqlScopeError):
        run_sql(index, sql.format(tmp_path / "out"), "user_0001")
    assert not (tmp_path / "out").exists()


def test_names_of_ctes_are_in_scope(index):
    sql = "with a as (select * from hits), b as (select * from a where exists (select 1 from a x where x.track_uri = a.track_uri)) select count(*) as n from b"
    assert run_sql(index, sql, "user_0001").first().n == 6


def test_literal_key_lookup_is_pruned(index):
    out = run_sql(index, "select count(*) as n from key_lookup('user_0002') k join (select distinct user_id from key_lookup('user_0003')) x on true", "user_0001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,user_0002)" in plan and "EqualTo(user_id,user_0003)" in plan
    assert out.first().n == 6


def test_key_lookup_of_other_arguments(index):
    out = run_sql(index, "select count(*) as n from key_lookup(concat('user_', '0002'))")
    assert out.first().n == 6


def test_key_filter_of_a_batch_reaches_the_scan(index):
    plan = index.lookup_many(["user_0002", "user_0005"])._jdf.queryExecution().executedPlan().toString()
    assert "In(user_id, [user_0002,user_0005])" in plan
    assert index.lookup_many(["user_0002", "user_0005", "user_0002"]).count() == 12


def test_more_files_than_the_driver_lists(index, monkeypatch):
    monkeypatch.setattr("lodestone.operators.index.LISTED", 1)
    keys = index.spark.createDataFrame([("user_0002",), ("user_0005",), ("user_0011",)], "key string")
    assert index.lookup_many(keys).groupBy("key").count().collect() and index.lookup_many(keys).count() == 18


def test_secondary_leaves_deleted_rows_out_and_follows_fragments(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    data = spark.read.parquet(listens).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    index.build(listens, ["user_id"], position_deletes=data.filter("pos % 6 = 0").select("file_path", "pos"))
    s = Secondary(index, "user_id").build()
    key = "user_0004"
    live = index.lookup(key).rows.count()
    assert 0 < live < 6 and s.rows(s.lookup_exact(key)).count() == live
    more = str(tmp_path / "more")
    spark.read.parquet(listens).filter(F.col("user_id") == key).coalesce(1).write.parquet(more)
    index.build(more, ["user_id"])
    assert s.rows(s.lookup_exact(key)).count() == live + 6 == index.lookup(key).rows.count()
    index.build([], ["user_id"], dropped=[r[0] for r in spark.read.parquet(more).select("_metadata.file_path").distinct().collect()])
    assert s.rows(s.lookup_exact(key)).count() == live == index.lookup(key).rows.count()
    index.compact()
    assert s.rows(s.lookup_exact(key)).count() == live == index.lookup(key).rows.count()
    index.forget([key])
    assert s.lookup_exact(key).isEmpty() and index.lookup(key).rows.count() == 0


def test_pages_of_a_lookup_follow_the_order_of_rows(index):
    whole = [(r.source_file, r.row_number) for r in index.lookup("user_0007").rows.collect()]
    assert len(whole) == 6
    for offset in (0, 2, 5, 6, 9):
        for limit in (None, 0, 1, 3, 50):
            got = [(r.source_file, r.row_number) for r in index.lookup("user_0007", offset=offset, limit=limit).rows.collect()]
            assert got == whole[offset:][: limit if limit is not None else None]


def test_many_addresses_are_not_sent_to_all_tasks(spark, tmp_path):
    """Spark takes 24,000 row numbers for 0.1 MB, those of a table 60 times sf0.1 for 9 MB, and would send them to all tasks."""
    path = str(tmp_path / "d")
    spark.range(24_000).selectExpr("id", "cast(id % 3 as string) u", "cast(id % 4 as string) d", "id timestamp").coalesce(1).write.parquet(path)
    index = Index(spark, str(tmp_path / "i"))
    index.build(path, ["u"])
    s = Secondary(index, "d").build()
    spec = {"items": None, "payload": None}
    keys = spark.createDataFrame([("0",), ("1",), ("2",), ("9",)], "key string")
    many = {
        "refs": (s._refs_of(index.store.manifests()[0], spec), 12),
        "rows": (s.rows(s.lookup_range("0", "9")), 24_000),
        "lookup_many": (index.lookup_many(keys), 24_000),
        "sql": (run_sql(index, "select v.* from (values ('0'), ('1'), ('2')) a(x), lateral (select * from key_lookup(a.x)) v"), 24_000),
    }
    few = {"rows": (s.rows(s.lookup_exact("1")), 6_000), "lookup_many": (index.lookup_many(["1"]), 8_000), "pages": (index.lookup_many(["1", "2"], QueryOptions(limit=5)), 10)}
    for cases, sent in ((many, False), (few, True)):
        for name, (df, n) in cases.items():
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert ("Generate explode(row_numbers" in plan or "posexplode(row_numbers" in plan), name
            joins = [x for x in plan.splitlines() if "Join" in x and "_row" in x]
            assert joins and all(("BroadcastHashJoin" in x) == sent for x in joins), (name, plan)
            assert df.count() == n, name
    assert s.rows(s.lookup_range("0", "9")).select(F.sum("id"), F.countDistinct("id")).first() == (24_000 * 23_999 // 2, 24_000)
