import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import covering as cov
from lodestone.functions.keys import bucket_expr, bucket_of, encode_cli_key, encode_key, key_expr, typed_predicate
from lodestone.functions.times import millis, parse_time_ms
from lodestone.stress import percentile


def test_buckets_agree(spark):
    keys = ["", "a", "user_0001", "é", "x\x1fy", "1" * 500]
    df = spark.createDataFrame([(k,) for k in keys], "key string").withColumn("b", bucket_expr(F.col("key"), 13))
    assert {r.key: r.b for r in df.collect()} == {k: bucket_of(k, 13) for k in keys}


def test_compound_key_drops_null_parts(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "x string, y int")
    assert [r[0] for r in df.select(key_expr(df.schema, ["x", "y"])).collect()] == ["a\x1f1", None, None]
    assert encode_cli_key("a||1") == encode_key(["a", "1"])
    with pytest.raises(ValueError, match="missing key column"):
        key_expr(df.schema, ["z"])


def test_typed_predicates_round_trip(spark):
    rows = [(1, "s", dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59, 999_500), True, b"\x01\xff", 1.5), (-7, "", dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5, 678_901), False, b"", float("nan"))]
    df = spark.createDataFrame(rows, "i int, s string, d date, t timestamp_ntz, b boolean, x binary, f double")
    for c in df.columns:
        keyed = df.withColumn("k", key_expr(df.schema, [c]))
        for r in keyed.collect():
            assert df.filter(typed_predicate(df.schema, [c], r.k)).count() == 1, (c, r.k)
        assert df.filter(typed_predicate(df.schema, [c], "no such")).count() == 0
    assert df.filter(typed_predicate(df.schema, ["i"], "01")).count() == 0
    assert df.filter(typed_predicate(df.schema, ["i"], str(2**40))).count() == 0
    plan = df.filter(typed_predicate(df.schema, ["i", "s"], "1\x1fs"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast" not in plan.lower()


def test_millis_cut_toward_zero(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 59, 999_500),), (dt.datetime(2024, 1, 1, 0, 0, 0, 1_999),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(millis("t", df.schema["t"].dataType)).collect()] == [0, 1704067200001]


def test_parse_time():
    assert parse_time_ms("17") == 17
    assert parse_time_ms("1970-01-02") == 86_400_000
    assert parse_time_ms("1970-01-02", end_of_day=True) == 2 * 86_400_000 - 1
    assert parse_time_ms("1970-01-01T01:00:00+01:00") == 0
    for bad in ("x", "2024-13-01", "2024-01-01T00:00:00"):
        with pytest.raises(ValueError):
            parse_time_ms(bad)


def test_covering_shapes(spark):
    flat = spark.createDataFrame([("a", None, -5), ("a", dt.datetime(2024, 1, 1), 7), ("a", dt.datetime(2024, 1, 2), None)], "k string, timestamp timestamp_ntz, duration_ms long")

    def of(df, c):
        x = df.withColumns(cov.columns(c, df.schema)).groupBy("k").agg(cov.aggregate().alias("c")).first()["c"]
        return x.value_count, int(x.total), x.min_ts, x.max_ts

    assert of(flat, cov.Covering()) == (3, 7, 1704067200000, 1704153600000)
    nested = flat.groupBy("k").agg(F.collect_list(F.struct("timestamp", "duration_ms")).alias("listens"))
    assert of(nested, cov.Covering(shape="nested")) == (3, 7, 1704067200000, 1704153600000)
    none = spark.createDataFrame([("a", None)], "k string, listens array<struct<timestamp:timestamp_ntz,duration_ms:bigint>>")
    assert of(none, cov.Covering(shape="nested")) == (0, 0, None, None)
    blob = spark.createDataFrame([("a", '{"listens":[{"timestamp_ms":5,"duration_ms":3},{"timestamp":9,"duration_ms":-3}]}'), ("a", "no json")], "k string, payload string")
    assert of(blob, cov.Covering(shape="blob")) == (3, 3, 5, 9)
    with pytest.raises(ValueError):
        cov.Covering.sniff(spark.createDataFrame([(1,)], "x int").schema)


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=50), st.floats(0, 1))
def test_percentile_is_a_value(values, p):
    assert percentile(values, p) in values
