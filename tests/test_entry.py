import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in pdf.astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, db, name):
    got, want = core.queries()[name](spark, SF).toPandas(), db.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_verify_rows_shows_stale_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    query = core.queries()["verify_rows"]
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == [("events", "ok")] * 3
    next((tmp_path / "events.parquet").glob("part-*")).unlink()
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == [("events", "ok")] * 2 + [("events", "stale")]


def test_secondary_rows_of_every_key(spark, db):
    got = core.queries()["secondary_rows_all"](spark, SF).toPandas()
    assert got.user_id.nunique() == db.sql("select count(distinct user_id) from events where event_type = 'error'").limit(1).fetchall()[0][0] > 2
