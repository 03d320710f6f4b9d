"""Repeated ids, null ids, settings and clashing names, against plain Python."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus_ops import ODD, SF, brute_jaccard, docs  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestone.llm import common, html_blocks, jaccard_join, line_spread, mih_search, poisson_mix  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int = 20) -> str:
    return " ".join(WORDS[(seed * 7 + k * (seed % 5 + 1)) % len(WORDS)] + str((seed * 31 + k) % 97) for k in range(n))


def groups(rows):
    """Rows of each group of linked ones, by brute force over row numbers."""
    numbered = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    out = {}
    for k, n, c in brute_jaccard(numbered):
        out.setdefault(c if n else ("none", k), []).append(rows[k])
    return out


def test_one_of_each_group_stays(spark):
    rows = [(None, text(1), "a"), (None, text(1), "a"), (None, text(1) + " more", "b"), (None, text(2), "a")]  # null ids
    rows += [(None, text(3), "a"), (8, text(3), "b"), (None, text(4), "a"), (9, text(5), "a"), (9, text(5), "a")]  # beside ids
    rows += [(14, text(6), "a"), (14, text(6) + " more", "a"), (14, text(7), "a"), (17, text(7), "b")]  # near copies under one id
    rows += [(24, text(8), "a"), (24, text(8), "b"), (24, text(8), "b")]  # one id and text, other columns
    rows += ODD + [(6, "x " * 30_000, "d"), (None, None, "a"), (None, "", "a")]
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs(spark, *rows)).collect()), key=repr)
    want = groups(rows)
    assert len(got) == len(want)
    for members in want.values():
        left = [(i, t) for i, t, _ in members]
        ids = [i for i, _ in left if i is not None]
        mine = [g for g in got if g in left]
        assert mine and (not ids or mine[0][0] == min(ids))


def test_rule_of_null_ids_does_not_hang_on_other_rows(spark):
    pair = [(None, text(1), "a"), (None, text(1), "a")]
    for more in ([], [(3, text(6), "a"), (3, text(7), "a")]):
        out = jaccard_join.one_of_each(docs(spark, *pair, *more)).collect()
        assert [(r.doc_id, r.text) for r in out if r.doc_id is None] == [(None, text(1))]


def test_one_of_each_keeps_columns_and_empty_tables(spark):
    d = docs(spark, (1, text(1), "a"), (2, text(1), "b")).withColumn("stays", F.lit(1)).withColumn("_h", F.lit("x")).withColumn("component_id", F.lit(7))
    out = jaccard_join.one_of_each(d)
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [1]
    assert jaccard_join.one_of_each(d.limit(0)).count() == 0
    comp = jaccard_join.jaccard_components(d)
    assert sorted((r.doc_id, r.component_id) for r in comp.collect()) == [(1, 1), (2, 1)]


@pytest.fixture
def no_ansi(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


def lines(spark):
    d = docs(spark, (1, None, "a"), (2, "", "a"), (3, "  ", "b"), *[(10 + k, f"shared line\nown {k}", f"s{k}") for k in range(14)]).withColumn("n_removed", F.lit("input"))
    out = line_spread.remove_spread_lines(d)
    assert out.columns.count("n_removed") == 1
    return sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=repr)


def test_line_spread_is_the_same_with_ansi_off(spark, request):
    on = lines(spark)
    kept = corpus_pipeline.line_dedup(spark, docs(spark, *ODD).select(*corpus_pipeline.COLUMNS), SF).count()
    request.getfixturevalue("no_ansi")
    assert lines(spark) == on
    assert {n for _, _, n in on} == {0, 1}
    assert corpus_pipeline.line_dedup(spark, docs(spark, *ODD).select(*corpus_pipeline.COLUMNS), SF).count() == kept


def test_mixing_deals_rows_of_one_id_to_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = poisson_mix.mix(docs(spark, *[(None, "same", "a")] * 600), weights={"a": 1.0}, budget=3.0)
        per = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(per) > 1 and max(r["count"] for r in per) < sum(r["count"] for r in per) * 0.6
        assert out.select("shuffle_key").distinct().count() == out.select("copy").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_arrow_setting_is_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with common.batch_bytes(spark, 1 << 20):
        assert spark.conf.get(name) == str(1 << 20)
    jaccard_join.jaccard_components(docs(spark, *ODD)).count()
    assert spark.conf.get(name) == before


def test_search_over_many_blocks(spark, monkeypatch):
    """Blocks of few rows, lists merged in several steps; the queries are copied to the blocks, the rows are not."""
    monkeypatch.setattr(mih_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(mih_search, "FAN", 2)
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    got = {}
    for r in mih_search.nearest(v).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in (i for i in rows if i % 20 == 0):
        best = sorted((-float(rows[i] @ rows[q]), i) for i in rows if i != q)[:20]
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in best})
    assert hit >= 0.9 * 20 * len(got)


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p title=don't>Hello world one.</p><p>It's fine here.</p></article>", ["Hello world one.", "It's fine here."]),
        ("<p title='a>b'>x</p><p title = \"it's > that\">y</p>", ["x", "y"]),
        ('<p title="never closed>one</p><p>two</p>', ["one", "two"]),
        ("<p \"odd'>r</p><p>s's</p>", ["r", "s's"]),
        ("<a href=/x/>l</a><br/><img src=x/>m", ["l m"]),
        ("<p a==b>w</p><p =>z</p>", ["w", "z"]),
    ],
)
def test_quotes_open_a_value_only_after_an_equals_sign(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


def test_attributes_that_name_a_block():
    (b,) = html_blocks.blocks("<div class=a id='b c' data-class=\"zz\" title=\"class=zzz\">t</div>")
    assert b.path == ("div a b c",)
