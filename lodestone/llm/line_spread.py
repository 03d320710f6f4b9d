"""Operator 3: removal of lines that many sites share, by distinct-site spread (native).

Each line (trimmed; empty ones aside) is hashed to 128 bits. A HyperLogLog sketch of the sites per line hash is
built map-side and merged by aggregation, so a line on a third of all rows costs each task one sketch. Lines
whose estimate is near the threshold get exact distinct counts. A line on min_sites sites or more is
boilerplate: it is removed everywhere but at its first place (least id, then least position), so no text is
lost from the corpus.

Defined cases: a null or empty text stays as it is; a null site is a site of its own; a null id sorts first;
repeated rows of one id count as one document: each is treated alike; white-space lines are kept; a text may
become empty; an empty table gives an empty result; extra columns pass through, an added column's name wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pack, table, unpack

MIN_SITES = 12
#: 2^LG_K buckets: a relative standard error of 1.04 / 2^(LG_K / 2), 1.6 % here.
LG_K = 12
#: Characters trimmed from a line (fixed values).
TRIM = " \t\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(TRIM))).filter("line <> ''")
    return out.select("id", "t", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes of lines on min_sites sites or more, with the first place of each: h1, h2, first."""
    spark = docs.sparkSession
    lines = _lines(docs, id_col, text_col, site_col)
    margin = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    est = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("id", "pos")).alias("first"))
    est = est.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    est = Scratch(spark).write("spread", est)  # the lines of many sites alone: few, and of a size that Spark then knows
    near = est.filter(F.col("sites") <= min_sites + margin)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= min_sites)
    return est.filter(F.col("sites") > min_sites + margin).drop("sites").unionByName(near.join(exact, ["h1", "h2"], "left_semi").drop("sites"))


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The columns of docs with text cleaned, then n_removed (int)."""
    flagged = Scratch(docs.sparkSession).write("flagged", spread_lines(docs, id_col, text_col, site_col, min_sites, lg_k))
    lines = _lines(docs, id_col, text_col, site_col).join(flagged, ["h1", "h2"])
    lines = lines.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
    drops = lines.groupBy(F.col("id").alias("_i"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("_drop"))  # no more than a document's lines
    out = pack(docs).withColumn("_h", F.xxhash64(F.col(f"_row.`{text_col}`")))
    out = out.join(drops, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left")
    text = F.col(f"_row.`{text_col}`")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    return unpack(out, {text_col: F.when(F.col("_drop").isNull(), text).otherwise(kept)}, {"n_removed": F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("int")})


def op3_line_spread(spark, sf_dir):
    return remove_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


SQL = f"""
with lines as (select doc_id, source, generate_subscripts(ls, 1) pos, unnest(ls) raw from (select doc_id, source, string_split(text, chr(10)) ls from documents)),
keyed as (select *, trim(raw, ' ' || chr(9) || chr(13)) line from lines),
spread as (select line, count(distinct coalesce(source, chr(0))) n, min((doc_id, pos)) f from keyed where line <> '' group by line having n >= {MIN_SITES}),
marked as (select k.doc_id, k.pos, k.raw, s.line is not null and (k.doc_id, k.pos) <> s.f gone from keyed k left join spread s on k.line = s.line),
kept as (select doc_id, coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') t, sum(gone::int)::int n from marked group by doc_id)
select d.doc_id, d.source, d.lang, case when d.text is null then null else k.t end as text, coalesce(k.n, 0)::integer n_removed
from documents d left join kept k on d.doc_id = k.doc_id
"""
