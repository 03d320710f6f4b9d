"""Operator 2: mixing sources to target weights by Poisson replication (native).

Each document of source s is repeated K times, where K is drawn by inverting the Poisson distribution with
the source's target repetition rate at a number in [0, 1) that an md5 of (seed, id) gives. Rates follow from
target weights: rate(s) = weight(s) * budget / documents(s). Copies are then dealt out by another md5, which
is the global shuffle: partitions by hash, rows sorted by it inside. Rows of one id have the same keys, so the hash
that deals them also has the row's place in its input partition, modulo SALTS: no id fills a task alone.

Defined cases: a null source is a source of its own; a null id draws as the empty text; repeated rows draw
alike, and each is repeated; an empty table gives an empty result; weights that name no present source are
ignored, sources without a weight get none and go; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pack, partitions_for, plan_bytes, table, unpack

SEED = "mix-1"
#: Without given weights, a source's weight is its number of documents to this power.
ALPHA = 0.5
#: Parts into which the rows of one id are dealt.
SALTS = 64


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0) -> DataFrame:
    """Per source: documents, repetition rate and the cumulative Poisson distribution of that rate.

    budget: documents asked for, as a multiple of those there are.
    """
    by = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        by = by.withColumn("w", F.pow("n", F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "g string, w double")
        by = by.join(given, F.col("source").eqNullSafe(F.col("g"))).drop("g").filter("w > 0")
    total = by.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    if weights is not None:
        total = total.drop("all_n").crossJoin(docs.agg(F.count(F.lit(1)).cast("double").alias("all_n")))
    by = by.join(F.broadcast(total)).withColumn("rate", F.expr(f"w / all_w * all_n * {float(budget)} / n"))  # one row
    step = "(s, k) -> named_struct('lp', s.lp + ln(rate) - ln(k), 'c', s.c + exp(s.lp + ln(rate) - ln(k)), 'a', concat(s.a, array(s.c + exp(s.lp + ln(rate) - ln(k)))))"
    first = "named_struct('lp', -rate, 'c', exp(-rate), 'a', array(exp(-rate)))"
    return by.select("source", "n", "rate", F.expr(f"aggregate(sequence(1, int(rate + 12 * sqrt(rate) + 20)), {first}, {step}).a").alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """The columns of docs, then rate, n_copies, copy (from 1) and shuffle_key, in shuffled order."""
    spark = docs.sparkSession
    # written, so that Spark knows its size: it is sent to all tasks if it is small, else joined by shuffle
    by = Scratch(spark).write("rates", rates(docs, source_col, weights, alpha, budget)).withColumnRenamed("source", "_s")
    out = pack(docs).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).withColumn("_id", F.coalesce(F.col(f"_row.`{id_col}`").cast("string"), F.lit("")))
    out = out.join(by, F.col(f"_row.`{source_col}`").cast("string").eqNullSafe(F.col("_s")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), "_id")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = out.withColumn("_u", u).withColumn("_k", F.expr("size(filter(cdf, c -> c <= _u))"))
    out = out.filter("_k > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _k)")))
    out = out.withColumn("_key", F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), "_id", F.col("_copy").cast("string"))), 1, 16))
    out = out.repartition(partitions_for(spark, 4 * plan_bytes(docs)), "_key", "_salt").sortWithinPartitions("_key")
    return unpack(out, {}, {"rate": F.col("rate"), "n_copies": F.col("_k").cast("int"), "copy": F.col("_copy").cast("int"), "shuffle_key": F.col("_key")})


def op2_poisson_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).withColumn("rate", F.round("rate", 9))


SQL = f"""
with by_source as (select source, count(*)::double n, pow(count(*)::double, {ALPHA}) w from documents group by 1),
total as (select sum(w) all_w, sum(n) all_n from by_source),
rated as (select source, w / all_w * all_n / n rate from by_source, total),
pmf as (select source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) p
        from rated, lateral (select unnest(range(0, (rate + 12 * sqrt(rate) + 21)::bigint)) k)),
cdf as (select source, rate, k, sum(p) over (partition by source order by k) c from pmf),
arr as (select source, rate, list(c order by k) cs from cdf group by source, rate),
drawn as (select d.doc_id, d.source, d.lang, d.text, rate,
          len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}|' || d.doc_id::varchar), 1, 13))::bigint / {float(1 << 52)})) k
          from documents d join arr a on d.source is not distinct from a.source)
select doc_id, source, lang, text, round(rate, 9) rate, k::integer n_copies, copy::integer copy,
  substr(md5('{SEED}-order|' || doc_id::varchar || '|' || copy::varchar), 1, 16) shuffle_key
from drawn, lateral (select unnest(range(1, k + 1)) copy) where k > 0
"""
