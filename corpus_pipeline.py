"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What a
stage returns is written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, table
from lodestone.llm.crf_langid import UNDETERMINED, identify
from lodestone.llm.jaccard_join import one_of_each
from lodestone.llm.line_spread import remove_spread_lines
from lodestone.llm.packing import best_fit
from lodestone.llm.poisson_mix import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language has a lower score go.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a determined language; a null lang becomes the predicted one."""
    out = identify(docs).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for one place each; documents that had nothing else go with them."""
    out = remove_spread_lines(docs).filter("n_removed = 0 or trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, whatever their ids: see one_of_each. Documents without words stay."""
    return one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's rate, in global random order."""
    return mix(docs).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin."""
    return best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_documents),
]

#: Language ID is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
