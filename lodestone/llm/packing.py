"""Operator 4: conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A document longer than a bin is cut into full bins and a rest. Rows are dealt by hash into shards of a bounded
number of pieces (identical rows are counted first and numbered, so no id can fill a shard alone); a shard is
packed in one task, longest piece first. The open bins stand ordered by their residual; a bin carries a bitmap
of its source slots and one of its duplicate clusters. For a piece, the search starts at the smallest residual
that holds it and goes on to the successor until a bin has none of the piece's bits: the tightest compatible
bin. If there is none, a new bin opens. Bitmaps are exact: each (source, slot) and each cluster that occurs
twice in a shard has a bit of its own.

Two pieces of one duplicate cluster (equal texts, after lower-casing A-Z) never share a bin, nor do two pieces
of one (source, slot); SLOTS slots let a bin hold up to so many pieces of one source. The slot is dealt by a hash
of its own, not by the shard's, so every shard has all slots whatever the number of shards.

Defined cases: a null or empty text has no tokens and no piece; a null source is a source; a null id stays
null; repeated rows get copy numbers and conflict with each other; an empty table gives an empty result; extra
columns are ignored; ties go by longer piece, then hash, id, copy and piece number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ship, table

CAPACITY = 2048
#: Pieces per shard, in the mean.
SHARD = 6000
SLOTS = 4
#: Copies of one row that are numbered in one go.
COPIES = 1000

OUT = "shard long, bin long, pos int, doc_id long, copy int, piece int, start long, n_tokens int, source string"


def pack_shard(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; pieces come in the order in which they are to be placed. source, cluster: int codes; cluster -1: no conflict."""
    n = len(length)
    smask = np.zeros((int(source.max(initial=0)) // 64 + 1, n), np.uint64)
    cmask = np.zeros((int(cluster.max(initial=0)) // 64 + 1, n), np.uint64)
    residual, order = np.empty(n, np.int64), np.empty(n, np.int64)  # of open bins, by residual, then bin
    free = np.empty(n, np.int64)
    out, bins, open_ = np.empty(n, np.int64), 0, 0
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in range(n):
        need = int(length[i])
        sw, sb = smask[source[i] >> 6], bit[source[i] & 63]
        c = cluster[i]
        at, lo, step = -1, int(np.searchsorted(residual[:open_], need)), 32
        while lo < open_:
            cand = order[lo : min(open_, lo + step)]
            clash = sw[cand] & sb
            if c >= 0:
                clash |= cmask[c >> 6][cand] & bit[c & 63]
            ok = clash == 0
            first = int(ok.argmax())
            if ok[first]:
                at = lo + first
                break
            lo, step = lo + step, step * 4
        if at >= 0:
            b = int(order[at])
            residual[at : open_ - 1] = residual[at + 1 : open_]
            order[at : open_ - 1] = order[at + 1 : open_]
            open_ -= 1
        else:
            b, bins = bins, bins + 1
            free[b] = capacity
        out[i] = b
        free[b] -= need
        sw[b] |= sb
        if c >= 0:
            cmask[c >> 6][b] |= bit[c & 63]
        if free[b] > 0:
            r = int(free[b])
            to = int(np.searchsorted(residual[:open_], r))
            while to < open_ and residual[to] == r and order[to] < b:
                to += 1
            residual[to + 1 : open_ + 1] = residual[to:open_].copy()
            order[to + 1 : open_ + 1] = order[to:open_].copy()
            residual[to], order[to] = r, b
            open_ += 1
    return out


def _codes(*cols) -> np.ndarray:
    return pd.MultiIndex.from_arrays(cols).factorize()[0] if len(cols) > 1 else pd.factorize(cols[0], use_na_sentinel=False)[0]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, slots: int = SLOTS, shard_size: int = SHARD) -> DataFrame:
    """A row per piece: shard, bin (unique with shard), pos in the bin, doc_id, copy, piece, start (token), n_tokens, source."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(f"`{text_col}`")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(lower).alias("cluster"), F.regexp_count(text, F.lit(WORD)).alias("tokens"))
    rows = rows.filter("tokens > 0").groupBy("doc_id", "source", "cluster", "tokens").agg(F.count(F.lit(1)).alias("m"))
    rows = Scratch(spark).write("rows", rows)  # small: no texts
    pieces = rows.agg(F.sum(F.col("m") * F.ceil(F.col("tokens") / capacity))).first()[0] or 0
    shards = max(1, math.ceil(pieces / shard_size))
    # a row that occurs often is numbered in runs of COPIES, which many tasks share
    often = rows.filter(f"m > {COPIES}").withColumn("run", F.explode(F.expr(f"sequence(0L, (m - 1) div {COPIES})"))).repartition("doc_id", "source", "cluster", "tokens", "run")
    often = often.withColumn("copy", F.explode(F.expr(f"sequence(int(run * {COPIES} + 1), int(least(m, (run + 1) * {COPIES})))"))).drop("run")
    rows = rows.filter(f"m <= {COPIES}").withColumn("copy", F.explode(F.expr("sequence(1, int(m))"))).unionByName(often)
    rows = rows.withColumn("piece", F.explode(F.expr(f"sequence(0, int((tokens - 1) div {capacity}))")))
    rows = rows.withColumn("start", F.col("piece").cast("long") * capacity)
    rows = rows.withColumn("n_tokens", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("int"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "copy", "piece")).withColumn("shard", F.pmod("tie", F.lit(shards)))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "source", "cluster", "copy", "piece"), F.lit(slots)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "tie", "doc_id", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        source = _codes(pdf["source"].astype(object).where(pdf["source"].notna(), "\0"), pdf["slot"].to_numpy())
        twice = pdf["cluster"].duplicated(keep=False).to_numpy()
        cluster = np.full(len(pdf), -1)
        if twice.any():
            cluster[twice] = _codes(pdf["cluster"].to_numpy()[twice])
        pdf["bin"] = pack_shard(pdf["n_tokens"].to_numpy(), source, cluster, capacity)
        pdf["pos"] = pdf.groupby("bin").cumcount().astype("int32")
        return pdf[["shard", "bin", "pos", "doc_id", "copy", "piece", "start", "n_tokens", "source"]]

    keep = rows.select("shard", "doc_id", "copy", "piece", "start", "n_tokens", "source", "cluster", "tie", "slot")
    return keep.groupBy("shard").applyInPandas(pack, OUT)


def op4_best_fit_packing(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"))
