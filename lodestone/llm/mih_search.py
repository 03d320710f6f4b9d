"""Operator 10: approximate nearest neighbours by multi-index hashing.

Codes are learned: vectors are centred, and iterative quantisation finds the rotation whose signs lose least
(fitted on a bounded sample, FIT rows). A code of BITS bits is cut into substrings of 16 bits, and each substring is
indexed by its value. If two codes differ in at most r = m * s + a bits (a < m), then one of the first a + 1 of their m
substrings differs in at most s bits or one of the others in at most s - 1 (pigeonhole), so probing every key so near
retrieves every code within radius r. Those are reranked by the exact
inner product of the original vectors in double precision. The radius is learned too: the least at which CALIBRATE
sampled queries find RECALL of their true neighbours in the sample; a query that finds fewer than k goes on with a
larger radius until it has k or has seen all.

The index is cut into blocks of a bounded number of rows, dealt by a hash of id and vector, so a vector that a third of all
rows share makes no large bucket for one task. The queries alone are copied, one to each block (a stated query set against
all rows); a task indexes a block and streams the queries past it. The best k of the blocks are merged, FAN blocks at a time.

Vectors near a uniform distribution have neighbours hardly nearer than the rest: there the learned radius covers a
large part of all codes. Measured recall and the share of rows that are reranked are in the README.

Defined cases: vectors null, empty, zero, holding null or non-finite components, or of another length than the most
frequent one take no part, as queries or rows; a null id takes no part; repeated rows are rows of their own (one of the
query's id is not its neighbour), but each distinct (id, vector) is asked once: different vectors of one query id have a
list each, ranked from 1; ties go to the smaller id; with fewer than k others all are returned; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, first_by_hash, partitions, ship, table

K, QUERY_MOD = 20, 20
BITS, SUB = 64, 16
FIT, CALIBRATE, RECALL = 8192, 256, 0.92
BLOCK_ROWS = 32768
#: Blocks whose lists are merged at a time.
FAN = 64

OUT = "query_id long, rank int, vec_id long, score double"
FOUND = "ask long, query_id long, block int, vec_id long, score double"


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dim, bits) by principal directions and iterative quantisation; for more bits than dimensions, further learned rotations."""
    mean = x.mean(axis=0)
    c = x - mean
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    basis = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    parts = []
    for at in range(0, bits, dim):
        n = min(dim, bits - at)
        v = c @ basis[:, :n]
        r = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(basis[:, :n] @ r)
    return mean, np.concatenate(parts, axis=1)


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as substrings (rows, m) of uint16."""
    on = (x - model[0]) @ model[1] >= 0
    return np.packbits(on, axis=1, bitorder="little").view(np.uint16)


@functools.lru_cache(None)
def flips(radius: int) -> np.ndarray:
    """All 16-bit masks of at most radius bits."""
    m = np.arange(1 << SUB, dtype=np.uint16)
    return m[np.bitwise_count(m) <= radius]


class Index:
    """Rows of one block, each substring indexed by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = codes.copy().view(np.uint64)
        self.order = [np.argsort(codes[:, i], kind="stable") for i in range(codes.shape[1])]
        self.count = [np.bincount(codes[:, i], minlength=1 << SUB).astype(np.int32) for i in range(codes.shape[1])]
        self.start = [(np.cumsum(n) - n).astype(np.int32) for n in self.count]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from code in at most radius bits."""
        m = self.codes.shape[1]
        seen = np.zeros(len(self.codes), bool)
        for i in range(m):
            near = radius // m - (i > radius % m)
            if near < 0:
                continue
            keys = flips(min(near, SUB)) ^ code[i]
            n = self.count[i].take(keys)
            keys = keys[n > 0]
            n, a = n[n > 0], self.start[i].take(keys)
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            seen[self.order[i].take(at)] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.wide[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64) <= radius]


def top(index: Index, ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids found in a block and their scores."""
    r, bits = radius, index.codes.shape[1] * SUB
    while True:
        rows = index.within(code, r)
        rows = rows[ids[rows] != qid]
        if len(rows) >= k or r >= bits:
            break
        r = min(bits, r + 4)
    score = inner(x[rows], q)
    if len(rows) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= cut
        rows, score = rows[keep], score[keep]
    best = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][best], score[best]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in one order whatever the number of rows, so equal vectors have equal scores."""
    return np.einsum("ij,j->i", x, q, optimize=False)


def learn_radius(x: np.ndarray, model: tuple, k: int = K, queries: int = CALIBRATE, recall: float = RECALL) -> int:
    codes = encode(x, model).view(np.uint64)
    need = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(s) - 1))[:k]
        need.append(np.bitwise_count(codes[best] ^ codes[i]).sum(axis=1))
    return int(np.quantile(np.concatenate(need), recall, method="higher"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_mod: int = QUERY_MOD, bits: int = BITS) -> DataFrame:
    """For each distinct (id, vector) whose id is divisible by query_mod its k nearest others: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    v = v.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    dim = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return spark.createDataFrame([], OUT)
    dim = dim["d"]
    v = scratch.write("vectors", v.filter(F.size("v") == dim))
    n = v.count()
    h = F.xxhash64("id", "v")
    keyed = v.select("id", "v", h.alias("h"))
    sample = first_by_hash(keyed, "h", FIT, n, "id", "v").toPandas()["v"]
    if len(sample) < min(FIT, n):  # few distinct rows, too few hashes to cut by; written, so the driver gets no rows of every task
        sample = scratch.write("sample", keyed.orderBy(F.xxhash64("h"), "id", "v").limit(FIT)).toPandas()["v"]
    sample = np.stack(sample.to_list())
    bits = -(-bits // 64) * 64
    model = learn_rotation(sample, bits)
    radius = learn_radius(sample, model, k)

    # an ask is a distinct (id, vector) with a key of its own, by which the blocks' lists are merged
    asks = scratch.write("asks", v.filter(F.col("id") % query_mod == 0).distinct().withColumn("ask", F.monotonically_increasing_id()))
    blocks = math.ceil(n / BLOCK_ROWS)
    rows = v.withColumn("block", F.pmod(h, F.lit(blocks)).cast("int")).withColumn("query", F.lit(False)).withColumn("ask", F.lit(-1).cast("long"))
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(True))

    def search(batches):
        now, held, index = None, [], None
        for batch in batches:
            block, query = (batch[c].to_numpy(zero_copy_only=False) for c in ("block", "query"))
            ids, keys = batch["id"].to_numpy(), batch["ask"].to_numpy()
            vectors = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (query[1:] != query[:-1]), [True]]))
            for a, b in zip(edges[:-1], edges[1:]):  # a block's rows come first, in one batch or more, then all asks
                if not query[a]:
                    if now != block[a]:
                        now, held, index = block[a], [], None
                    held.append((ids[a:b], vectors[a:b]))
                elif now == block[a]:
                    if index is None:
                        of, x = (np.concatenate(c) for c in zip(*held))
                        held, index = [], Index(encode(x, model))
                    codes = encode(vectors[a:b], model)
                    out = [top(index, of, x, ids[a + i], vectors[a + i], codes[i], k, radius) for i in range(b - a)]
                    size = [len(f) for f, _ in out]
                    cols = [np.repeat(keys[a:b], size), np.repeat(ids[a:b], size), np.full(sum(size), now), *(np.concatenate(c) for c in zip(*out))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], [f.split()[0] for f in FOUND.split(", ")])

    names = ("block", "query", "ask", "id", "v")
    both = rows.select(*names).unionByName(asks.select(*names)).repartition(partitions(spark, blocks), "block").sortWithinPartitions("block", "query")
    found = both.mapInArrow(search, FOUND)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    while True:  # FAN lists of k at a time, so what is merged in one place does not grow with the number of blocks
        blocks = math.ceil(blocks / FAN)
        merged = found.withColumn("block", (F.col("block") / FAN).cast("int")).groupBy("ask", "query_id", "block").agg(best.alias("b"))
        if blocks == 1:
            break
        found = merged.select("ask", "query_id", "block", F.explode("b").alias("x")).select("ask", "query_id", "block", "x.vec_id", (-F.col("x.s")).alias("score"))
    return merged.select("query_id", F.posexplode("b").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def op10_mih_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
