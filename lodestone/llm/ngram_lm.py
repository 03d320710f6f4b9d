"""Operator 1: language model scoring by deleted interpolation.

P(w | v) = a_b * c(v, w) / c(v) + b_b * c(w) / N + c_b / (V + 1), where b is the bucket of the context's
frequency c(v): 0, or 1 + floor(log2 c(v)). Of the training documents one tenth (DELETED) is held out: with
the counts of the rest, expectation-maximisation on the held-out tokens learns the weights of each bucket.
Then the weights go with the counts of all training documents. A text's first token has the end of a text as
its context; each text ends with one end token. The probabilities of all V known tokens and of one class for
all others sum to 1 in every context.

Counts are exact and distributed: see tokens.py. Only three things reach the driver: N and V, and the held-out
tokens counted by (bucket, bigram ratio, unigram ratio), the ratios on a grid of 1/4 octave, which bounds
their number however large the corpus is.

Defined cases: a null or empty text is one end token; a null id belongs to the fold of the empty text's crc32
(0: held out); repeated rows count and are scored each; with nothing to learn from, every token has the
probability 1 / (V + 1) = 1; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_bytes, fold, partitions, partitions_for, table
from .tokens import END, mix, pack_numbers, pack_sorted, runs, token_blocks, unpack_numbers, unpack_sorted

FOLDS, HELD_OUT = 10, 0
#: The fold among the training documents on which the weights are learned.
DELETED = 9
#: Bytes of text per shard of the counts, in the mean.
SHARD_BYTES = 24 << 20
STEP = 4
ROUNDS = 60

_ASK = "level int, shard int, block long, keys binary, total binary, held binary"
_REPLY = "level int, shard int, block long, total binary, held binary, n_tokens long, n_types long, n_tokens_em long, n_types_em long"


def _open(vocab: bytes, tokens: bytes, lens: np.ndarray):
    """Hashes of the vocabulary, tokens, contexts and each token's document."""
    h = np.frombuffer(vocab, np.uint64)
    t = unpack_numbers(tokens).astype(np.int64)
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[:1] = END  # every text ends with END, so the first token of the next has it before itself
    return h, t, before, np.repeat(np.arange(len(lens)), lens)


def _keys(h, t, before):
    """Per level: distinct hashes, ascending, and for each token the place of its hash."""
    order = np.argsort(h)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    pairs, inverse = np.unique(before * len(h) + t, return_inverse=True)
    ph = mix(h[pairs // len(h)], h[pairs % len(h)])
    po = np.argsort(ph)
    pplace = np.empty_like(po)
    pplace[po] = np.arange(len(po))
    return (h[order], place), (ph[po], pplace[inverse])


def _lens(batch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _asks(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lens, marks = _lens(row, "lens"), _lens(row, "marks")
                h, t, before, doc = _open(row["vocab"][0].as_py(), row["tokens"][0].as_py(), lens)
                train, held = (marks != HELD_OUT)[doc], (marks == DELETED)[doc]
                out = []
                (k1, p1), (k2, p2) = _keys(h, t, before)
                for level, keys, at in ((1, k1, p1[t]), (2, k2, p2)):
                    total = np.bincount(at[train], minlength=len(keys))
                    out_held = np.bincount(at[held], minlength=len(keys))
                    for s, a, b in runs(keys, shards):
                        out.append((level, s, row["block"][0].as_py(), pack_sorted(keys[a:b]), pack_numbers(total[a:b]), pack_numbers(out_held[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], [f.split()[0] for f in _ASK.split(", ")])

    return blocks.mapInArrow(run, _ASK)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a shard's counts, sent back to each block in the order of its keys."""
    keys = [unpack_sorted(b) for b in pdf["keys"]]
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(at, np.concatenate([unpack_numbers(b) for b in pdf["total"]])).astype(np.int64)
    held = np.bincount(at, np.concatenate([unpack_numbers(b) for b in pdf["held"]])).astype(np.int64)
    first = pdf["level"].iloc[0] == 1
    sums = [int(total.sum()), int((total > 0).sum()), int((total - held).sum()), int((total > held).sum())] if first else [0] * 4
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rows = []
    for i, (level, shard, block) in enumerate(zip(pdf["level"], pdf["shard"], pdf["block"])):
        mine = at[edges[i] : edges[i + 1]]
        rows.append((level, shard, block, pack_numbers(total[mine]), pack_numbers(held[mine]), *(sums if i == 0 else [0] * 4)))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _REPLY.split(", ")])


def _with_counts(row):
    """From a joined row: documents, tokens, and for each token c(w), c(v), c(v, w), of all training documents and of the held-out part."""
    lens, marks = _lens(row, "lens"), _lens(row, "marks")
    h, t, before, doc = _open(row["vocab"][0].as_py(), row["tokens"][0].as_py(), lens)
    (_, p1), (_, p2) = _keys(h, t, before)
    replies = sorted((r for r in row["replies"][0].as_py()), key=lambda r: (r["level"], r["shard"]))
    got = {}
    for level in (1, 2):
        for name in ("total", "held"):
            got[level, name] = np.concatenate([unpack_numbers(r[name]) for r in replies if r["level"] == level])
    c1 = {k: got[1, k][p1] for k in ("total", "held")}
    return marks, doc, t, {k: (c1[k][t], c1[k][before], got[2, k][p2]) for k in ("total", "held")}


def bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)


def learn_weights(events: pd.DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per bucket by EM; the last row is for buckets without events.

    events: bucket, q2, q1 (log2 of the bigram's and unigram's probability over the uniform one, in 1/STEP; -1: zero), n.
    Each component has half an event in advance, so no weight is 0 but the bigram's in bucket 0, where there is none.
    """
    ratio = lambda q: np.where(q >= 0, 2.0 ** ((q - _ZERO) / STEP), 0.0)
    buckets = 66
    b = events["bucket"].to_numpy(np.int64)
    p = np.stack([ratio(events["q2"].to_numpy(np.float64)), ratio(events["q1"].to_numpy(np.float64)), np.ones(len(b))], axis=1)
    n = events["n"].to_numpy(np.float64)
    b, p, n = np.concatenate([b, np.full(len(b), buckets)]), np.concatenate([p, p]), np.concatenate([n, n])
    w = np.full((buckets + 1, 3), 1 / 3)
    seen = np.bincount(b, n, buckets + 1)
    for _ in range(rounds):
        part = p * w[b]
        part *= (n / part.sum(axis=1))[:, None]
        w = np.stack([np.bincount(b, part[:, k], buckets + 1) for k in range(3)], axis=1) + 0.5
        w /= w.sum(axis=1, keepdims=True)
    w[seen == 0] = w[buckets]
    w[0] = [0.0, *(w[0, 1:] / w[0, 1:].sum())]
    return w


#: Added to the logarithms on the grid, so that they are not negative.
_ZERO = 64 * STEP


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with batch_bytes(docs.sparkSession, 16 << 20):  # blocks are large rows
        return _score_corpus(docs, id_col, text_col)


def _score_corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    blocks = scratch.write("blocks", token_blocks(docs, id_col, text_col, fold(f"`{id_col}`", FOLDS)))
    size, whole = (x or 0 for x in blocks.agg(F.sum(F.length("tokens")), F.sum(F.length("tokens") + F.length("vocab"))).first())
    shards = max(partitions(spark), math.ceil(3 * size / SHARD_BYTES))  # a byte of packed tokens is about 3 of text
    replies = scratch.write("replies", _asks(blocks, shards).groupBy("level", "shard").applyInPandas(_count, _REPLY))
    n, v, n_em, v_em = (x or 0 for x in replies.agg(*[F.sum(c) for c in ("n_tokens", "n_types", "n_tokens_em", "n_types_em")]).first())
    parts = partitions_for(spark, 2 * whole)  # a block and what comes back for it
    by_block = replies.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("level", "shard", "total", "held")).alias("replies"))  # no more than the block asked for
    joined = blocks.repartition(parts, "block").join(by_block, "block")

    def heldout(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                marks, doc, _, c = _with_counts(row)
                pick = (marks == DELETED)[doc]
                cw, cv, cvw = (x[pick].astype(np.int64) - y[pick] for x, y in zip(c["total"], c["held"]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    q2 = np.where(cvw > 0, np.rint(STEP * np.log2(cvw / cv * (v_em + 1))) + _ZERO, -1).astype(np.int64)
                    q1 = np.where(cw > 0, np.rint(STEP * np.log2(cw / max(n_em, 1) * (v_em + 1))) + _ZERO, -1).astype(np.int64)
                rows, counts = np.unique(np.stack([bucket(cv), q2, q1], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(counts)], ["bucket", "q2", "q1", "n"])

    events = joined.mapInArrow(heldout, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"))
    weights = learn_weights(events.toPandas())

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                marks, doc, t, c = _with_counts(row)
                cw, cv, cvw = (x.astype(np.float64) for x in c["total"])
                w = weights[bucket(cv)]
                p = w[:, 0] * (cvw / np.maximum(cv, 1)) + w[:, 1] * (cw / max(n, 1)) + w[:, 2] / (v + 1)
                docs_ = len(marks)
                sums = [np.bincount(doc, x, docs_) for x in (np.log10((cw + 0.1) / (n + 0.1 * (v + 1))), np.log10(p))]
                count = np.bincount(doc, minlength=docs_)
                known = np.bincount(doc, cw > 0, docs_).astype(np.int64)
                ids = row["ids"].flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(marks == HELD_OUT), pa.array(count.astype(np.int64)), pa.array(known), pa.array(np.full(docs_, n, np.int64)), *(pa.array(s) for s in sums)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scores = joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    scores = scratch.write("scores", scores)  # while the batches are small
    for name in ("blocks", "replies"):
        scratch.drop(name)
    return scores


def op1_ngram_lm(spark, sf_dir):
    return score_corpus(table(spark, sf_dir, "documents"))
