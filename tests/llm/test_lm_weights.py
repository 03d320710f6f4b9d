"""Operator 1's mixture weights against expectation-maximisation written out event by event, with probabilities as they are."""

import math
import zlib
from collections import Counter, defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import ngram_lm

SF = "/root/testdata/sf0.001"


def em(events, rounds):
    """Weights of one bucket: events are (p2, p1, p0, n); half an event for each component in advance."""
    w = [1 / 3] * 3
    for _ in range(rounds):
        got = [0.5] * 3
        for *p, n in events:
            whole = sum(a * b for a, b in zip(w, p))
            for k in range(3):
                got[k] += n * w[k] * p[k] / whole
        w = [g / sum(got) for g in got]
    return w


def of_bucket(by, b, rounds):
    events = by.get(b) or [e for es in by.values() for e in es]
    w = em(events, rounds)
    return w if b else [0.0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])]


quarter = st.one_of(st.just(-1), st.integers(ngram_lm._ZERO - 20, ngram_lm._ZERO + 60))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), quarter, quarter, st.integers(1, 50)), min_size=1, max_size=30), st.integers(1, 60))
def test_weights_equal_em_by_event(rows, rounds):
    rows = [(b, q2 if b else -1, q1, n) for b, q2, q1, n in rows]
    got = ngram_lm.learn_weights(pd.DataFrame(rows, columns=["bucket", "q2", "q1", "n"]), rounds)
    by = defaultdict(list)
    for b, q2, q1, n in rows:
        by[b].append((*(2 ** ((q - ngram_lm._ZERO) / ngram_lm.STEP) if q >= 0 else 0.0 for q in (q2, q1)), 1.0, n))
    for b in range(8):
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[b], of_bucket(by, b, rounds)))


def test_grid_costs_little(spark):
    """Scores of the whole table against a model whose weights are learned from exact ratios, not from those on the grid."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10, (r.text or "").encode().lower().split() + [None]) for r in table.collect()]

    def count(keep):
        one, two = Counter(), Counter()
        for _, f, ts in texts:
            if keep(f):
                one.update(ts)
                two.update(zip([None, *ts[:-1]], ts))
        return one, two, sum(one.values()), len(one)

    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    one, two, n, v = count(lambda f: f not in (0, ngram_lm.DELETED))
    by = defaultdict(Counter)
    for _, f, ts in texts:
        if f == ngram_lm.DELETED:
            for h, w in zip([None, *ts[:-1]], ts):
                by[bucket(one[h])][two[h, w] / one[h] if one[h] else 0.0, one[w] / n, 1 / (v + 1)] += 1
    by = {b: [(*p, k) for p, k in c.items()] for b, c in by.items()}
    one, two, n, v = count(lambda f: f != 0)
    weights = {b: of_bucket(by, b, ngram_lm.ROUNDS) for b in {0, *(bucket(c) for c in one.values())}}

    def score(ts):
        total = 0.0
        for h, w in zip([None, *ts[:-1]], ts):
            a = weights[bucket(one[h])]
            total += math.log10(a[0] * (two[h, w] / one[h] if one[h] else 0) + a[1] * one[w] / n + a[2] / (v + 1))
        return total

    want = Counter()
    for i, _, ts in texts:
        want[i] += score(ts)
    got = {r.doc_id: r.score for r in ngram_lm.score_corpus(table).groupBy("doc_id").agg(F.sum("score").alias("score")).collect()}
    assert got.keys() == want.keys()
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 1e-3
    assert max(abs(got[i] / want[i] - 1) for i in got) < 2e-2
