"""Operators 1, 2, 3, 4, 8 and the pipeline, against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import jaccard_join, line_spread, ngram_lm, packing, poisson_mix, tokens
from lodestone.llm.common import Scratch
from lodestone.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string, copy string"


def docs(spark, *rows):
    """(id, text, source) rows, with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "one two three four five six", "b"), (6, "x " * 30_000, "c"), (7, "one two three four five six", None)]


# ---- packed numbers


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(1, 9))
def test_packing_of_numbers(values, shards):
    a = np.array(sorted(set(values)), np.uint64)
    assert (tokens.unpack_sorted(tokens.pack_sorted(a)) == a).all()
    b = (a & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    assert (tokens.unpack_numbers(tokens.pack_numbers(b)) == b).all()
    edges = tokens.cut(a, shards)
    assert edges[0] == 0 and edges[-1] == len(a) and (np.diff(edges) >= 0).all()
    for s in range(shards):
        for x in a[edges[s] : edges[s + 1]]:
            assert (s << 64) // shards <= int(x) < ((s + 1) << 64) // shards + 1


# ---- 1


def brute_lm(rows):
    toks = {k: (t or "").encode().lower().split() + [None] for k, (_, t, _) in enumerate(rows)}
    f = {k: zlib.crc32(b"" if i is None else str(i).encode()) % 10 for k, (i, _, _) in enumerate(rows)}

    def count(keep):
        uni, bi = Counter(), Counter()
        for k, ts in toks.items():
            if keep(f[k]):
                uni.update(ts)
                bi.update(zip([None, *ts[:-1]], ts))
        return uni, bi

    uni, bi = count(lambda x: x != 0)
    n, v = sum(uni.values()), len(uni)
    u2, b2 = count(lambda x: x not in (0, ngram_lm.DELETED))
    n2, v2 = sum(u2.values()), len(u2)
    ev = Counter()
    for k, ts in toks.items():
        if f[k] == ngram_lm.DELETED:
            for h, w in zip([None, *ts[:-1]], ts):
                q = [round(ngram_lm.STEP * math.log2(p * (v2 + 1))) + ngram_lm._ZERO if p > 0 else -1 for p in (b2[h, w] / u2[h] if u2[h] else 0, u2[w] / n2 if n2 else 0)]
                ev[(int(ngram_lm.bucket(np.array([u2[h]]))[0]), *q)] += 1
    weights = ngram_lm.learn_weights(pd.DataFrame([(*k, c) for k, c in ev.items()], columns=["bucket", "q2", "q1", "n"]))

    def p(h, w):
        a = weights[int(ngram_lm.bucket(np.array([uni[h]]))[0])]
        return a[0] * (bi[h, w] / uni[h] if uni[h] else 0) + a[1] * uni[w] / max(n, 1) + a[2] / (v + 1)

    out = []
    for k, (i, _, _) in enumerate(rows):
        ts = toks[k]
        out.append((i, f[k] == 0, len(ts), sum(uni[t] > 0 for t in ts), n, sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), sum(math.log10(p(h, w)) for h, w in zip([None, *ts[:-1]], ts))))
    return out, p, uni


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-6 * max(1, abs(x[5])) and abs(x[6] - y[6]) < 1e-6 * max(1, abs(x[6])) for x, y in zip(sorted(a, key=repr), sorted(b, key=repr)))


@pytest.mark.parametrize("which", ["tables", "odd", "one"])
def test_ngram_lm(spark, which):
    rows = {"tables": [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], "odd": ODD, "one": [(0, "a b", "")]}[which]
    got = [tuple(r) for r in ngram_lm.score_corpus(docs(spark, *rows)).collect()]
    want, p, uni = brute_lm(rows)
    assert close(got, want)
    if which == "tables":
        for h in [None, *list(uni)[:5]]:  # known tokens and one unknown
            assert abs(sum(p(h, w) for w in uni) + p(h, "no such token") - 1) < 1e-9
        held = [x for x in got if x[1]]
        assert sum(x[6] for x in held) > sum(x[5] for x in held)


def test_ngram_lm_empty(spark):
    assert ngram_lm.score_corpus(docs(spark).limit(0)).collect() == []


# ---- 2


def test_poisson_mix(spark):
    rows = ODD + [(100 + k, f"t {k}", "a" if k % 3 else "z") for k in range(200)]
    d = docs(spark, *rows)
    weights = {"a": 1.0, "z": 2.0, None: 0.5, "nobody": 9.0}
    out = poisson_mix.mix(d, weights=weights, budget=2.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "n_copies", "copy", "shuffle_key"][:5] + ["rate", "n_copies", "copy", "shuffle_key"]
    n = Counter(s for _, _, s in rows)
    present = {s: w for s, w in weights.items() if n[s]}
    want = Counter()
    for i, _, s in rows:
        if s not in present:
            continue
        rate = present[s] / sum(present.values()) * len(rows) * 2 / n[s]
        u = int(hashlib.md5(f"{poisson_mix.SEED}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while u >= c:
            k += 1
            p *= rate / k
            c += p
        want[(i, s)] += k
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want
    copies = out.groupBy("doc_id", "source", "copy").count().filter("doc_id >= 100 and count > 1")
    assert copies.isEmpty() and out.filter("rate is null or shuffle_key is null").isEmpty()
    assert poisson_mix.mix(d.limit(0)).count() == 0


def test_poisson_rates_of_large_values(spark):
    d = docs(spark, (1, "a", "rare"), *[(k, "b", "common") for k in range(2, 2002)])
    rate = {r.source: r for r in poisson_mix.rates(d, weights={"rare": 1.0, "common": 1.0}).collect()}["rare"]
    assert rate.rate == pytest.approx(1000.5) and rate.cdf[-1] == pytest.approx(1, abs=1e-9)
    assert abs(poisson_mix.mix(d, weights={"rare": 1.0, "common": 1.0}).filter("source = 'rare'").count() - 1000) < 150


# ---- 3


def brute_lines(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            key = line.strip(line_spread.TRIM)
            if key:
                sites.setdefault(key, set()).add(s)
                at = (i is not None, i or 0, pos)
                first[key] = min(first.get(key, at), at)
    out = []
    for i, t, s in rows:
        kept, gone = [], 0
        for pos, line in enumerate((t or "").split("\n")):
            key = line.strip(line_spread.TRIM)
            if key and len(sites[key]) >= min_sites and first[key] != (i is not None, i or 0, pos):
                gone += 1
            else:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept), gone))
    return out


@pytest.mark.parametrize("lg_k", [4, 12])
def test_line_spread(spark, lg_k):
    rows = [(k, f"own {k}\n  shared {k % 4} \nfoot\n\n", f"s{k % 23}") for k in range(120)] + ODD + [(None, "foot\nfoot", None), (500, "foot\r\nfoot", "q")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_spread.remove_spread_lines(docs(spark, *rows), min_sites=20, lg_k=lg_k).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows, 20), key=repr)
    assert line_spread.remove_spread_lines(docs(spark, *rows).limit(0)).count() == 0


# ---- 4


def brute_pack(length, source, cluster, capacity):
    bins, out = [], []
    for n, s, c in zip(length, source, cluster):
        fits = [(free, b) for b, (free, ss, cc) in enumerate(bins) if free >= n and s not in ss and (c < 0 or c not in cc)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append((capacity, set(), set()))
        free, ss, cc = bins[b]
        bins[b] = (free - n, ss | {s}, cc | {c})
        out.append(b)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 70), st.integers(-1, 80)), max_size=120))
def test_best_fit_equals_search_of_all_bins(pieces):
    pieces.sort(key=lambda p: -p[0])
    a = np.array(pieces, np.int64).reshape(-1, 3)
    assert packing.pack_shard(a[:, 0], a[:, 1], a[:, 2], 20).tolist() == brute_pack(*a.T.tolist() if len(a) else ([], [], []), 20)


def test_best_fit(spark):
    rows = ODD + [(k, " ".join(["w"] * (k % 50 + 1)), f"s{k % 3}") for k in range(100, 400)]
    out = packing.best_fit(docs(spark, *rows), capacity=64, shard_size=100).toPandas()
    want = Counter()
    for i, t, _ in rows:
        want[i if i is not None else -1] += len((t or "").split())
    got = out.assign(doc_id=out.doc_id.fillna(-1)).groupby("doc_id").n_tokens.sum().to_dict()
    assert got == {float(k): v for k, v in want.items() if v}
    assert (out.groupby(["shard", "bin"]).n_tokens.sum() <= 64).all()
    text = {i: t for i, t, _ in rows}
    out["cluster"] = [hash((text[None if pd.isna(i) else int(i)] or "").lower()) for i in out.doc_id]
    assert not out.duplicated(["shard", "bin", "cluster"]).any()
    assert (out.groupby(["shard", "bin", "source"], dropna=False).size() <= packing.SLOTS).all()
    assert packing.best_fit(docs(spark, *rows).limit(0)).count() == 0


@pytest.mark.parametrize("shards", range(1, 9))
def test_best_fit_reaches_all_slots_of_a_source(spark, shards):
    rows = [(k, f"w{k}", "s") for k in range(shards * 100)]  # pieces of one token, no two alike
    out = packing.best_fit(docs(spark, *rows), capacity=64, shard_size=100).toPandas()
    assert out.shard.nunique() == shards and len(out) == len(rows)
    assert (out.groupby(["shard", "bin"]).size().groupby("shard").max() == packing.SLOTS).all()


# ---- 8


def brute_jaccard(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _, _) in enumerate(rows)), key=repr)


def near(spark, rows):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, *rows)).collect()), key=repr)


def test_jaccard_join_tables(spark):
    rows = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near(spark, rows) == brute_jaccard(rows)


def test_jaccard_join_odd(spark):
    r = np.random.default_rng(1)
    word = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choice(word, 60)) for _ in range(4)]
    rows = list(ODD)
    for k in range(90):  # chains: each differs a little from the one before, so ends of a group don't link
        t = (rows[-4][1] if k % 10 else base[k % 4]).split()
        for _ in range(k % 3):
            t[int(r.integers(len(t)))] = str(r.choice(word))
        rows.append((1000 + int(r.permutation(1000)[k]) * 3, " ".join(t), ""))
    common = " ".join(word[:40])  # a passage in many documents that are otherwise different
    rows += [(9000 + k, common + " " + " ".join(r.choice(word, int(r.integers(3, 40)))), "") for k in range(40)]
    assert near(spark, rows) == brute_jaccard(rows)
    assert jaccard_join.jaccard_components(docs(spark, *rows).limit(0)).count() == 0


def test_jaccard_join_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    passage = [" ".join(f"p{k}w{x}" for x in r.permutation(40)) for k in range(6)]
    rows = [(10 * a + b, f"{passage[a]} {passage[b]}", "") for a in range(6) for b in range(a)]  # a passage has five texts, none of which link
    seen, was = [], jaccard_join._Join.candidates_in

    def candidates_in(self, blocks, every):
        seen.append(blocks.select("key", "band", "i", "j", "asks").toPandas())
        return was(self, blocks, every)

    monkeypatch.setattr(jaccard_join._Join, "candidates_in", candidates_in)
    assert near(spark, rows) == brute_jaccard(rows)
    assert len(seen) == 2
    for blocks in seen:
        assert 6 <= blocks["key"].nunique() <= 6 * 4  # of the keys that the same texts have, one; a key has two to five
        assert (blocks.groupby(["key", "band", "i", "j"])["asks"].nunique() == 2).all()  # all texts are of one size: nothing goes to other bands


def test_components(spark):
    s = Scratch(spark)
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 300), (7, 7), (500, 100)]
    got = {r.node: r.label for r in components(s, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: got[k] for k in range(1, 41)} == dict.fromkeys(range(1, 41), got[1])
    assert len({got[k] for k in (100, 200, 300, 500)}) == 1 and got[100] != got[1]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_bounds(x, y, shared):
    a, b = (np.array(sorted(s | shared), np.uint64) for s in (x, y))
    both = len((x | shared) & (y | shared))
    ka, kb = jaccard_join.unpack48(jaccard_join.pack48(a)), jaccard_join.unpack48(jaccard_join.pack48(b))
    if len({v >> 16 for v in x | y | shared}) == len(x | y | shared):
        assert jaccard_join.overlap(ka, kb) == both
    if len(a) and len(b):
        wide = np.concatenate([b, np.arange(1000, dtype=np.uint64)])  # a wider bitmap than a's
        for other in (b, np.unique(wide)):
            sigs = jaccard_join.signatures([jaccard_join.signature(a), jaccard_join.signature(other)])
            assert len(set(a.tolist()) & set(other.tolist())) <= jaccard_join.most(len(a), sigs[0], np.array([len(other)]), sigs[1:])[0]


# ---- SQL, pipeline


@pytest.mark.parametrize("module, query", [(poisson_mix, poisson_mix.op2_poisson_mix), (line_spread, line_spread.op3_line_spread)])
def test_sql(spark, module, query):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got, want = query(spark, SF).toPandas(), con.sql(module.SQL).df()
    key = ["doc_id"] + (["copy"] if "copy" in got else [])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pd.testing.assert_frame_equal(got[cols].sort_values(key, ignore_index=True), want[cols].sort_values(key, ignore_index=True), check_dtype=False)


def test_pipeline_stages(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, (9001, None, "src0"), (9002, "12 34", "src0"), (9003, "", "src1")).select(*corpus_pipeline.COLUMNS)
    d = d.unionByName(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        was, d = d, spark.read.parquet(path)
        kept[name] = {r[0] for r in d.select("doc_id").collect()}
        if name != "pack_documents":
            assert d.columns == corpus_pipeline.COLUMNS
        rows = [(r.doc_id, r.text, r.source) for r in was.collect()]
        if name == "language_id":
            assert {i for i, _, _ in rows} - kept[name] >= {9001, 9002, 9003} and len(kept[name]) > 190
        elif name == "line_dedup":
            want = {(i, t) for i, t, n in brute_lines(rows, line_spread.MIN_SITES) if not n or t.strip()}
            assert {(r.doc_id, r.text) for r in d.collect()} == want
        elif name == "near_duplicates":
            assert kept[name] == {i for i, _, c in brute_jaccard(rows) if i == c}
        elif name == "pack_documents":
            assert d.groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n")).filter(f"n > {packing.CAPACITY}").isEmpty()
            assert d.agg(F.sum("n_tokens")).first()[0] == sum(len((t or "").split()) for _, t, _ in rows)
