"""Whole queries 4, 7 and 9 over the given documents, against plain Python that shares no code with the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import packing, secret_scan, webp_media

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- 4


def plain_pack(pieces, capacity):
    """Bins of (n_tokens, source, slot, cluster) in order: the fullest that has room and no conflict, the oldest of equals, or a new one."""
    bins, out = [], []
    for n, *source, cluster in pieces:
        source = tuple(source)
        fit = [(room - n, k) for k, (room, sources, clusters) in enumerate(bins) if room >= n and source not in sources and cluster not in clusters]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((capacity, set(), set()))
        room, sources, clusters = bins[k]
        bins[k] = (room - n, sources | {source}, clusters | {cluster})
        out.append(k)
    return out


@pytest.mark.parametrize("capacity, size", [(packing.CAPACITY, packing.SHARD), (300, 60)])
def test_packing_query(spark, rows, capacity, size):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    seen, pieces = Counter(), []
    for r in rows:
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w])
        if not n:
            continue
        key = (r.doc_id, r.source, lower(r.text))
        seen[key] += 1
        pieces += [(r.doc_id, r.source, lower(r.text), seen[key], k, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
    df = spark.createDataFrame(pieces, "doc_id long, source string, text string, copy int, piece int, n_tokens int")
    slot = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "source", F.xxhash64("text"), "copy", "piece"), F.lit(packing.SLOTS))
    shards = max(1, math.ceil(len(pieces) / size))
    tie = F.xxhash64("doc_id", "copy", "piece")
    by = defaultdict(list)
    for p in df.withColumn("tie", tie).withColumn("slot", slot).withColumn("shard", F.pmod(tie, F.lit(shards))).collect():
        by[p.shard].append(p)
    want = []
    for shard, ps in by.items():
        ps.sort(key=lambda p: (-p.n_tokens, p.tie, p.doc_id, p.copy, p.piece))
        bins = plain_pack([(p.n_tokens, p.source, p.slot, p.text) for p in ps], capacity)
        pos = Counter()
        for p, b in zip(ps, bins):
            want.append((shard, b, pos[b], p.doc_id, p.copy, p.piece, p.piece * capacity, p.n_tokens, p.source))
            pos[b] += 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.op4_best_fit_packing(spark, SF) if capacity == packing.CAPACITY else packing.best_fit(docs, capacity=capacity, shard_size=size)
    same([tuple(r) for r in out.collect()], want)


# ---- 7


def test_media_query_over_documents(spark, rows):
    out = webp_media.op7_webp_media(spark, SF).collect()
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out], want)
    files = {r.doc_id: bytes(r.media) for r in webp_media.store_texts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    same([(r.doc_id, r.media_bytes, r.media_sha256) for r in out], [(i, len(m), hashlib.sha256(m).hexdigest()) for i, m in files.items()])
    assert {"literals", "copies"} <= {r.coding.split("=")[0] for r in out}


# ---- 9


def plain_secrets(text):
    base = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        base += [(m.start(), 0, m.end(), m[2])] * (len(m[2]) >= 6)
    for k, (p, n) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        base += [(m.start(), k, m.end(), m[0]) for m in re.finditer(p, text) if len(m[0]) >= n]
    covered = {x for s, _, e, _ in base for x in range(s, e)}
    rest = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20]
    return base + [t for t in rest if re.search("[0-9]", t[3]) and re.search("[A-Za-z]", t[3]) and not covered & set(range(t[0], t[2]))]


def test_secret_query_over_documents(spark, tmp_path):
    """The given documents (the smallest hold no secret) and some with the kinds and spreads that they lack."""
    wide, own, dull = "Ax7Lm2Qp9Rt4Vw8Zb3Nc", "Zq8vX2mK9rT4wB7nC1yD", "a1" * 15
    key = "AKIA" + "Q7R2M9X4" * 2
    extra = [(f"see {wide}, {key} é", f"s{k}") for k in range(4)] + [(f"🙂 {own} {dull}", "s0"), (f"{own} {key}", "s1"), (f"token='{own}'{own}", "s1"), (f"{key} x{'0f' * 12}", None), (None, "s2"), ("", "s2")]
    extra = spark.createDataFrame([(10**6 + k, t, None, s, 0) for k, (t, s) in enumerate(extra)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    kinds = ("assign", "access", "hex", "generic")
    found = [(r, plain_secrets(r.text or "")) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    owners = defaultdict(set)
    for r, spans in found:
        for s in spans:
            owners[s[3]].add(r.source)

    def verdict(value):
        if len(owners[value]) >= 3:
            return "example"
        return "live" if sum(-c / len(value) * math.log2(c / len(value)) for c in Counter(value).values()) >= 3 else "plain"

    written = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))
    want = []
    for r, spans in found:
        kept = [s for s in spans if s[1] < 3 or verdict(s[3]) == "live"]
        n = [sum(s[1] == k for s in kept) for k in range(3)]
        base = hashlib.sha256(written([s for s in kept if s[1] < 3]).encode()).hexdigest()
        verdicts = Counter(verdict(s[3]) for s in kept)
        want.append((r.doc_id, *n, base, written(kept), verdicts["live"], verdicts["example"]))
    assert {k.split(":")[0] for w in want for k in w[5].split(",")} >= set(kinds)
    same([tuple(r) for r in secret_scan.op9_secret_scan(spark, str(tmp_path)).collect()], want)
