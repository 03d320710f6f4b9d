"""Operator 9: secret scans with corpus-wide ownership frequency.

Every text is scanned once, whole, for three base kinds and for generic high-entropy tokens. The hash of each
candidate's value is aggregated over the corpus by distinct repositories and owners (in steps that combine
map-side, so a value on a third of all rows is no hot spot). A value of EXAMPLE_OWNERS owners or more is a
copied example; a value of fewer owners whose characters look random is owner-specific and live-looking. Base
spans always stay, with that verdict beside them; generic tokens become spans only if they look live.

The documents table has no repository column: here a source is an owner, and its documents of one language
are a repository. Other tables can name their own columns.

Defined cases: a null text counts as empty; a null repository or owner is one of its own; repeated rows and
null ids give a row each; equal starts go in the order of KINDS; an empty table gives an empty result; extra
columns are ignored. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship, table

KINDS = ("assign", "access", "hex", "generic")
EXAMPLE_OWNERS = 3
#: Bits per character from which a value looks random.
LIVE_BITS = 3.0
GENERIC_CHARS = 20

# Patterns of the base kinds and the least lengths of what counts (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")  # the same as runs of 24 or more, without a match per short run
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % GENERIC_CHARS)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) by start, then kind. A generic token overlaps no base span."""
    out = []
    low = text if ":" in text or "=" in text else ""
    for m in ASSIGN.finditer(low):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                out.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end(), m[0]))
    base = sorted(out)
    for m in GENERIC.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


_FOUND = "doc_id long, repo string, owner string, found array<struct<start:long,rank:int,end:long,value:string,random:boolean>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())]))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """A row per document with its candidates; values as md5, never in clear."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                rows.append([{"start": s, "rank": k, "end": e, "value": hashlib.md5(v.encode()).hexdigest(), "random": entropy(v) >= LIVE_BITS} for s, k, e, v in scan(text or "")])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, _TYPE)], ["doc_id", "repo", "owner", "found"])

    ship(docs.sparkSession)
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(repo, F.lit("\0")).alias("repo"), F.coalesce(owner, F.lit("\0")).alias("owner"), F.col(f"`{text_col}`").alias("text"))
    return kept.mapInArrow(run, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """value, occurrences, repos, owners over the whole corpus."""
    by = found.select("repo", "owner", F.explode("found.value").alias("value")).groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by.groupBy("value").agg(F.sum("n").alias("occurrences"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per document: doc_id and secrets, an array by start and kind of (start, kind, end, value, occurrences, repos, owners, verdict)."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    scratch = Scratch(docs.sparkSession)
    found = scratch.write("found", candidates(docs, id_col, text_col, repo, owner).withColumn("rid", F.monotonically_increasing_id()))
    freq = scratch.write("freq", ownership(found))
    each = found.select("rid", F.explode("found").alias("f")).select("rid", "f.*").join(freq, "value")
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("random"), "live").otherwise("plain")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    each = each.withColumn("verdict", verdict).filter((F.col("rank") < 3) | (F.col("verdict") == "live"))
    span = F.struct("start", "rank", kind.alias("kind"), "end", "value", "occurrences", "repos", "owners", "verdict")
    by_doc = each.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("secrets"))
    out = found.select("rid", "doc_id").join(by_doc, "rid", "left")
    empty = F.array().cast(by_doc.schema["secrets"].dataType)
    return out.select("doc_id", F.coalesce("secrets", empty).alias("secrets"))


def op9_secret_scan(spark, sf_dir):
    s = F.col("secrets")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    n = lambda test: F.size(F.filter(s, test)).cast("long")
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[n(is_kind(k)).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.filter(s, lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        text(s).alias("spans"),
        n(lambda x: x["verdict"] == "live").alias("n_live"),
        n(lambda x: x["verdict"] == "example").alias("n_example"),
    )
