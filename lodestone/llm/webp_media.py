"""Operator 7: media columns of lossless WebP files, written and decoded by vp8l.

store_texts() writes texts as images, read_media() decodes a column of any lossless WebP files into pixel arrays, and
media_features() derives its digests from what read_media() reads out of the bytes that store_texts() stored.

The payload is the UTF-8 text and zero bytes up to a positive multiple of 64. It is stored as 8-bit samples,
64 to a row (a multiple of 64 for payloads over 1 MiB, with zero rows at the end where needed), in one VP8L
image: by the smallest of literal prefix codes, prefix codes with back-references, and a palette. Colour cache,
predictor and colour transforms are not written (see vp8l for why); read_media() inverts them in other files.

Defined cases: a null text counts as empty; equal texts give equal values; repeated rows and null ids give a
row each; an empty table gives an empty result; extra columns are ignored by store_texts() and kept by read_media(), where
an added column replaces one of its name. A null file, or one that is not a valid lossless WebP file, has null size, pixels,
coding and feature. A text over 2^28 bytes does not fit the format's sides: an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import vp8l
from .common import at_most_batches, ship, slices, table

UNIT = 64
#: Bytes of text or media taken at a time, and bytes of pixels handed on at a time (one row at least).
BATCH = 8 << 20
READ = "width int, height int, pixels binary, coding string, feature string"


def store(text: bytes) -> bytes:
    """The payload of a text as a WebP file."""
    rows = max(1, -(-len(text) // UNIT))
    wide = -(-rows // vp8l.MAX_SIDE)
    samples = np.zeros((-(-rows // wide), wide * UNIT), np.uint8)
    samples.ravel()[: len(text)] = np.frombuffer(text, np.uint8)
    return vp8l.encode_grey(samples)


def load(media: bytes) -> np.ndarray:
    """The stored samples (height, width)."""
    return ((vp8l.decode(media) >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8)


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a histogram of 8 classes of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n = samples.size
    mean = float(counts @ np.arange(256)) / n
    var = float(counts @ (np.arange(256) - mean) ** 2) / n
    p = counts[counts > 0] / n
    classes = ",".join(str(x) for x in counts.reshape(8, 32).sum(axis=1).tolist())
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};std={var**0.5:.4f};bits={abs(float(-(p * np.log2(p)).sum())):.4f};hist={classes}"


def coding(info: dict) -> str:
    """What a stream used: its transforms, then copies and cached pixels with their numbers, or literals alone."""
    used = [*info["transforms"], *[f"{k}={info[k]}" for k in ("copies", "cached") if k in info]]
    return ",".join(used) or "literals"


def decode_one(media: bytes | None, grey: bool) -> tuple:
    """Width, height, pixels, coding and feature of a file."""
    info: dict = {}
    try:
        argb = vp8l.decode(media or b"", info)
    except (ValueError, IndexError):
        return (None,) * 5
    green = ((argb >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8)
    pixels = (green if grey else argb.astype("<u4")).tobytes()
    return argb.shape[1], argb.shape[0], pixels, coding(info), feature(green)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the text as a WebP file."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, BATCH):
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                files = {t: store(t) for t in set(texts)}
                sizes, media = pa.array([len(t) for t in texts], pa.int64()), pa.array([files[t] for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    at_most_batches(docs.sparkSession, BATCH)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame, media_col: str = "media", grey: bool = False) -> DataFrame:
    """The columns of df and, of its column of WebP files: width, height, pixels (row by row, ARGB as four little-endian bytes
    each, or with grey the green byte alone), coding (what the stream used) and feature (of the green channel)."""
    added = StructType.fromDDL(READ)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added.names])
    at = kept.columns.index(media_col)
    names = [*kept.columns, *added.names]
    kept = kept.toDF(*[f"_{k}" for k in range(len(kept.columns))])  # mapInArrow does not resolve names with dots
    schema = StructType(kept.schema.fields + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at, BATCH):
                seen: dict[bytes | None, tuple] = {}
                rows, size, first = [], 0, 0
                for k, media in enumerate(batch.column(at).to_pylist()):
                    if media not in seen:
                        seen[media] = decode_one(media, grey)
                    rows.append(seen[media])
                    size += len(rows[-1][2] or b"")
                    if size >= BATCH or k == batch.num_rows - 1:
                        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                        yield pa.RecordBatch.from_arrays([*batch.slice(first, len(rows)).columns, *cols], schema.names)
                        rows, size, first = [], 0, k + 1
                        seen = {}

    ship(df.sparkSession)
    at_most_batches(df.sparkSession, BATCH)
    return kept.mapInArrow(run, schema).toDF(*names)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of each text's stored form and of the payload that is read back from it."""
    read = read_media(store_texts(docs, id_col, text_col), grey=True)
    size = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / UNIT)) * UNIT
    payload = F.col("pixels").substr(F.lit(1), F.col("payload_bytes").cast("int"))
    tail = F.col("pixels").substr((F.col("payload_bytes") - UNIT + 1).cast("int"), F.lit(UNIT))
    return read.withColumn("payload_bytes", size.cast("long")).select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "coding",
    )


def op7_webp_media(spark, sf_dir):
    return media_features(table(spark, sf_dir, "documents"))
