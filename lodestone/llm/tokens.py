"""Token blocks: whole texts as runs of token numbers, a bounded number of bytes to a block.

A block holds some documents of one partition: their ids, token counts, token numbers in order, and the 64-bit
hash of each of its distinct tokens. Operators that need corpus-wide counts send each block's distinct keys,
packed and sorted, to shards of the hash space, and get the counts back in the same order: per distinct key
and block some bytes travel, not per occurrence, and no table of the corpus is sent to every task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bytes of text from which a block is closed.
BLOCK_BYTES = 8 << 20
#: Number and hash of the token that ends every text; the hash is a fixed value.
END, END_HASH = 0, 0x9E3779B97F4A7C15

BLOCKS = "block long, ids array<long>, marks array<long>, lens array<int>, tokens binary, vocab binary"


def _planes(a: np.ndarray) -> bytes:
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def _unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def pack_numbers(a: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(a, np.uint32))


def unpack_numbers(b: bytes) -> np.ndarray:
    return _unplanes(b, np.uint32)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 by their differences."""
    d = np.empty(len(a), np.uint64)
    d[:1] = a[:1]
    np.subtract(a[1:], a[:-1], out=d[1:])
    return _planes(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """Hashes of sequences, from those of their heads and their last tokens; order counts."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + follower * np.uint64(0x94D049BB133111EB) + np.uint64(END_HASH)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def token_blocks(docs: DataFrame, id_col: str, text_col: str, mark: Column | None = None, block_bytes: int = BLOCK_BYTES, ends: bool = True) -> DataFrame:
    """docs as blocks (BLOCKS). Tokens: words in lower case (A-Z), then, with ends, one END per text. mark: a long per document that goes along."""

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        ids, marks, runs, numbers, size = [], [], [], _Numbers({None: END}), 0

        def block():
            nonlocal ids, marks, runs, numbers, size, count
            words = list(numbers)
            vocab = np.array([END_HASH, *(xxhash.xxh3_64_intdigest(w) for w in words[1:])], np.uint64)
            flat = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
            row = [[part << 32 | count], [ids], [marks], [[len(r) for r in runs]], [pack_numbers(flat)], [vocab.tobytes()]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES)], _NAMES)
            ids, marks, runs, numbers, size, count = [], [], [], _Numbers({None: END}), 0, count + 1
            return out

        for batch in batches:
            for i, text, m in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                words = raw.lower().split()
                n = len(words)
                r = np.fromiter(map(numbers.__getitem__, words), np.uint32, n)
                if ends:
                    r = np.append(r, np.uint32(END))
                ids.append(i)
                marks.append(m)
                runs.append(r)
                size += len(raw) + 16
                if size >= block_bytes:
                    yield block()
        if ids:
            yield block()

    ship(docs.sparkSession)
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    return kept.mapInArrow(run, BLOCKS)


_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]
_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


@functools.lru_cache(8)
def _bounds(shards: int, top: int) -> np.ndarray:
    return np.array([(i << top) // shards for i in range(1, shards)], np.uint64)


def cut(hashes: np.ndarray, shards: int, top: int = 64) -> np.ndarray:
    """Where the shards' ranges begin and end in ascending hashes of top bits."""
    return np.concatenate([[0], np.searchsorted(hashes, _bounds(shards, top)), [len(hashes)]])


def runs(hashes: np.ndarray, shards: int, top: int = 64) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the shards that some of the ascending hashes fall in."""
    edges = cut(hashes, shards, top)
    used = np.flatnonzero(edges[1:] > edges[:-1])
    return list(zip(used.tolist(), edges[used].tolist(), edges[used + 1].tolist()))
