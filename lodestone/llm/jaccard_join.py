"""Operator 8: n-gram Jaccard join, exact, over size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two documents link when
100 * |A and B| >= 75 * |A or B|. Steps:

1. Shingles are counted over the corpus in hash cells (16 cells to a token or more). The counts only order the
   shingles, rare before common, so a cell that two shingles share does no harm.
2. The rarest n - ceil(0.75 n) + 1 shingles of a document are its prefix; linked documents share a prefix
   shingle. Shingles counted once are in one document alone, so most documents have no more to do. Equal sets
   are one node from here on.
3. A tile is the nodes that share a prefix shingle, cut into bands of size. In the first round each node is
   compared with one node only, the least of the tiles it is in; components of the links follow.
4. Tiles whose nodes are in one component are done. In the others, most nodes are of one component; the rest meet
   them, in blocks of a bounded number of nodes of like size. Nodes carry the least keys of their open tiles: two that
   have one in common below a tile's key meet in that one, and are passed over here. A block emits no pairs but those of different components that
   bitmaps leave: at first the most promising one for each node, then, when the components have grown by these,
   all of them. So every pair that could link two components is compared, and the pairs of a group that is one
   component are never made.
5. Of a pair, the bitmaps (a bit per shingle hash; 4 bits to a shingle, 1024 at least) bound the overlap from above:
   |A and B| <= min(|A| - bits only in A, |B| - bits only in B). Pairs within reach of the threshold get the
   exact intersection of their sorted arrays (48 bits of each hash).

Defined cases: a null or empty text or one without words has the empty set, no link, and its own id as its
component; fewer than 5 words are one shingle; equal sets link; repeated rows get a row each; a null id is a
node but never the least id unless its whole component has none; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_bytes, pack, partitions, partitions_for, table
from .components import components
from .tokens import _planes, _unplanes, mix, pack_sorted, runs, token_blocks, unpack_numbers, unpack_sorted

WORDS = 5
#: Links: PERCENT of the union or more.
PERCENT = 75
#: Bits of a bitmap, at least and at most; more only make the bound tighter.
SIGNATURE, WIDEST = 1024, 16384
#: Nodes of each kind in a block, in the mean.
BLOCK_NODES = 512
SHARD_BYTES = 24 << 20
#: Keys of open tiles that a node carries, the least ones.
FIRST = 8
#: Cells per token that shingles are counted in, at least.
CELLS = 16

_SETS = "doc_id long, t long, n long, s1 long, s2 long"
_ASK = "shard int, block long, cells binary, counts binary"
_REPLY = "shard int, block long, codes binary"
_CAND = "n long, s1 long, s2 long, keys array<long>, sig binary, elements binary"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def shingle_sets(vocab: np.ndarray, tokens: np.ndarray, lens: np.ndarray, words: int) -> list[np.ndarray]:
    """Per document its distinct shingle hashes, ascending."""
    h = vocab[tokens]
    s = h
    for k in range(1, words):
        s = mix(s[: len(h) - k], h[k:])
    out, at = [], 0
    for n in lens.tolist():
        if n >= words:
            out.append(np.unique(s[at : at + n - words + 1]))
        elif n:
            x = h[at : at + 1]
            for k in range(1, n):
                x = mix(x, h[at + k : at + k + 1])
            out.append(x + np.uint64(n))  # of another length than a whole shingle
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _set_hash(u: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(u.tobytes())
    return (x & (2**64 - 1)) - 2**63, (x >> 64) - 2**63


def _block_sets(row, words: int) -> list[np.ndarray]:
    lens = row["lens"].flatten().to_numpy(zero_copy_only=False)
    return shingle_sets(np.frombuffer(row["vocab"][0].as_py(), np.uint64), unpack_numbers(row["tokens"][0].as_py()), lens, words)


def _distinct(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of equal sets in a block, the first; none that is empty."""
    return list({_set_hash(u): u for u in reversed(sets) if len(u)}.values())


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _cells(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return np.concatenate(sets) >> np.uint64(64 - bits) if sets else np.zeros(0, np.uint64)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's cells summed; back go codes that rise with the count: 1 for once, then 8 to the octave."""
    cells = [unpack_sorted(b) for b in pdf["cells"]]
    sizes = [len(c) for c in cells]
    distinct, at = np.unique(np.concatenate(cells), return_inverse=True)
    del cells
    total = np.bincount(at, np.concatenate([_unplanes(b, np.uint16) for b in pdf["counts"]]))
    code = np.where(total < 2, 1, np.minimum(255, 2 + np.floor(8 * np.log2(np.maximum(total, 2) / 2)))).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = [_planes(code[at[edges[i] : edges[i + 1]]]) for i in range(len(sizes))]
    return pd.DataFrame({"shard": pdf["shard"].astype("int32"), "block": pdf["block"], "codes": out})


def signature(u: np.ndarray) -> bytes:
    width = min(WIDEST, max(SIGNATURE, 1 << (4 * len(u) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(u & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def signatures(sigs: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of uint64, wide ones folded to the least width among them."""
    width = min(map(len, sigs)) if sigs else 8
    fold = lambda s: np.frombuffer(s, np.uint64) if len(s) == width else np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, width // 8), axis=0)
    return np.stack([fold(s) for s in sigs]) if sigs else np.zeros((0, 1), np.uint64)


def most(n: int, sig: np.ndarray, ns: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """Bounds from above of the overlaps of one set with others."""
    both = np.bitwise_count(sig & sigs).sum(axis=1, dtype=np.int64)
    own = int(np.bitwise_count(sig).sum(dtype=np.int64))
    return np.minimum(n - (own - both), ns - (np.bitwise_count(sigs).sum(axis=1, dtype=np.int64) - both))


def near_pairs(block: dict, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of different components in a block, one of them asking, that the bitmaps leave; every, or the best for each that asks.

    block: arrays node, n, label, asks, first (the FIRST least keys of each node's open tiles), and sig, a list; key: the tile's.
    Pairs that meet in a tile of a lesser key, by what first tells, are left to that one."""
    node, n, label, asks = (block[c] for c in ("node", "n", "label", "asks"))
    first, key = block["first"], block["key"]
    there_first = np.where(first < key, first, np.iinfo(np.int64).max)
    sigs = signatures(block["sig"])
    there = np.flatnonzero(~asks)
    a, b = [], []
    for i in np.flatnonzero(asks):
        to = there[(label[there] != label[i]) & (100 * np.minimum(n[there], n[i]) >= percent * np.maximum(n[there], n[i]))]
        before = first[i][first[i] < key]
        if len(before) and len(to):
            to = to[~np.isin(there_first[to], before).any(axis=1)]
        if not len(to):
            continue
        bound = most(int(n[i]), sigs[i], n[to], sigs[to])
        left = (100 + percent) * bound >= percent * (n[to] + n[i])
        to, bound = to[left], bound[left]
        if len(to) and not every:
            to = to[[int(np.lexsort((node[to], -bound / (n[to] + n[i])))[0])]]
        a.append(np.minimum(node[to], node[i]))
        b.append(np.maximum(node[to], node[i]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pack48(u: np.ndarray) -> bytes:
    return np.ascontiguousarray((u >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0


def one_key(posts: DataFrame) -> DataFrame:
    """Of keys that the same nodes have (as those of a passage), the posts of the least; 128 bits say which nodes a key has.

    posts: node, n, key; a node has a key once."""
    of = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "node"))
    same = posts.groupBy("key").agg(F.count(F.lit(1)).alias("c"), of(1).alias("x"), of(2).alias("y"))
    return posts.join(same.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


class _Join:
    """One run: the tables it has written and what they need."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.scratch = Scratch(self.spark)
        self.blocks = self.scratch.write("blocks", token_blocks(docs, id_col, text_col, F.xxhash64(F.col(f"`{text_col}`")), ends=False))

    def sets(self) -> DataFrame:
        words = self.words

        def run(batches):
            for row in _rows(batches):
                sets = _block_sets(row, words)
                h = [_set_hash(u) for u in sets]
                yield pa.RecordBatch.from_arrays([row["ids"].flatten(), row["marks"].flatten(), pa.array([len(u) for u in sets], pa.int64()), *(pa.array([x[k] for x in h], pa.int64()) for k in (0, 1))], _names(_SETS))

        return self.scratch.write("sets", self.blocks.mapInArrow(run, _SETS))

    def candidates(self) -> DataFrame:
        """The documents that have a shared shingle in their prefix, with what comparing them takes."""
        words, percent = self.words, self.percent
        size, whole, tokens = (x or 0 for x in self.blocks.agg(F.sum(F.length("tokens")), F.sum(F.length("tokens") + F.length("vocab")), F.sum(F.expr("aggregate(lens, 0L, (s, x) -> s + x)"))).first())
        bits = min(62, max(20, math.ceil(math.log2(CELLS * max(1, tokens)))))
        shards = max(partitions(self.spark), math.ceil(3 * size / SHARD_BYTES))

        def asks(batches):
            for row in _rows(batches):
                cells, counts = np.unique(_cells(_distinct(_block_sets(row, words)), bits), return_counts=True)
                used = runs(cells, shards, bits)
                parts = [slice(a, b) for _, a, b in used]
                counts = np.minimum(counts, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([u[0] for u in used], pa.int32()), pa.array([row["block"][0].as_py()] * len(used), pa.int64()), pa.array([pack_sorted(cells[p]) for p in parts], pa.binary()), pa.array([_planes(counts[p]) for p in parts], pa.binary())], _names(_ASK))

        replies = self.blocks.mapInArrow(asks, _ASK).groupBy("shard").applyInPandas(_count, _REPLY)
        parts = partitions_for(self.spark, 2 * whole)
        replies = replies.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "codes")).alias("replies"))  # no more than the block asked for

        def pick(batches):
            for row in _rows(batches):
                sets = _distinct(_block_sets(row, words))
                if not sets:
                    continue
                cells = np.unique(_cells(sets, bits))
                code = np.concatenate([_unplanes(r["codes"], np.uint8) for r in sorted(row["replies"][0].as_py(), key=lambda r: r["shard"])])
                out = []
                for u in sets:
                    c = code[np.searchsorted(cells, u >> np.uint64(64 - bits))]
                    n = len(u)
                    prefix = n - -(-percent * n // 100) + 1
                    if int((c == 1).sum()) >= prefix:
                        continue
                    first = np.lexsort((u, c))[:prefix]
                    keys = u[first[c[first] > 1]]
                    out.append((n, *_set_hash(u), keys.view(np.int64), signature(u), pack48(u)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _names(_CAND))

        found = self.blocks.repartition(parts, "block").join(replies, "block").mapInArrow(pick, _CAND)
        out = self.scratch.write("candidates", found.withColumn("rid", F.monotonically_increasing_id()))
        self.scratch.drop("blocks")
        return out

    def verified(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) those that link. Texts travel only of nodes that pairs name."""
        p, s = self.percent, self.scratch
        named = s.write(f"{name}-named", pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        nodes = nodes.join(named, "node", "left_semi")
        side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "elements")])
        full = pairs.join(side("b"), "b").join(side("a"), "a").filter(f"least(n_a, n_b) * 100 >= {p} * greatest(n_a, n_b)")

        def exact(batches):
            for batch in batches:
                yes = []
                for na, nb, sa, sb, ea, eb in zip(*(batch[c].to_pylist() for c in ("n_a", "n_b", "sig_a", "sig_b", "elements_a", "elements_b"))):
                    sigs = signatures([sa, sb])
                    near = (100 + p) * int(most(na, sigs[0], np.array([nb]), sigs[1:])[0]) >= p * (na + nb)
                    yes.append(near and (100 + p) * overlap(unpack48(ea), unpack48(eb)) >= p * (na + nb))
                yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

        return full.mapInArrow(exact, "a long, b long")

    def band(self) -> Column:
        return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent)).cast("int")

    def blocks_of(self, rest: DataFrame, nodes: DataFrame) -> DataFrame:
        """Open tiles as blocks (key, band, i, j): the nodes of a band of size, and those of other components than the tile's largest, which ask.

        A node goes only where one of another component may be of like size: labels stay apart that far while a tile has two.

        rest: node, n, key, label, m (nodes in the tile), few (those that ask), major (the largest component), labels (components),
        most, least (bits of the bands that the largest and the smallest component have), bands (those of all)."""
        end = F.array_repeat(F.lit(2**63 - 1).cast("long"), FIRST)
        first = rest.groupBy("node").agg(F.slice(F.concat(F.array_sort(F.collect_list("key")), end), 1, FIRST).alias("first"))  # no more than its prefix
        two, major, has = F.col("labels") == 2, F.col("label") == F.col("major"), lambda of, b: F.call_function("shiftright", of, F.pmod(b, F.lit(64))).bitwiseAND(F.lit(1).cast("long")) == 1
        near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
        to = F.when(~major, F.filter(near, lambda b: has(F.when(two, F.col("most")).otherwise(F.col("bands")), b))).otherwise(F.array().cast("array<int>"))
        met = F.when(two, major & F.exists(near, lambda b: has(F.col("least"), b))).otherwise(F.lit(True))
        rest = rest.withColumn("band", self.band()).withColumn("to", to).withColumn("met", met).filter("met or size(to) > 0")
        rows = rest.select("node", "n", "key", "label", "m", "few", "band", "to", "met").join(nodes.select("node", "sig").join(first, "node"), "node")
        part = lambda c: F.ceil(F.col(c) / BLOCK_NODES).cast("int")
        of = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), part(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), part(c) - 1))
        cols = ["key", "band", "i", "j", "node", "n", "label", "sig", "asks", "first"]
        there = rows.filter("met").withColumn("j", of("m", "j")).withColumn("i", each("few")).withColumn("asks", F.lit(False))
        asks = rows.filter("size(to) > 0").withColumn("i", of("few", "i")).withColumn("j", each("m")).withColumn("asks", F.lit(True))
        asks = asks.withColumn("band", F.explode("to"))
        return there.select(*cols).unionByName(asks.select(*cols))

    def candidates_in(self, blocks: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) from all blocks, each pair once."""
        percent = self.percent
        at = ["key", "band", "i", "j"]

        def run(batches):
            kept = None
            for batch in batches:  # blocks stand one after another, but may go on in the next batch
                kept = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
                keys = np.stack([kept[c].to_numpy(zero_copy_only=False) for c in at], axis=1)
                edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
                yield from scan(kept, edges)
                kept = kept.slice(int(edges[-1]))
            if kept is not None and kept.num_rows:
                yield from scan(kept, np.array([0, kept.num_rows]))

        def scan(rows, edges):
            cols = {c: rows[c].to_numpy(zero_copy_only=False) for c in ("node", "n", "label", "asks")}
            cols["first"] = rows["first"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FIRST)
            keys = rows["key"].to_numpy(zero_copy_only=False)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(edges[:-1], edges[1:]):
                block = {c: v[x:y] for c, v in cols.items()}
                if block["asks"].any() and not block["asks"].all():
                    pairs = near_pairs(block | {"key": keys[x], "sig": rows["sig"].slice(int(x), int(y - x)).to_pylist()}, percent, every)
                    a.append(pairs[0])
                    b.append(pairs[1])
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        return blocks.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "a long, b long").distinct()

    def links(self, cand: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Enough of the links between nodes to have their components; the nodes (s1, s2, node); the components (node, label)."""
        s, band = self.scratch, self.band()
        names = s.write("nodes", cand.groupBy("s1", "s2").agg(F.min("rid").alias("node")))
        nodes = cand.withColumnRenamed("rid", "node")  # rows of equal sets but the least are in no pair
        posts = cand.select("rid", "n", "keys").join(names.select(F.col("node").alias("rid")), "rid", "left_semi")
        posts = s.write("posts", posts.select(F.col("rid").alias("node"), "n", F.explode("keys").alias("key")))
        shared = s.write("shared", posts.join(posts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "key", "left_semi"))
        s.drop("posts")
        posts = s.write("tiles", one_key(shared))
        s.drop("shared")
        tiles = posts.groupBy("key", band.alias("band")).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        first = posts.withColumn("band", band).join(tiles, ["key", "band"]).groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).filter("a <> b")
        first = s.write("pairs-0", first.select("a", "b"))
        links = s.write("links-0", self.verified(first, nodes, "pairs-0"))
        labels = components(s, links, "cc0")
        s.drop("pairs-0", "pairs-0-named")
        rest = posts
        for k, every in enumerate((False, True), 1):
            rest = rest.select("node", "n", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(band, F.lit(64)))
            sizes = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.bit_or(bit).alias("bands"))
            at = F.struct("m", "label")
            open_ = sizes.groupBy("key").agg(
                F.sum("m").alias("m"),
                (F.sum("m") - F.max("m")).alias("few"),
                F.max_by("label", at).alias("major"),
                F.count(F.lit(1)).alias("labels"),
                F.max_by("bands", at).alias("most"),
                F.min_by("bands", at).alias("least"),
                F.bit_or("bands").alias("bands"),
            ).filter("few > 0")
            rest = s.write(f"rest-{k}", rest.join(open_, "key"))
            if rest.isEmpty():  # all tiles are done
                break
            pairs = s.write(f"pairs-{k}", self.candidates_in(self.blocks_of(rest, nodes), every))
            found = self.verified(pairs, nodes, f"pairs-{k}")
            links = s.write(f"links-{k}", links.unionByName(found))
            labels = components(s, links, f"cc{k}")
            s.drop(f"pairs-{k}", f"pairs-{k}-named", f"links-{k - 1}", f"cc{k - 1}")
        s.drop("tiles", "rest-1", "rest-2", "candidates")
        return links, names, labels


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """The scratch tables; a row per row of docs (doc_id, t, n, s1, s2); and one per distinct set: s1, s2, c (its component's least id), first (of its component's rows), n_verified."""
    with batch_bytes(docs.sparkSession, 16 << 20):  # blocks are large rows
        run = _Join(docs, id_col, text_col, words, percent)
        s, sets = run.scratch, run.sets()
        links, names, labels = run.links(run.candidates())
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")  # ids first, then null ones
        least = s.write("least", sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(row).alias("first")))
        linked = s.write("linked", least.join(names, ["s1", "s2"]).join(labels, "node").join(ends, "node"))
        comp = linked.groupBy("label").agg(F.min("least").alias("c"), F.min("first").alias("f"))
        linked = linked.join(comp, "label").select("s1", "s2", "c", "f", "n_verified")
        by_set = least.join(linked, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("c", "least").alias("c"), F.coalesce("f", "first").alias("first"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
        by_set = s.write("by_set", by_set)
        s.drop("least", "linked", "nodes", *(f"{x}{k}" for x in ("links-", "cc") for k in range(3)))
    return s, sets, by_set


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_verified.

    n_verified: links of its set that were compared exactly, enough to span the component; not all links within it are."""
    _, sets, by_set = _joined(docs, id_col, text_col, words, percent)
    out = sets.filter("n > 0").join(by_set, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), "n_verified")
    none = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_verified"))
    return out.unionByName(none)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, and all rows without words, which link with nothing.

    The row with the least id stays, one without an id only where none has any; of rows of one id the one whose text has the
    least hash, of rows of one id and text the one whose columns have. Only what says which rows go meets docs; texts are
    not shuffled as long as that is small enough to be sent to all tasks."""
    s, sets, by_set = _joined(docs, id_col, text_col, words, percent)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t") == F.col("first")
    rows = sets.filter("n > 0").join(by_set, ["s1", "s2"]).groupBy("doc_id", "t").agg(F.first(first).alias("stays"), F.count(F.lit(1)).alias("m"))
    marked = s.write("marked", rows.filter("not stays or m > 1").select(F.col("doc_id").alias("_i"), F.col("t").alias("_m"), "stays"))
    s.drop("sets", "by_set")
    whole = pack(docs).withColumn("_h", F.xxhash64(F.col(f"_row.`{text_col}`")))
    on: Column = F.col(f"_row.`{id_col}`").cast("long").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_m"))
    out = whole.join(marked, on, "left_anti").select("_row.*")
    again = marked.filter("stays")
    if again.isEmpty():  # no row to choose among equal ones: docs need not be read twice
        return out
    least = F.min_by("_row", F.xxhash64(*[F.col(f"_row.`{c}`") for c in docs.columns])).alias("_row")
    return out.unionByName(whole.join(again, on).groupBy("_i", "_m").agg(least).select("_row.*"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).drop("n_verified")  # SQL has no such spanning part


SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= {WORDS} then [array_to_string(w[i:i + {WORDS - 1}], ' ') for i in range(1, len(w) - {WORDS - 2})]
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from words),
sizes as (select doc_id, count(*) n from shingles group by 1),
pairs as (select x.doc_id a, y.doc_id b, count(*) c from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= {PERCENT} * (p.n + q.n - c)),
ends as (select a, b from links union all select b, a from links),
reached(doc_id, c) as (select doc_id, doc_id from documents union select ends.b, reached.c from reached join ends on reached.doc_id = ends.a)
select d.doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(c)::bigint component_id
from documents d join reached using (doc_id) left join sizes using (doc_id) group by d.doc_id
"""
