"""Operator 6: language of every word, and of documents, by a linear-chain conditional random field.

Words (runs of anything but white space) are the chain; labels are the languages of the training rows. A word's
features are its affixes, character n-grams, itself, and per language whether it is among that language's most
frequent training words; transitions between labels are learned too. Training maximises the likelihood by
forward-backward and Adagrad on a bounded sample: SAMPLE rows per language, the first in order of their id's
hash, TRAIN_CHARS characters of each from its first word on; of these, runs of words of different languages are joined to chains, so that the transitions know
code-switched text. Prediction runs forward-backward over every whole text and labels each word by its marginal. A
document's language has the largest sum of marginals over words with a letter; its score is their mean.

Only text and language of rows whose crc32(id) mod FOLDS is not HELD_OUT are learned from; prediction reads text alone.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled row to learn from, all are;
rows without a language are not learned from; a null id belongs to the fold of the empty text's crc32; repeated rows get a
row each; equal sums go to the language that sorts first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_most_batches, fold, ship, slices, table

FOLDS, HELD_OUT = 5, 0
SAMPLE, TRAIN_CHARS = 300, 4000
CHAIN, MAX_CHAINS, EPOCHS = 24, 6000, 3
SPACE_BITS, LEXICON = 16, 400
SPACE = 1 << SPACE_BITS
UNDETERMINED = "und"
#: What str.split() takes for white space.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Cells of a padded batch of chains, words whose scores are kept at a time, and bytes of text that are labelled at a time: these bound a worker's memory.
CELLS, KEPT_WORDS, SLICE_BYTES = 1 << 18, 100_000, 2 << 20

ADDED = "lang_pred string, score double, n_words long, segments array<struct<first:int,words:int,lang:string>>"


#: Stripped from a word's ends before its characters are read (fixed values).
MARKS = ".,;:!?\"'()[]{}<>|#*%$&-_/\\"


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - SPACE_BITS)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, all at once.

    Returns per character (with a mark at each end of a word) the slots of the 2-gram and the 3-gram that begin there, (chars, 2);
    per word those of itself and of its affixes of 3 characters, (words, 3); and where the words begin. Affixes of 1 and 2
    characters are the n-grams with a mark. SPACE is the slot of what isn't there: its weights are 0.
    """
    own = [w.strip(MARKS) for w in words]
    size = np.fromiter(map(len, own), np.int64, len(own)) + 2
    c = np.frombuffer("".join(f"\x02{w}\x03" for w in own).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    end = start + size - 1
    with np.errstate(over="ignore"):
        pad = np.concatenate([c, np.zeros(3, np.uint64)])
        two = pad[:-3] * np.uint64(0x100000001B3) + pad[1:-2]
        three = two * np.uint64(0x100000001B3) + pad[2:-1]
        four = three * np.uint64(0x100000001B3) + pad[3:]
        grams = np.stack([_slot(two, 2), _slot(three, 3)], axis=1)
        grams[end] = SPACE
        grams[end - 1, 1] = SPACE
        at = np.arange(len(c)) - np.repeat(start, size)
        power = np.cumprod(np.full(int(size.max(initial=1)), 0xD6E8FEB86659FD93, np.uint64))
        whole = np.add.reduceat(c * power[at], start) if len(c) else c
        long = size >= 5
        affix = lambda where, salt: np.where(long, _slot(four[np.where(long, where, 0)], salt), SPACE)
        per_word = np.stack([_slot(whole, 1), affix(start, 4), affix(end - 3, 5)], axis=1)
    return grams, per_word, start


class Model:
    """Weights: of features (SPACE slots, one that stays 0, one per lexicon; labels), transitions (from, to), start; lexicon: word -> bits of languages."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.w = np.zeros((SPACE + 1 + n, n), np.float32)
        self.a, self.s = np.zeros((n, n)), np.zeros(n)

    def lexical(self, words: list[str]) -> np.ndarray:
        """(words, labels): whether a word is in a language's lexicon."""
        bits = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        return (bits[:, None] >> np.arange(len(self.labels))) & 1

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, labels)."""
        grams, per_word, start = features(words)
        w = self.w
        out = np.add.reduceat(w[grams[:, 0]] + w[grams[:, 1]], start, axis=0) + w[per_word].sum(axis=1)
        return out + self.lexical(words).astype(np.float32) @ w[SPACE + 1 :]


def marginals(score: np.ndarray, lens: np.ndarray, a: np.ndarray, s: np.ndarray, pairs: bool = False):
    """Forward-backward over chains (time, chain, label) that stand longest first; with pairs, the expected transitions and starts too."""
    steps, _, n = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    at, start = np.exp(a).astype(e.dtype), np.exp(s).astype(e.dtype)
    live = np.searchsorted(-lens, -np.arange(steps), side="left")  # chains longer than t
    f, g = np.empty_like(e), np.empty_like(e)
    for t in range(steps):
        k = live[t]
        x = e[t, :k] * (start if t == 0 else f[t - 1, :k] @ at)
        f[t, :k] = x / x.sum(axis=1, keepdims=True)
    back = at.T.copy()
    for t in range(steps - 1, -1, -1):
        k, m = live[t], live[t + 1] if t + 1 < steps else 0
        g[t, m:k] = 1
        if m:
            x = (e[t + 1, :m] * g[t + 1, :m]) @ back
            g[t, :m] = x / x.sum(axis=1, keepdims=True)
    p = f * g
    for t in range(steps):
        p[t, live[t] :] = 0
    total = p.sum(axis=2, keepdims=True)
    p /= np.where(total > 0, total, 1)
    if not pairs:
        return p
    trans = np.zeros((n, n))
    for t in range(1, steps):
        k = live[t]
        x = f[t - 1, :k, :, None] * at[None] * (e[t, :k] * g[t, :k])[:, None, :]
        trans += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, trans, p[0].sum(axis=0)


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model | None:
    """A model from (text, language) rows."""
    texts: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        if words := (text or "").lower().split():
            texts.setdefault(lang, []).append(words)
    if not texts:
        return None
    labels = sorted(texts)
    lexicon: dict[str, int] = {}
    for k, lang in enumerate(labels):
        count: dict[str, int] = {}
        for words in texts[lang]:
            for w in words:
                count[w] = count.get(w, 0) + 1
        for w in sorted(count, key=lambda w: (-count[w], w))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    model = Model(labels, lexicon)
    rng = np.random.default_rng(seed)

    def run(k: int, n: int) -> list[str]:
        words = texts[labels[k]][rng.integers(len(texts[labels[k]]))]
        at = rng.integers(max(1, len(words) - n + 1))
        return words[at : at + n]

    chains = []
    total = sum(len(w) for v in texts.values() for w in v)
    for _ in range(min(MAX_CHAINS, max(200, total // CHAIN))):
        chain: list[tuple[str, int]] = []
        mixed = rng.random() < 0.3
        k = int(rng.integers(len(labels)))
        while len(chain) < CHAIN:
            part = run(k, int(rng.integers(3, 10)) if mixed else CHAIN)
            chain += [(w, k) for w in part]
            if not mixed:
                break
            k = int(rng.integers(len(labels)))
        chains.append(chain[:CHAIN])
    vocab: dict[str, int] = {}
    ids = [[vocab.setdefault(w, len(vocab)) for w, _ in c] for c in chains]
    gold = [[k for _, k in c] for c in chains]
    grams, per_word, start = features(list(vocab))
    lex = model.lexical(list(vocab))
    parts = np.split(grams, start[1:])
    feats = [np.concatenate([g.ravel(), p, SPACE + 1 + np.flatnonzero(x)]) for g, p, x in zip(parts, per_word, lex)]
    n, rate = len(labels), 0.3
    gw, ga, gs = np.full_like(model.w, 1e-6), np.full((n, n), 1e-6), np.full(n, 1e-6)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 128):
            pick = sorted(order[at : at + 128], key=lambda i: -len(ids[i]))
            lens = np.array([len(ids[i]) for i in pick])
            words = np.unique(np.concatenate([ids[i] for i in pick]))
            flat = np.concatenate([feats[w] for w in words])
            size = np.array([len(feats[w]) for w in words])
            e = np.add.reduceat(model.w[flat], np.cumsum(size) - size, axis=0)
            where = np.zeros((lens[0], len(pick)), np.int64)
            y = np.full((lens[0], len(pick)), -1)
            for j, i in enumerate(pick):
                where[: lens[j], j] = np.searchsorted(words, ids[i])
                y[: lens[j], j] = gold[i]
            p, trans, first = marginals(e[where].astype(np.float64), lens, model.a, model.s, pairs=True)
            on = y >= 0
            d = p[on]
            d[np.arange(len(d)), y[on]] -= 1
            per_word = np.zeros((len(words), n))
            np.add.at(per_word, where[on], d)
            flat_grad = np.repeat(per_word, size, axis=0)
            used, slot = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(slot, flat_grad[:, k], len(used)) for k in range(n)], axis=1)
            grad += 1e-3 * model.w[used]
            gw[used] += grad**2
            model.w[used] -= rate * grad / np.sqrt(gw[used])
            model.w[SPACE] = 0
            both = on[1:] & on[:-1]
            np.add.at(trans, (y[:-1][both], y[1:][both]), -1.0)
            np.add.at(first, y[0], -1.0)
            trans += 1e-2 * model.a
            ga += trans**2
            gs += first**2
            model.a -= rate * trans / np.sqrt(ga)
            model.s -= rate * first / np.sqrt(gs)
    return model


class _Words(dict):
    """Numbers of words, in order; pending: those whose scores are yet to be computed."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.pending.append(word)
        return n


def label(model: Model, texts: list[str | None], known: tuple | None = None) -> list[tuple[str, float, int, list[dict]]]:
    """Per text: language, score, words, segments (runs of words of one language)."""
    known = known or (_Words(), [np.zeros((0, len(model.labels)), np.float32)], [np.zeros(0, bool)])
    numbers, scores, letters = known
    chains = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in ((t or "").lower().split() for t in texts)]
    if numbers.pending:
        scores[0] = np.concatenate([scores[0], model.emissions(numbers.pending)])
        letters[0] = np.concatenate([letters[0], np.array([w[0].isalpha() or any(c.isalpha() for c in w) for w in numbers.pending])])
        numbers.pending = []
    out: list = [(UNDETERMINED, 0.0, 0, [])] * len(texts)
    order = sorted((i for i in range(len(texts)) if len(chains[i])), key=lambda i: -len(chains[i]))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, CELLS // len(chains[order[at]]))]
        at += len(group)
        lens = np.array([len(chains[i]) for i in group])
        idx = np.zeros((lens[0], len(group)), np.int32)
        for j, i in enumerate(group):
            idx[: lens[j], j] = chains[i]
        p = marginals(scores[0][idx], lens, model.a, model.s)
        spoken = letters[0][idx]
        n_spoken = np.array([spoken[: lens[j], j].sum() for j in range(len(group))])
        sums = np.einsum("tbl,tb->bl", p, spoken, dtype=np.float64)
        best = p.argmax(axis=2)
        for j, i in enumerate(group):
            run = best[: lens[j], j]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            size = np.diff(np.append(first, len(run)))
            segments = [{"first": int(a), "words": int(n), "lang": model.labels[run[a]]} for a, n in zip(first, size)]
            k = int(sums[j].argmax())
            if n_spoken[j]:
                out[i] = (model.labels[k], min(1.0, float(sums[j][k] / n_spoken[j])), len(run), segments)
            else:
                out[i] = (UNDETERMINED, 0.0, len(run), segments)
    return out


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> list[tuple[str, str]]:
    """The first sample rows with a word per language, by their id's hash. Rows that the hash puts far behind those are left out before any sort."""
    h = F.xxhash64(F.col(f"`{id_col}`"))
    part = docs.select(F.substring(F.ltrim(F.col(f"`{text_col}`").cast("string"), F.lit(BLANK)), 1, TRAIN_CHARS).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), h.alias("h"), F.col(f"`{id_col}`").alias("id"))
    part = part.filter((fold(f"`{id_col}`", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["count"] for r in part.groupBy("lang").count().collect()}  # a row per label of the model
    if not counts:
        return []

    def first(rows: DataFrame) -> list:
        w = Window.partitionBy("lang").orderBy("h", "id", "text")
        return rows.withColumn("r", F.row_number().over(w)).filter(f"r <= {sample}").select("text", "lang", "r").collect()

    # four times as many as are wanted come before this hash, all but surely; hashes are spread over 2^64
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, 4 * sample / n) * 2.0**64 - 2.0**63))])
    got = first(part.filter(F.col("h").cast("double") <= below[F.col("lang")]))
    found = Counter(r.lang for r in got)
    short = [k for k, n in counts.items() if found[k] < min(sample, n)]
    if short:  # few ids share the label's rows, so their hashes are not spread: all its rows are compared
        got = [r for r in got if r.lang not in short] + first(part.filter(F.col("lang").isin(short)))
    return [(r.text, r.lang) for r in sorted(got, key=lambda r: (r.lang, r.r))]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The columns of docs, then lang_pred, score, n_words and segments (first word, words, lang); an added column replaces one of its name."""
    spark = docs.sparkSession
    ship(spark)
    at_most_batches(spark, 8 << 20)
    model = spark.sparkContext.broadcast(train(training_rows(docs, id_col, text_col, lang_col, sample)))
    added = T.StructType.fromDDL(ADDED)
    keep = [c for c in docs.columns if c not in added.names]
    kept = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept.schema.fields[1:]], *added])
    segment = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        known = None
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            texts = batch.column(0).to_pylist()
            if model.value is None:
                rows = [(UNDETERMINED, 0.0, len((t or "").split()), []) for t in texts]
            else:
                if known is None or len(known[0]) > KEPT_WORDS:
                    known = (_Words(), [np.zeros((0, len(model.value.labels)), np.float32)], [np.zeros(0, bool)])
                rows = label(model.value, texts, known)
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), segment)))], schema.names)

    return kept.mapInArrow(run, schema)


def op6_crf_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT))
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_words", F.size("segments").cast("long").alias("n_segments"))
