"""Operator 5: main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks (html_blocks). Each block has a vector: its tag path (tags, classes and ids,
hashed, by distance from the leaf), its words (hashed) and a few measures. A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or not. Main blocks are joined by one space, in page order.

Pages carry no labels, so the labeller is trained, on the driver, on pages that this module writes itself (PAGES of them, of
many layouts, with labels known by construction); their words come from a bounded sample of the given pages (WORD_PAGES, the
first in order of their id's hash; PAGE_RUNS runs of RUN_WORDS words from random places of each whole page). The model has a fixed size and is sent to all tasks.

Defined cases: a null page or one without blocks has the empty text; tags that break off are dropped, with what is not a
tag kept as text; repeated rows and null ids get a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_most_batches, likely_first, ship, slices, table
from .html_blocks import Block, blocks

PATH, WORDS, MEASURES, HIDDEN = 160, 48, 7, 24
PAGES, WORD_PAGES, EPOCHS = 700, 100, 7
#: Runs of words that the sample takes from a page, of how many words, at random places of the whole page.
PAGE_RUNS, RUN_WORDS = 20, 25
DEPTH = 10
CELLS = 1 << 13

OUT = "page_id long, url string, text string, n_chars long"


# ---- vectors


def _slot(s: str, n: int) -> int:
    return zlib.crc32(s.encode()) % n


class Vectors:
    """Block vectors; path vectors and word slots are kept, within a bound."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            v = np.zeros(PATH, np.float32)
            for up, name in enumerate(path[::-1][:DEPTH]):
                words = name.replace("-", " ").replace("_", " ").split()
                v[_slot(f"{up < 2}{words[0]}", PATH)] = 1
                for w in words:
                    v[_slot(f"~{w}", PATH)] = 1
            self.paths[path] = v
        return v

    def slot(self, word: str) -> int:
        s = self.words.get(word)
        if s is None:
            if len(self.words) > 200_000:
                self.words.clear()
            s = self.words[word] = _slot(word, WORDS)
        return s

    def page(self, bs: list[Block]) -> np.ndarray:
        out = np.zeros((len(bs), PATH + WORDS + MEASURES), np.float32)
        for i, b in enumerate(bs):
            words = b.text.lower().split()
            n = len(b.text)
            out[i, :PATH] = self.path(b.path)
            counts = np.bincount([self.slot(w) for w in words], minlength=WORDS)
            out[i, PATH : PATH + WORDS] = counts / (counts @ counts) ** 0.5
            ends = b.text.count(".") + b.text.count(",")
            out[i, PATH + WORDS :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked / n, ends / len(words), i / len(bs), b.text[-1] in ".!?", len(b.path) / DEPTH)
        return out


# ---- network


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Net:
    """One LSTM each way and a logistic layer on both their outputs."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        d = PATH + WORDS + MEASURES
        self.p = {}
        for w in ("f", "b"):
            self.p[f"x{w}"] = (rng.standard_normal((d, 4 * hidden)) * 0.15).astype(np.float32)
            self.p[f"h{w}"] = (rng.standard_normal((hidden, 4 * hidden)) * hidden**-0.5).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[f"c{w}"] = bias
        self.p["o"] = (rng.standard_normal((2 * hidden, 1)) * 0.2).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)
        self.hidden = hidden

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray):
        """x, mask: (time, pages, ...) in reading order of this way. Padding keeps the state."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, pre = h, x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        out, kept = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ self.p[f"h{way}"]
            g = _sigmoid(z[:, : 3 * n])
            i, f, o, u = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(z[:, 3 * n :])
            new = f * c + i * u
            tc = np.tanh(new)
            m = mask[t][:, None]
            kept.append((h, c, i, f, o, u, tc))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        hf, kf = self._run("f", x, mask)
        hb, kb = self._run("b", x[::-1], mask[::-1])
        both = np.concatenate([hf, hb[::-1]], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"])[..., 0], (both, kf, kb)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        p, (both, kf, kb) = self.forward(x, mask)
        count = max(1, mask.sum())
        d = ((p - y) * mask / count)[..., None].astype(np.float32)
        g = {"o": both.reshape(-1, both.shape[2]).T @ d.reshape(-1, 1), "ob": d.sum(axis=(0, 1))}
        dh = d @ self.p["o"].T
        n = self.hidden
        for way, kept, up, xs, ms in (("f", kf, dh[..., :n], x, mask), ("b", kb, dh[::-1, :, n:], x[::-1], mask[::-1])):
            nh, nc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            dz_all, hs = np.zeros((*x.shape[:2], 4 * n), np.float32), np.zeros((*x.shape[:2], n), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                h, c, i, f, o, u, tc = kept[t]
                m = ms[t][:, None]
                total = up[t] + nh
                a = np.where(m, total, 0)
                dc = np.where(m, nc, 0) + a * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), a * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dz_all[t], hs[t] = dz, h
                nh = np.where(m, 0, total) + dz @ self.p[f"h{way}"].T
                nc = np.where(m, dc * f, nc)
            flat = dz_all.reshape(-1, 4 * n)
            g[f"x{way}"] = xs.reshape(-1, xs.shape[2]).T @ flat
            g[f"h{way}"] = hs.reshape(-1, n).T @ flat
            g[f"c{way}"] = flat.sum(axis=0)
        q = np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1)
        return g, float(-(np.log(q) * mask).sum() / count)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Per page, each block's probability of being main text."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: -len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, CELLS // len(pages[order[at]]))]
            at += len(group)
            x, mask = pad([pages[i] for i in group])
            p, _ = self.forward(x, mask)
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATH + WORDS + MEASURES), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = True
    return x, mask


# ---- training pages


class Writer:
    """Pages of many layouts. What is main text is marked by a character that no page has, and taken out again."""

    MARK = "\ue000"

    def __init__(self, words: list[str], seed: int = 3):
        self.r, self.words = random.Random(seed), words or "the of and to in is that it for was".split()

    def some(self, a: int, b: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        return self.some(3, 22).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def text(self, main: bool, a: int = 1, b: int = 8) -> str:
        return (self.MARK if main else "") + " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def attr(self, *names: str) -> str:
        name = self.r.choice(names)
        if self.r.random() < 0.3:
            name = self.r.choice([f"{name}-wrap", f"site-{name}", f"{name} clearfix", f"{name}_box", f"block {name}"])
        return self.r.choice(['class="%s"', 'class="%s"', 'id="%s"']) % name

    def links(self, a: int = 2, b: int = 9) -> str:
        items = [f'<a href="/{i}">{self.some(1, 3)}</a>' for i in range(self.r.randint(a, b))]
        shape = self.r.choice(["<li>%s</li>", "<li>%s</li>", "<li>%s", "%s | ", "<p>%s</p>", "<div>%s</div>"])
        body = "".join(shape % x for x in items)
        return f"<ul>{body}</ul>" if "li" in shape else body

    def aside(self) -> str:
        """One part that is not main text."""
        r = self.r
        kind = r.choice("nav menu header footer sidebar notice ad ad form comments related share crumbs".split())
        if kind == "nav":
            return f"<nav>{self.links()}</nav>"
        if kind == "menu":
            return f"<div {self.attr('menu', 'nav', 'navbar', 'navigation', 'topbar')}>{self.links()}</div>"
        if kind == "header":
            body = f"<h1>{self.some(1, 3)}</h1><p>{self.some(2, 8)}</p>" if r.random() < 0.4 else f"<div>{self.some(1, 4)}</div>{self.links()}"
            return r.choice([f"<header>{body}</header>", f"<div {self.attr('header', 'masthead', 'banner', 'top')}>{body}</div>"])
        if kind == "footer":
            body = r.choice([f"<p>&copy; 20{r.randint(10, 29)} {self.some(1, 4)}. All rights reserved.</p>", self.text(False, 1, 2), self.links(), f"<p>Copyright {self.some(1, 3)}</p>{self.links()}", f"<p>{self.text(False, 1, 2)}</p>"])
            return r.choice([f"<footer>{body}</footer>", f"<footer>{body}", f"<div {self.attr('footer', 'bottom', 'colophon', 'copyright')}>{body}</div>"])
        if kind == "sidebar":
            body = f"<h3>{self.some(1, 4)}</h3>" + r.choice([self.links(), f"<p>{self.text(False, 1, 3)}</p>"])
            return r.choice([f"<aside>{body}</aside>", f"<div {self.attr('sidebar', 'widget', 'side', 'rail', 'aside')}>{body}</div>"])
        if kind == "notice":
            body = r.choice([f"We use cookies. {self.text(False, 1, 2)}", f"<p>{self.text(False, 1, 3)}</p><button>Accept</button>", self.text(False, 1, 2)])
            return f"<div {self.attr('cookie', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'warning')}>{body}</div>"
        if kind == "ad":
            body = r.choice([self.text(False, 1, 3), self.some(2, 9), f"<p>{self.text(False, 1, 3)}</p>", f'<a href="#">{self.some(2, 6)}</a>'])
            tag = r.choice(["div", "div", "section", "aside", "p"])
            return f"<{tag} {self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'adbox', 'banner')}>{body}</{tag}>"
        if kind == "form":
            return f"<form {self.attr('search', 'login', 'newsletter', 'subscribe', 'signup')}><label>{self.some(1, 4)}</label><input name=q><p>{self.some(2, 12)}</p><button>{self.some(1, 2)}</button></form>"
        if kind == "comments":
            each = "".join(r.choice([f"<li><b>{self.some(1, 2)}</b> says: <p>{self.text(False, 1, 4)}</p></li>", f"<div {self.attr('comment', 'reply', 'comment-body')}><p>{self.text(False, 1, 4)}</p></div>"]) for _ in range(r.randint(1, 5)))
            return r.choice([f"<section {self.attr('comments', 'discussion', 'responses')}><h2>Comments</h2>{each}</section>", f"<div {self.attr('comments', 'comment-list', 'disqus', 'replies', 'reader-comments')}>{each}</div>"])
        if kind == "related":
            return f"<div {self.attr('related', 'recommended', 'more', 'trending', 'teaser', 'popular')}><h3>{self.some(1, 4)}</h3>{self.links()}</div>"
        if kind == "share":
            return f"<div {self.attr('share', 'social', 'follow', 'tags', 'meta')}>{self.links(2, 5)}</div>"
        return f"<div {self.attr('breadcrumb', 'breadcrumbs', 'path')}>" + " &gt; ".join(f'<a href="/">{self.some(1, 2)}</a>' for _ in range(r.randint(2, 4))) + "</div>"

    def part(self) -> str:
        """One part of the main text."""
        r = self.r
        t = lambda a=1, b=8: self.text(True, a, b)
        kind = r.random()
        if kind < 0.55:
            body = t()
            if r.random() < 0.3:
                at = body.find(" ")
                body = body[: at + 1] + r.choice(["<b>%s</b> ", "<i>%s</i> ", '<a href="/x">%s</a> ', "<em>%s</em><br>", "<span class=x>%s</span> "]) % self.some(1, 4) + body[at + 1 :]
            return r.choice(["<p>%s</p>", "<p>%s</p>", "<p>%s</p>", "<p>%s", "<div>%s</div>"]) % body
        if kind < 0.65:
            return f"<p><b>{self.MARK}{self.some(1, 14)}" + r.choice(["<br>", "</b><br>", "</b></p>", ""])
        if kind < 0.75:
            return r.choice(["<h2>%s</h2>", "<h3>%s</h3>", "<h2>%s</h2>"]) % (self.MARK + self.some(1, 9))
        if kind < 0.83:
            items = "".join(f"<li>{self.MARK}{self.some(1, 14)}</li>" for _ in range(r.randint(2, 6)))
            return r.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>"])
        if kind < 0.89:
            return f"<blockquote>{r.choice([t(1, 3), f'<p>{t(1, 3)}</p>'])}</blockquote>"
        if kind < 0.93:
            return f"<pre>{t(1, 3)}</pre>"
        if kind < 0.97:
            rows = "".join("<tr>" + "".join(f"<td>{self.MARK}{self.some(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<figure><img src=x><figcaption>{self.MARK}{self.some(2, 12)}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        parts = [self.part() for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 20]))]
        if r.random() < 0.25:
            parts.insert(r.randrange(len(parts) + 1), self.aside())
        if r.random() < 0.8:
            parts.insert(0, f"<h1>{self.MARK}{self.some(1, 10)}</h1>")
        if r.random() < 0.12:
            parts.append(self.aside())
        body = "".join(parts)
        main = r.random()
        div = lambda *n: f"<div {self.attr(*n)}>"
        if main < 0.45:
            body = f"<article>{body}</article>"
        elif main < 0.55:
            body = f"<main>{body}</main>"
        elif main < 0.63:
            body = f"<main>{div('content', 'page')}<article>{body}</article></div></main>"
        elif main < 0.95:
            body = f"{div('content', 'post', 'entry', 'article', 'story', 'main', 'body', 'text', 'article-body', 'entry-content', 'post-content')}{body}</div>"
        before = "".join(self.aside() for _ in range(r.choice([0, 1, 2, 2, 3])))
        after = "".join(self.aside() for _ in range(r.choice([0, 1, 1, 2, 3])))
        head = f"<!DOCTYPE html><html><head><title>{self.some(1, 9)}</title><style>p{{}}</style></head><body>" if r.random() < 0.9 else ""
        if r.random() < 0.15:
            before, after = f"{div('wrapper', 'container', 'page', 'layout')}{before}", f"{after}</div>"
        return head + before + body + after + ("</body></html>" if r.random() < 0.9 else "")

    def example(self) -> tuple[list[Block], np.ndarray]:
        bs = blocks(self.page())
        y = np.array([self.MARK in b.text for b in bs], np.float32)
        clean = [b._replace(text=b.text.replace(self.MARK, "") or "-") for b in bs]
        return clean, y


def train(words: list[str], pages: int = PAGES, epochs: int = EPOCHS, seed: int = 3) -> Net:
    writer, vectors, net = Writer(words, seed), Vectors(), Net()
    made = [e for e in (writer.example() for _ in range(pages)) if e[0]]
    data = [(vectors.page(b), y) for b, y in made]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = sorted(rng.permutation(len(data)).tolist(), key=lambda i: len(data[i][0]) // 8)
        batches = [order[a : a + 24] for a in range(0, len(order), 24)]
        for k in rng.permutation(len(batches)).tolist():
            x, mask = pad([data[i][0] for i in batches[k]])
            y = np.zeros(mask.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(data[i][1]), j] = data[i][1]
            g, _ = net.gradient(x, mask, y)
            norm = sum(float((v * v).sum()) for v in g.values()) ** 0.5
            step += 1
            for name, v in g.items():
                v = v / max(1.0, norm)
                m[name] += 0.1 * (v - m[name])
                s[name] += 0.01 * (v * v - s[name])
                net.p[name] -= (0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


# ---- operator


def main_texts(net: Net, pages: list[str | None], vectors: Vectors) -> list[str]:
    read = [blocks(p) if p else [] for p in pages]
    marks = net.label([vectors.page(b) for b in read])
    return [" ".join(x.text for x, p in zip(b, ps) if p >= 0.5) for b, ps in zip(read, marks)]


def sample_words(pages: DataFrame, id_col: str, html_col: str, n: int = WORD_PAGES) -> list[str]:
    """Words of n pages, the first by a hash of id and page; long pages give no more than short ones, and all that is collected is
    n * PAGE_RUNS * RUN_WORDS words."""
    id_, page = F.col(f"`{id_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    part = pages.select(page.alias("html"), F.xxhash64(id_, page).alias("h")).filter("html is not null")

    def run(batches):
        for batch in batches:
            for page, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, r = [w for b in blocks(page) for w in b.text.split()], random.Random(h)
                if len(words) > PAGE_RUNS * RUN_WORDS:
                    words = [w for a in sorted(r.randrange(len(words) - RUN_WORDS + 1) for _ in range(PAGE_RUNS)) for w in words[a : a + RUN_WORDS]]
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([words], pa.list_(pa.string()))], ["h", "words"])

    words = likely_first(part, "h", n, part.count()).mapInArrow(run, "h long, words array<string>")
    return [w for r in words.orderBy(F.xxhash64("h"), "h").limit(n).collect() for w in r.words]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    at_most_batches(spark, 8 << 20)
    net = spark.sparkContext.broadcast(train(sample_words(pages, id_col, html_col)))
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches):
        vectors = Vectors()
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                texts = main_texts(net.value, part.column(2).to_pylist(), vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    kept = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return kept.mapInArrow(run, OUT)


def op5_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
