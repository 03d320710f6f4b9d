"""Lossless WebP (VP8L), from the public bitstream specification: a full decoder and an encoder, in numpy.

decode() reads any VP8L stream: prefix codes (simple and normal), meta prefix images, back-references, colour
cache, and the inverse predictor, cross-colour, subtract-green and palette transforms. Where only green takes
bits (one prefix group, no cache), streams are decoded without a loop per bit: code lengths are looked up at all
bit positions at once, and a short chain of jumps over up to four literals each gives where the codes begin; a
jump ends at a back-reference, which is read by itself.

encode_grey() writes 8-bit samples and stores the smallest of literals, literals with back-references, and, for
16 values at most, the palette transform with packed pixels. With red, blue and alpha fixed, a hit in the colour
cache costs a code as a literal does, and the cross-colour and subtract-green transforms have nothing to remove;
the predictor and several prefix groups are not tried, as neighbouring bytes of text are not alike. encode() writes any image with what its caller asks for.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

MAX_SIDE = 1 << 14
#: Order in which the lengths of the code length code are stored (fixed values of the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
NAMES = ("predictor", "cross-colour", "subtract-green", "palette")
#: Bytes that must be equal for a back-reference, its greatest length and greatest distance (the last two of the format).
LEAST_COPY, MOST_COPY, FARTHEST = 24, 4096, (1 << 20) - 120
HASH = 0x1E35A7BD
#: Distance codes 1 to 120 name near pixels (x left, y up), by distance, then by |x|, right of it first.
NEAR = sorted([(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_REV = np.array([int(f"{i:012b}"[::-1], 2) for i in range(1 << 12)], np.uint32)


# ---- bits


class Reader:
    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        p = self.pos
        self.pos = p + n
        v = int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little")
        return (v >> (p & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        p = self.pos
        return (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


# ---- prefix codes


def code_lengths(counts: np.ndarray, limit: int = 12) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are levelled until no length is over limit. One symbol: length 0 throughout."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        return out
    c = counts[used].tolist()
    while True:
        heap = [(v, i) for i, v in enumerate(c)]
        heapq.heapify(heap)
        up = [0] * (2 * len(c) - 1)
        k = len(c)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            up[a[1]] = up[b[1]] = k
            heapq.heapreplace(heap, (a[0] + b[0], k))
            k += 1
        depth = [0] * k
        for i in range(k - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(c)]) <= limit:
            out[used] = depth[: len(c)]
            return out
        c = [(v >> 1) | 1 for v in c]


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed as they are stored."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint32)
    if not len(used):
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    ls = lengths[used].astype(np.int64)
    steps = np.int64(1) << (15 - ls)
    first = (np.cumsum(steps) - steps) >> (15 - ls)
    if ls[-1] <= 12:
        out[used] = _REV[first] >> (12 - ls).astype(np.uint32)
        return out
    for s, v, n in zip(used.tolist(), first.tolist(), ls.tolist()):
        out[s] = int(f"{v:0{n}b}"[::-1], 2)
    return out


class Code:
    """Decoding tables by the next max_len bits; one symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        used = np.flatnonzero(lengths)
        if only is None and len(used) == 1:
            only = int(used[0])
        self.only, self.bits = only, 0
        if only is not None:
            self.top = only
            return
        if not len(used):
            raise ValueError("empty prefix code")
        self.top = int(used[-1])
        self.bits = b = int(lengths.max())
        if (np.int64(1) << (b - lengths[used])).sum() != 1 << b:
            raise ValueError("prefix code is not complete")
        rank = used[np.argsort(lengths[used], kind="stable")]
        n = np.int64(1) << (b - lengths[rank])
        sym, ln = np.repeat(rank, n).astype(np.uint16), np.repeat(lengths[rank], n).astype(np.uint8)
        i = np.arange(1 << b, dtype=np.uint32)
        rev = _REV[i] >> np.uint32(12 - b) if b <= 12 else np.array([int(f"{x:0{b}b}"[::-1], 2) for x in range(1 << b)])
        self.sym, self.len = sym[rev], ln[rev]

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        at = r.peek(self.bits)
        r.pos += int(self.len[at])
        return int(self.sym[at])


#: Extra bits and least run of the code length tokens 16 to 18 (fixed values of the format).
_RUNS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}


@functools.lru_cache(64)
def _length_code(packed: int, k: int) -> tuple[int, list, list]:
    """Bits, symbols and lengths of the code length code, whose k lengths stand in 3 bits each."""
    cl = np.zeros(19, np.int64)
    for i in range(k):
        cl[LENGTH_ORDER[i]] = (packed >> 3 * i) & 7
    code = Code(cl)
    return (0, [code.only], [0]) if code.only is not None else (code.bits, code.sym.tolist(), code.len.tolist())


def read_code(r: Reader, size: int) -> Code:
    if r.read(1):  # simple
        two, wide = r.read(1), r.read(1)
        a = r.read(8 if wide else 1)
        if not two:
            return Code(np.zeros(1, np.int64), a)
        b = r.read(8)
        ls = np.zeros(max(size, 256), np.int64)
        ls[a] = ls[b] = 1
        return Code(ls)
    k = 4 + r.read(4)
    bits, syms, lens = _length_code(r.read(3 * k), k)
    left = size
    if r.read(1):
        n = 2 + 2 * r.read(3)
        left = 2 + r.read(n)
    p = r.pos
    v = int.from_bytes(r.data[p >> 3 : (p + 14 * size + 7) >> 3], "little") >> (p & 7)  # no token takes more than 14 bits
    mask = (1 << bits) - 1
    ls, i, last = [0] * size, 0, 8
    while i < size and left:
        left -= 1
        s, n = syms[v & mask], lens[v & mask]
        if s < 16:
            ls[i] = s
            i += 1
            last = s or last
        else:
            extra, run = _RUNS[s]
            run += (v >> n) & ((1 << extra) - 1)
            if i + run > size:
                raise ValueError("too many code lengths")
            if s == 16:
                ls[i : i + run] = [last] * run
            i += run
            n += extra
        v >>= n
        p += n
    r.pos = p
    return Code(np.array(ls, np.int64))


def write_code(w: Writer, lengths: np.ndarray, counts: np.ndarray) -> None:
    """As a simple code for one or two symbols under 256, else by 4-bit tokens: lengths 0 to 12 and the three runs."""
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        w.put(used[0], 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(0 if s in (13, 14, 15) else 4, 3)
    w.put(0, 1)
    rank = {s: int(_REV[i]) >> 8 for i, s in enumerate([*range(13), 16, 17, 18])}
    ls, i, n = lengths.tolist(), 0, len(lengths)
    if len(used) == 1:
        ls[used[0]] = 1
    while i < n:
        j = i
        while j < n and ls[j] == ls[i]:
            j += 1
        run = j - i
        if ls[i] == 0:
            while run >= 3:
                k = min(run, 138)
                if k >= 11:
                    w.put(rank[18] | (k - 11) << 4, 11)
                else:
                    w.put(rank[17] | (k - 3) << 4, 7)
                run -= k
            for _ in range(run):
                w.put(rank[0], 4)
        else:
            w.put(rank[ls[i]], 4)
            run -= 1
            while run >= 3:
                k = min(run, 6)
                w.put(rank[16] | (k - 3) << 4, 6)
                run -= k
            for _ in range(run):
                w.put(rank[ls[i]], 4)
        i = j


# ---- pixels


def _greens(r: Reader, group: list[Code], n: int, width: int, info: dict) -> np.ndarray:
    """n pixels of one prefix group without cache, of which only green and back-references take bits."""
    g = group[0]
    rest = (group[3].only << 24) | (group[1].only << 16) | group[2].only
    if g.only is not None:
        if g.only > 255:
            raise ValueError("bad back-reference")
        return np.full(n, rest | g.only << 8, np.uint32)
    b = np.frombuffer(r.data, np.uint8, offset=r.pos >> 3)
    v = np.zeros(len(b) + 26, np.uint32)
    v[: len(b)] = b
    v[:-2] |= (v[1:-1] << np.uint32(8)) | (v[2:] << np.uint32(16)) & np.uint32(0xFF0000)
    m = 8 * (len(v) - 2)  # bit positions; 24 bytes more than there are
    at = np.empty((len(v) - 2, 8), np.uint16)
    mask = np.uint32((1 << g.bits) - 1)
    for k in range(8):
        at[:, k] = (v[:-2] >> np.uint32(k)) & mask
    at = at.ravel()
    literal = np.where(g.sym < 256, g.len, 0).astype(np.uint8)  # a back-reference takes no step
    one = literal.take(at)
    m -= 64
    where = np.arange(m, dtype=np.int32 if m < 1 << 30 else np.int64)
    two = one[:m] + one.take(where + one[:m])
    m -= 32
    four = (two[:m] + two.take(where[:m] + two[:m])).tobytes()
    base, p, starts, refs, total, literals = r.pos & ~7, r.pos & 7, [], [], 0, 0
    add = starts.append
    try:
        while total < n:
            steps = len(starts)
            for _ in range((n - total + 3) >> 2):
                d = four[p]
                if not d:
                    break
                add(p)
                p += d
            if len(starts) > steps:
                last, q = 0, starts[-1]
                while last < 4 and one[q]:
                    q += int(one[q])
                    last += 1
                more = 4 * (len(starts) - steps - 1) + last
                total += more
                literals += more
                if total >= n:
                    break
            r.pos = base + p
            s = g.read(r)
            if s < 256:
                raise ValueError("the stream ends too early")
            length = _value(r, s - 256)
            d = _distance(r, group[4], width)
            if d > total or total + length > n or r.pos > 8 * len(r.data):
                raise ValueError("bad back-reference")
            refs.append((total, length, d))
            total += length
            p = r.pos - base
    except IndexError:
        raise ValueError("the stream ends too early") from None
    need = n - sum(x[1] for x in refs)
    first = np.array(starts, np.int64)
    at_ = np.empty((len(first), 4), np.int64)
    at_[:, 0] = first
    at_[:, 1] = first + one[first]
    third = first + two[first]
    at_[:, 2] = third
    at_[:, 3] = third + one[third]
    at_ = at_.ravel()
    if refs:
        at_ = at_[one[at_] > 0]
    at_ = at_[:need]
    if not refs or refs[-1][0] + refs[-1][1] < n:
        p = int(at_[-1]) + int(one[at_[-1]])
    r.pos = base + p
    if r.pos > 8 * len(r.data):
        raise ValueError("the stream ends too early")
    green = g.sym[at[at_]].astype(np.uint8)
    if refs:
        info["copies"] = info.get("copies", 0) + len(refs)
        lits, green, done, i = green, np.empty(n, np.uint8), 0, 0
        for start, length, d in refs:
            green[i:start] = lits[done : done + start - i]
            done += start - i
            i = start + length
            green[start:i] = green[start - d : i - d] if length <= d else np.resize(green[start - d : start], length)
        green[i:] = lits[done:]
    return np.uint32(rest) | green.astype(np.uint32) << np.uint32(8)


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _distance(r: Reader, code: Code, width: int) -> int:
    d = _value(r, code.read(r))
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def read_image(r: Reader, width: int, height: int, main: bool = False, info: dict | None = None) -> np.ndarray:
    """An entropy-coded image as a flat array of ARGB. info counts what the stream used."""
    info = {} if info is None else info
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    meta, shift, groups = None, 0, 1
    if main and r.read(1):
        shift = r.read(3) + 2
        mw = -(-width >> shift)
        meta = (read_image(r, mw, -(-height >> shift)) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (280 + cache_size, 256, 256, 256, 40)
    code = [[read_code(r, s) for s in sizes] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in code[0][1:4]):
        return _greens(r, code[0], n, width, info)
    out, cache, todo = [0] * n, [0] * cache_size, 0
    i = 0
    g = code[0]
    while i < n:
        if meta is not None:
            g = code[int(meta[((i // width) >> shift) * mw + ((i % width) >> shift)])]
        s = g[0].read(r)
        if s < 256:
            red, blue, alpha = g[1].read(r), g[2].read(r), g[3].read(r)
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = _value(r, s - 256)
            d = _distance(r, g[4], width)
            if d > i or i + length > n:
                raise ValueError("bad back-reference")
            info["copies"] = info.get("copies", 0) + 1
            for k in range(i, i + length):
                out[k] = out[k - d]
            i += length
        else:
            out[i] = cache[s - 280]
            i += 1
            info["cached"] = info.get("cached", 0) + 1
        if cache_size:
            for k in range(todo, i):
                cache[(HASH * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
            todo = i
    if r.pos > 8 * len(r.data):
        raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


# ---- transforms


def _split(px):
    return [((px >> s) & 0xFF).astype(np.int64) for s in (24, 16, 8, 0)]


def _join(a, r, g, b):
    return ((a & 0xFF) << 24 | (r & 0xFF) << 16 | (g & 0xFF) << 8 | (b & 0xFF)).astype(np.uint32)


def predict(mode: int, l: tuple, t: tuple, tr: tuple, tl: tuple) -> tuple:
    """The predicted pixel, as four components, by one of the 14 modes."""
    avg = lambda p, q: tuple((x + y) >> 1 for x, y in zip(p, q))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return l
    if mode == 2:
        return t
    if mode == 3:
        return tr
    if mode == 4:
        return tl
    if mode == 5:
        return avg(avg(l, tr), t)
    if mode == 6:
        return avg(l, tl)
    if mode == 7:
        return avg(l, t)
    if mode == 8:
        return avg(tl, t)
    if mode == 9:
        return avg(t, tr)
    if mode == 10:
        return avg(avg(l, tl), avg(t, tr))
    if mode == 11:
        to_l = sum(abs(y - z) for y, z in zip(t, tl))  # |L + T - TL - L|
        to_t = sum(abs(x - z) for x, z in zip(l, tl))
        return l if to_l < to_t else t
    if mode == 12:
        return tuple(clamp(x + y - z) for x, y, z in zip(l, t, tl))
    if mode == 13:
        return tuple(clamp(m + int((m - z) / 2)) for m, z in zip(avg(l, t), tl))
    return (255, 0, 0, 0)


def _predicted(px: np.ndarray, modes: np.ndarray, bits: int, width: int, height: int, forward: bool) -> np.ndarray:
    """Inverts the predictor transform, or applies it (forward)."""
    quad = lambda v: (v >> 24, (v >> 16) & 255, (v >> 8) & 255, v & 255)
    src = [quad(v) for v in px.tolist()]
    done = src if forward else [None] * len(src)
    out = [None] * len(src)
    bw = -(-width >> bits)
    for i, v in enumerate(src):
        y, x = divmod(i, width)
        if not i:
            p = (255, 0, 0, 0)
        elif not y:
            p = done[i - 1]
        elif not x:
            p = done[i - width]
        else:
            # right of the last pixel of a row stands the first pixel of this row
            p = predict(int(modes[(y >> bits) * bw + (x >> bits)]), done[i - 1], done[i - width], done[i - width + 1], done[i - width - 1])
        out[i] = tuple(((a - b) if forward else (a + b)) & 255 for a, b in zip(v, p))
        if not forward:
            done[i] = out[i]
    return np.array([a << 24 | r << 16 | g << 8 | b for a, r, g, b in out], np.uint32)


def _cross(px: np.ndarray, by: np.ndarray, bits: int, width: int, height: int, forward: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    _, r2b, g2b, g2r = _split(by[(y >> bits) * -(-width >> bits) + (x >> bits)])
    a, r, g, b = _split(px)
    sign = lambda v: (v ^ 128) - 128
    delta = lambda t, c: (sign(t) * sign(c)) >> 5
    if forward:
        return _join(a, r - delta(g2r, g), g, b - delta(g2b, g) - delta(r2b, r))
    r = (r + delta(g2r, g)) & 255
    return _join(a, r, g, b + delta(g2b, g) + delta(r2b, r))


def _packing(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpalette(px: np.ndarray, colours: np.ndarray, width: int, height: int) -> np.ndarray:
    bits = _packing(len(colours))
    index = ((px >> 8) & 255).reshape(height, -1)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width]
    all_ = np.zeros(256, np.uint32)
    all_[: len(colours)] = colours
    return all_[index].ravel()


def decode(data: bytes, info: dict | None = None) -> np.ndarray:
    """The pixels (height, width) as ARGB. Raises ValueError for what is not a valid stream.

    info, if given, takes what the stream used: transforms (a list of names), and the numbers of copies and of
    cached pixels in the main image where there are any.
    """
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    r = Reader(data[20 : 20 + size])
    if len(r.data) < size or r.read(8) != 0x2F:
        raise ValueError("bad signature or size")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, seen, w = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = r.read(3) + 2
            undo.append((kind, w, bits, read_image(r, -(-w >> bits), -(-height >> bits))))
        elif kind == GREEN:
            undo.append((kind, w, 0, None))
        else:
            n = r.read(8) + 1
            table = _split(read_image(r, n, 1))
            undo.append((kind, w, 0, _join(*[np.cumsum(c) for c in table])))
            w = -(-w >> _packing(n))
    if info is not None:
        info["transforms"] = [NAMES[x[0]] for x in undo]
    px = read_image(r, w, height, main=True, info=info)
    for kind, w, bits, by in reversed(undo):
        if kind == PREDICTOR:
            px = _predicted(px, (by >> 8) & 15, bits, w, height, False)
        elif kind == CROSS:
            px = _cross(px, by, bits, w, height, False)
        elif kind == GREEN:
            a, red, g, b = _split(px)
            px = _join(a, red + g, g, b + g)
        else:
            px = _unpalette(px, by, w, height)
    return px.reshape(height, width)


# ---- writing


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix, number of extra bits and their value, of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), extra, v & ((1 << extra) - 1)


def write_image(w: Writer, px: np.ndarray, width: int, cache_bits: int = 0, copies: bool = False, main: bool = False) -> None:
    """A flat ARGB array; copies: looks for back-references (greedy, for tests)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    values = px.tolist()
    tokens: list[tuple] = []
    cache, seen, i = {}, {}, 0
    while i < len(values):
        run, d = 0, 0
        if copies and i + 3 <= len(values) and (j := seen.get(tuple(values[i : i + 3]))) is not None:
            d = i - j
            while i + run < len(values) and run < 4096 and values[i + run] == values[i + run - d]:
                run += 1
        v = values[i]
        if run >= 3:
            near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
            tokens.append(("copy", *_prefix(run), *_prefix(near.get(d, d + 120))))
        elif cache_bits and cache.get((HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)) == v:
            tokens.append(("cache", (HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)))
            run = 1
        else:
            tokens.append(("px", v))
            run = 1
        for k in range(i, i + run):
            seen[tuple(values[k : k + 3])] = k
            if cache_bits:
                cache[(HASH * values[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[k]
        i += run
    counts = [np.zeros(s, np.int64) for s in sizes]
    for t in tokens:
        if t[0] == "px":
            for k, s in enumerate((8, 16, 0, 24)):
                counts[k][(t[1] >> s) & 255] += 1
        elif t[0] == "cache":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + t[1]] += 1
            counts[4][t[4]] += 1
    ls = [code_lengths(c) for c in counts]
    cs = [codes(x) for x in ls]
    for x, c in zip(ls, counts):
        write_code(w, x, c)
    put = lambda k, s: w.put(int(cs[k][s]), int(ls[k][s]))
    for t in tokens:
        if t[0] == "px":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, (t[1] >> s) & 255)
        elif t[0] == "cache":
            put(0, 280 + t[1])
        else:
            put(0, 256 + t[1])
            w.put(t[3], t[2])
            put(4, t[4])
            w.put(t[6], t[5])


def _file(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _header(w: Writer, width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("bad size")
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = False) -> bytes:
    """Any ARGB image. transforms, in the order in which they are applied: ("predictor", bits, modes), ("cross", bits, elements), ("green",) or ("palette",)."""
    height, width = pixels.shape
    w, px, now = Writer(), pixels.astype(np.uint32).ravel(), width
    _header(w, width, height)
    for t in transforms:
        w.put(1, 1)
        if t[0] == "predictor":
            _, bits, modes = t
            w.put(PREDICTOR, 2)
            w.put(bits - 2, 3)
            write_image(w, np.asarray(modes, np.uint32) << 8, -(-now >> bits))
            px = _predicted(px, np.asarray(modes), bits, now, height, True)
        elif t[0] == "cross":
            _, bits, by = t
            w.put(CROSS, 2)
            w.put(bits - 2, 3)
            write_image(w, np.asarray(by, np.uint32), -(-now >> bits))
            px = _cross(px, np.asarray(by, np.uint32), bits, now, height, True)
        elif t[0] == "green":
            w.put(GREEN, 2)
            a, r, g, b = _split(px)
            px = _join(a, r - g, g, b - g)
        else:
            w.put(PALETTE, 2)
            colours, index = np.unique(px, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours")
            w.put(len(colours) - 1, 8)
            write_image(w, _join(*[np.diff(c, prepend=0) for c in _split(colours)]), len(colours))
            bits = _packing(len(colours))
            index = index.reshape(height, now).astype(np.uint32)
            if bits:
                index = np.pad(index, ((0, 0), (0, -now % (1 << bits)))).reshape(height, -1, 1 << bits)
                index = (index << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(axis=2).astype(np.uint32)
            now = index.shape[1]
            px = (index << np.uint32(8) | np.uint32(0xFF000000)).ravel()
    w.put(0, 1)
    write_image(w, px, now, cache_bits, copies, main=True)
    return _file(w.bytes())


def find_copies(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance) in order, none overlapping, for repeats of LEAST_COPY bytes or more.

    One position in eight, chosen by a hash of the 8 bytes there, is an anchor. Anchors with equal 24 bytes are found by one
    sort; each refers to the one before it, and the match is extended both ways. All of the samples are searched.
    """
    n = len(flat)
    if n < 2 * LEAST_COPY:
        return []
    v = flat.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | v[k:] << np.uint64(8 * k)
    hashed = v * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(hashed[: n - LEAST_COPY + 1] < np.uint64(1 << 61))
    if len(at) < 2:
        return []
    key = hashed[at] ^ (hashed[at + 8] >> np.uint64(7)) ^ (hashed[at + 16] << np.uint64(9))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    to, of = at[order[same + 1]], at[order[same]]
    ok = (v[to] == v[of]) & (v[to + 8] == v[of + 8]) & (v[to + 16] == v[of + 16]) & (to - of <= FARTHEST)
    to, of = to[ok], of[ok]
    rank = np.argsort(to)
    out, end = [], 0
    for i, j in zip(to[rank].tolist(), of[rank].tolist()):
        if i + LEAST_COPY <= end:
            continue
        d = i - j
        i = max(i, end)
        k = min(i - end, i - d, MOST_COPY)  # backwards, at most to where the last copy ended
        if k:
            differ = np.flatnonzero(flat[i - k : i] != flat[i - k - d : i - d])
            i -= k - int(differ[-1]) - 1 if len(differ) else k
        k = min(MOST_COPY, n - i)
        differ = flat[i : i + k] != flat[i - d : i - d + k]
        first = int(differ.argmax())
        k = first if differ[first] else k
        if k >= LEAST_COPY:
            out.append((i, k, d))
            end = i + k
    return out


@functools.lru_cache(16)
def _near(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _write_greens(w: Writer, flat: np.ndarray, width: int, refs: list[tuple[int, int, int]]) -> bytes:
    """What w holds and then flat as the main image's green channel, opaque, with back-references; no loop over pixels."""
    w.put(0, 2)  # no colour cache or meta image
    literal = flat
    if refs:
        start, length, _ = np.array(refs).T
        step = np.zeros(len(flat) + 1, np.int64)
        step[start] += 1
        step[start + length] -= 1
        here = np.flatnonzero(np.cumsum(step[:-1]) == 0)
        literal = flat[here]
    near = _near(width) if refs else {}
    lengths = [_prefix(x[1]) for x in refs]
    distances = [_prefix(near.get(x[2], x[2] + 120)) for x in refs]
    counts = np.bincount(literal, minlength=280)
    far = np.zeros(40, np.int64)
    for a, b in zip(lengths, distances):
        counts[256 + a[0]] += 1
        far[b[0]] += 1
    ls, dl = code_lengths(counts), code_lengths(far)
    write_code(w, ls, counts)
    for only in (0, 0, 255):
        w.put(0b101, 3)
        w.put(only, 8)
    write_code(w, dl, far)
    head, at = w.bytes(), w.n
    cs, ln = codes(ls).astype(np.uint64), ls[literal]
    c = cs[literal]
    if refs:
        dc = codes(dl)
        parts = [(ls[256 + a[0]], cs[256 + a[0]], a[1], a[2], dl[b[0]], dc[b[0]], b[1], b[2]) for a, b in zip(lengths, distances)]
        parts = np.array([[int(x) for x in p] for p in parts], np.int64).reshape(-1, 2)
        order = np.argsort(np.concatenate([here, np.repeat(start, 4)]), kind="stable")
        ln = np.concatenate([ln, parts[:, 0]])[order]
        c = np.concatenate([c, parts[:, 1].astype(np.uint64)])[order]
    end = np.cumsum(ln) + (at & 7)
    if not ln.any():
        return head
    off = end - ln
    word = off >> 5
    c <<= (off & 31).astype(np.uint64)  # under 50 bits
    new = np.empty(len(word), bool)
    new[0] = True
    np.not_equal(word[1:], word[:-1], out=new[1:])
    first = np.flatnonzero(new)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] = np.add.reduceat(c, first)  # codes share no bit, so sums don't carry
    low = (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low[1:] |= (out[:-1] >> np.uint64(32)).astype(np.uint32)
    body = bytearray(low.tobytes()[: (int(end[-1]) + 7) >> 3])
    if at & 7:
        body[0] |= head[-1]
        head = head[:-1]
    return head + bytes(body)


def encode_grey(samples: np.ndarray) -> bytes:
    """8-bit samples (height, width) in the green channel, opaque: the smallest of literals, back-references and a palette.

    Of equal sizes the first in this order is taken, so equal samples give equal bytes.
    """
    height, width = samples.shape
    flat = samples.ravel()

    def start() -> Writer:
        w = Writer()
        _header(w, width, height)
        return w

    def plain(refs):
        w = start()
        w.put(0, 1)  # no transform
        return _write_greens(w, flat, width, refs)

    best = plain([])
    if refs := find_copies(flat):
        best = min(best, plain(refs), key=len)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    if 1 < len(used) <= 16:
        rank = np.zeros(256, np.uint8)
        rank[used] = np.arange(len(used))
        bits = _packing(len(used))
        index = np.pad(rank[samples], ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
        index = np.bitwise_or.reduce(index << (np.arange(1 << bits, dtype=np.uint8) * np.uint8(8 >> bits)), axis=2)
        w = start()
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(used) - 1, 8)
        deltas = np.diff(used, prepend=0).astype(np.uint32) << np.uint32(8)
        deltas[0] |= np.uint32(0xFF000000)
        write_image(w, deltas, len(used))
        w.put(0, 1)
        packed = index.ravel()
        best = min(best, _write_greens(w, packed, index.shape[1], find_copies(packed)), key=len)
    return _file(best)
