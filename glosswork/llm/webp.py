"""Lossless WebP (VP8L) in numpy: a whole decoder, and an encoder that uses every part of the format.

The decoder reads prefix codes (simple and normal, with groups chosen by a meta
image), back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images are arrays of
32-bit ARGB pixels, height by width. webp_many does the same for many small
images at once.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
#: Near places by their distance, then by column, right before left.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Longest code that this encoder writes; the format allows 15 bits.
LONGEST = 12


class Bits:
    """Reads a stream from its lowest bits."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0
        self.counted = False  # whether the code read last says its own end

    def peek(self, n: int) -> int:
        """At most 32 bits."""
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def span(self, at: int, n: int) -> int:
        """n bits from place `at`, any number of them."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise ValueError("the stream ends early")
        return v


def _used(lengths: tuple[int, ...]) -> tuple[int, ...]:
    """Without the zeros at the end, which change neither codes nor tables: equal codes of different alphabets are then found in the caches."""
    n = len(lengths)
    while n and not lengths[n - 1]:
        n -= 1
    return lengths[:n]


@lru_cache(4096)
def _codewords(lengths: tuple[int, ...]) -> tuple[tuple[int, int, int], ...]:
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out.append((s, n, _turned(code, n)))
        code, last = code + 1, n
    if last and code != 1 << last:
        raise ValueError("a prefix code is not complete")
    return tuple(out)


@lru_cache(1 << 14)
def _turned(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2)


def _canonical(lengths: tuple[int, ...]) -> tuple[tuple[int, int, int], ...]:
    """(symbol, length, code with its bits in the order of the stream) of a complete code."""
    return _codewords(_used(lengths))


@lru_cache(4096)
def _entries(lengths: tuple[int, ...]) -> tuple[int, np.ndarray]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return 0, np.array([(used[0] if used else 0) << 4], "uint32")
    width = max(lengths)
    table = np.zeros(1 << width, "uint32")
    for s, n, c in _canonical(lengths):
        table[c :: 1 << n] = s << 4 | n
    return width, table


def _table(lengths: tuple[int, ...]) -> tuple[int, np.ndarray]:
    """(bits, array from the next bits to symbol << 4 | length). A code of one symbol takes no bits."""
    return _entries(_used(lengths))


@lru_cache(4096)
def _simple(a: int, b: int) -> tuple[int, ...]:
    """The lengths of a code of one or two symbols."""
    return tuple(int(s in (a, b)) for s in range(b + 1))


@lru_cache(512)
def _of_lengths(n: int, low: int, high: int) -> tuple[int, list[int], list[tuple[int, int, int] | None]]:
    """The table of a code of lengths from its n lengths of three bits, the first ten in low; and what the next twelve bits say if they hold two plain lengths: both, and their bits."""
    of, bits = [0] * 19, low | high << 30
    for i, k in enumerate(CODE_LENGTH_ORDER[:n]):
        of[k] = bits >> 3 * i & 7
    width, table = _table(tuple(of))
    mask, table = (1 << width) - 1, table.tolist()
    pairs: list[tuple[int, int, int] | None] = []
    for v in range(4096):
        a = table[v & mask]
        c = table[v >> (a & 15) & mask]
        used = (a & 15) + (c & 15)
        pairs.append((a >> 4, c >> 4, used) if a >> 4 < 16 and c >> 4 < 16 and used <= 12 else None)
    return width, table, pairs


def _read_code(b: Bits, size: int) -> tuple[int, ...]:
    """The code lengths of one prefix code."""
    b.counted = False
    if b.read(1):
        n = b.read(1) + 1
        used = [b.read(8 if b.read(1) else 1)]
        if n > 1:
            used.append(b.read(8))
        if max(used) >= size:
            raise ValueError("a symbol is out of range")
        return _simple(min(used), max(used))
    lengths, n = [0] * size, b.read(4) + 4
    width, table, pairs = _of_lengths(n, b.read(3 * min(n, 10)), b.read(3 * max(n - 10, 0)))
    b.counted = bool(b.read(1))
    left = 2 + b.read(2 + 2 * b.read(3)) if b.counted else size
    # The lengths of the text of one code are at most a few hundred bytes: as one number they are cheap to shift.
    start, k, mask = b.at, 0, (1 << width) - 1
    v, used = int.from_bytes(b.data[start >> 3 : (start >> 3) + 8 + size * 3], "little") >> (start & 7), 0
    while k < size and left:
        two = pairs[v & 4095]
        if two and k + 1 < size and left > 1:
            lengths[k], lengths[k + 1], n = two
            v >>= n
            used += n
            k += 2
            left -= 2
            continue
        left -= 1
        e = table[v & mask]
        s, n = e >> 4, e & 15
        v >>= n
        used += n
        if s < 16:
            lengths[k] = s
            k += 1
            continue
        last = next((x for x in lengths[k - 1 :: -1] if x), 8) if s == 16 and k else 8
        extra, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        times = base + (v & ((1 << extra) - 1))
        v >>= extra
        used += extra
        if k + times > size:
            raise ValueError("code lengths run over")
        lengths[k : k + times] = [value] * times
        k += times
    b.at = start + used
    return tuple(lengths)


def _symbol(b: Bits, code: tuple[int, list[int]]) -> int:
    e = code[1][b.peek(code[0])]
    b.at += e & 15
    return e >> 4


def _amount(b: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + b.read(extra) + 1


def _codes(b: Bits, groups: int, cache: int) -> list[list[tuple[int, ...]]]:
    """The codes of each group. The same bits again are the same code, if they say themselves where they end: then they aren't read twice."""
    sizes = (256 + LENGTH_SYMBOLS + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    out = []
    for _ in range(groups):
        group, start, size, code = [], 0, 0, ()
        for n in sizes:
            if size and len(code) <= n and b.span(b.at, size) == b.span(start, size):
                b.at += size
            else:
                start = b.at
                code = _used(_read_code(b, n))
                # A normal code tells its number of symbols where the bit after its code of lengths is set.
                size = b.at - start if b.counted else 0
            group.append(code)
        out.append(group)
    return out


#: An image of one pixel as five codes of one symbol of eight bits: the bits that are the same in all of them, and their values.
_PIXEL = (1 | sum(0b111 << 1 + 11 * k for k in range(5)), sum(0b101 << 1 + 11 * k for k in range(5)))


def _pixels(b: Bits, w: int, h: int, main: bool, told: list | None = None) -> np.ndarray:
    """An entropy-coded image; only the main one can have groups of codes. told gets the numbers of literals, references and places of the cache."""
    if w == h == 1 and not main and b.span(b.at, 56) & _PIXEL[0] == _PIXEL[1]:  # no cache, five codes of one symbol
        v = b.span(b.at, 56)
        b.at += 56
        green, red, blue, alpha = (v >> 4 + 11 * k & 255 for k in range(4))
        return np.array([[alpha << 24 | red << 16 | green << 8 | blue]], "uint32")
    cache = b.read(4) if b.read(1) else 0
    meta, shift, groups = None, 0, 1
    if main and b.read(1):
        shift = b.read(3) + 2
        side = _blocks(w, shift)
        meta = (_pixels(b, side, _blocks(h, shift), False) >> 8 & 0xFFFF).tolist()
        groups = max(map(max, meta)) + 1
    codes = [[(t[0], t[1].tolist()) for t in map(_table, g)] for g in _codes(b, groups, cache)]
    return _symbols(b, w, h, cache, meta, shift, codes, told)


def _blocks(n: int, shift: int) -> int:
    return (n + (1 << shift) - 1) >> shift


def _symbols(b: Bits, w: int, h: int, cache: int, meta: list | None, shift: int, codes: list, told: list | None = None) -> np.ndarray:
    out, total, kinds = [], w * h, [0, 0, 0]
    kept = [0] * (1 << cache)
    fed = 0  # pixels that the cache has taken
    while len(out) < total:
        n = len(out)
        green, red, blue, alpha, far = codes[meta[n // w >> shift][n % w >> shift] if meta else 0]
        s = _symbol(b, green)
        kinds[(s >= 256) + (s >= 256 + LENGTH_SYMBOLS)] += 1
        if s < 256:
            r, u = _symbol(b, red), _symbol(b, blue)
            out.append(_symbol(b, alpha) << 24 | r << 16 | s << 8 | u)
        elif s < 256 + LENGTH_SYMBOLS:
            length = _amount(b, s - 256)
            d = _amount(b, _symbol(b, far))
            d = d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * w)
            if d > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            piece = out[n - d : n - d + length]
            out += (piece * (length // d + 1))[:length] if d < length else piece
        else:
            for p in out[fed:]:
                kept[CACHE_MULTIPLIER * p % (1 << 32) >> 32 - cache] = p
            fed = n
            out.append(kept[s - 256 - LENGTH_SYMBOLS])
    if b.at > 8 * (len(b.data) - 8):
        raise ValueError("the stream ends early")
    if told is not None:
        told += kinds
    return np.array(out, "uint32").reshape(h, w)


def _split(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype("int32")


def _merge(c: np.ndarray) -> np.ndarray:
    c = c.astype("uint32") & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, corner, right):
    """The prediction of a pixel (channels last) from its neighbours; right is the one above and to the right."""
    mean = lambda x, y: (x + y) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return mean(mean(left, right), top)
        case 6:
            return mean(left, corner)
        case 7:
            return mean(left, top)
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, right)
        case 10:
            return mean(mean(left, corner), mean(top, right))
        case 11:
            nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
            return np.where(nearer, left, top)
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            m = mean(left, top)
            half = np.abs(m - corner) >> 1
            return np.clip(np.where(m >= corner, m + half, m - half), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], "int32"), left.shape)


def _neighbours(c: np.ndarray, y: int, x: int) -> tuple:
    h, w, _ = c.shape
    right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
    return c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right


def _mode(modes: np.ndarray, shift: int, y: int, x: int) -> int:
    if y == 0:
        return 1 if x else 0
    return 2 if x == 0 else int(modes[y >> shift, x >> shift] >> 8 & 15)


def _predictor(p: np.ndarray, modes: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts the predictions, which always come from whole pixels."""
    c = _split(p)
    done = c.copy()
    whole = done if undo else c
    for y in range(c.shape[0]):
        for x in range(c.shape[1]):
            m = _mode(modes, shift, y, x)
            around = _neighbours(whole, y, x) if y and x else (whole[y, x - 1], whole[y - 1, x], whole[y - 1, x], whole[y - 1, x])
            guess = predicted(m, *around)
            done[y, x] = (c[y, x] + guess if undo else c[y, x] - guess) & 255
    return _merge(done)


def _cross(p: np.ndarray, data: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    c = _split(p)
    h, w = p.shape
    t = _split(data)[np.arange(h)[:, None] >> shift, np.arange(w)[None] >> shift].astype("int8").astype("int32")
    signed = lambda v: (v & 255).astype("uint8").astype("int8").astype("int32")
    part = lambda k, v: t[..., k] * signed(v) >> 5
    red = c[..., 1] + (1 if undo else -1) * part(3, c[..., 2])
    whole = red if undo else c[..., 1]
    blue = c[..., 3] + (1 if undo else -1) * (part(2, c[..., 2]) + part(1, whole))
    return _merge(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def _green(p: np.ndarray, undo: bool) -> np.ndarray:
    c = _split(p)
    sign = 1 if undo else -1
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _merge(c)


def _pack_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpalette(p: np.ndarray, table: np.ndarray, w: int) -> np.ndarray:
    bits = _pack_bits(len(table))
    each = 8 >> bits
    green = p >> 8 & 255
    index = np.stack([green >> (each * k) & ((1 << each) - 1) for k in range(1 << bits)], -1).reshape(len(p), -1)[:, :w]
    return np.append(table, np.zeros(256, "uint32"))[index]


def _open(data: bytes) -> bytes:
    """The VP8L chunk of a simple file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless file")
    return data[20 : 20 + struct.unpack("<I", data[16:20])[0]]


def _head(b: Bits) -> tuple[int, int]:
    if b.read(8) != 0x2F:
        raise ValueError("no signature")
    w, h = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    return w, h


def _transforms(b: Bits, w: int, h: int) -> tuple[list, int]:
    """What to undo, in the order of the stream, and the width that remains."""
    found = []
    while b.read(1):
        kind = b.read(2)
        if kind in (x[0] for x in found):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS):
            shift = b.read(3) + 2
            found.append((kind, _pixels(b, _blocks(w, shift), _blocks(h, shift), False), shift))
        elif kind == GREEN:
            found.append((kind,))
        else:
            size = b.read(8) + 1
            table = _merge(np.cumsum(_split(_pixels(b, size, 1, False)[0]), axis=0))
            found.append((kind, table, w))
            w = _blocks(w, _pack_bits(size))
    return found, w


def _undo(p: np.ndarray, found: list) -> np.ndarray:
    for kind, *x in reversed(found):
        if kind == PREDICTOR:
            p = _predictor(p, *x, True)
        elif kind == CROSS:
            p = _cross(p, *x, True)
        elif kind == GREEN:
            p = _green(p, True)
        else:
            p = _unpalette(p, *x)
    return p


def told(data: bytes) -> tuple[list[int], list[int]]:
    """(kinds of the transforms, numbers of literals, references and places of the cache) of a file."""
    b, kinds = Bits(_open(data)), []
    found, inner = _transforms(b, *(size := _head(b)))
    _pixels(b, inner, size[1], True, kinds)
    return [f[0] for f in found], kinds


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless file."""
    b = Bits(_open(data))
    w, h = _head(b)
    found, inner = _transforms(b, w, h)
    return _undo(_pixels(b, inner, h, True), found)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> list[int]:
    """Lengths of a complete prefix code: those of the shares, rounded up, then shortened until no code is left over."""
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out = [0] * len(counts)
        out[int(used[0])] = 1
        return out
    n = counts[used].astype("float64")
    want = np.clip(np.ceil(np.log2(n.sum() / n)), 1, longest).astype(int)
    order, ls = np.argsort(-n, kind="stable").tolist(), want.tolist()
    room = (1 << longest) - sum(1 << (longest - x) for x in ls)
    while room < 0:  # the clip asked for too much: the rarest that can get longer do
        i = max((i for i in order if ls[i] < longest), key=lambda i: (ls[i], -n[i]))
        room += 1 << (longest - ls[i] - 1)
        ls[i] += 1
    while room:
        for i in order:
            if ls[i] > 1 and 1 << (longest - ls[i]) <= room:
                room -= 1 << (longest - ls[i])
                ls[i] -= 1
    out = [0] * len(counts)
    for s, x in zip(used.tolist(), ls, strict=True):
        out[s] = x
    return out


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


@lru_cache(256)
def _code_bits(lengths: tuple[int, ...]) -> tuple[int, int]:
    """A prefix code, without zeros at its end, as written in the stream: (bits, how many). It says how many lengths it has."""
    w = Writer()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return w.value, w.size
    # Runs: (symbol of the code of lengths, extra bits' value, their number).
    runs, k, total = [], 0, len(lengths)
    while k < total:
        n, end = lengths[k], k + 1
        while end < total and lengths[end] == n:
            end += 1
        run, again = end - k, False
        k = end
        while run:
            if n == 0 and run >= 3:
                t = min(run, 138)
                runs.append((18, t - 11, 7) if t >= 11 else (17, t - 3, 3))
            elif n and again and run >= 3:
                t = min(run, 6)
                runs.append((16, t - 3, 2))
            else:
                t, again = 1, True
                runs.append((n, 0, 0))
            run -= t
    of = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    if sum(map(bool, of)) == 1:  # a code of one symbol: a second one makes it complete
        of[next(s for s in range(19) if not of[s])] = 1
    w.put(0, 1)
    last = max(i for i, k in enumerate(CODE_LENGTH_ORDER) if of[k] or i < 4)
    w.put(last + 1 - 4, 4)
    for k in CODE_LENGTH_ORDER[: last + 1]:
        w.put(of[k], 3)
    more = len(runs) - 2
    wide = max(0, (more.bit_length() - 1) // 2)
    w.put(1, 1)
    w.put(wide, 3)
    w.put(more, 2 + 2 * wide)
    bits = {s: (c, n) for s, n, c in _canonical(tuple(of))}
    value, size = w.value, w.size
    for s, extra, n in runs:
        c, m = bits[s]
        value |= (c | extra << m) << size
        size += m + n
    return value, size


def _put_codes(w: Writer, codes: list[list[int]]) -> list[dict[int, tuple[int, int]]]:
    out = []
    for lengths in codes:
        w.put(*_code_bits(_used(tuple(lengths))))
        one = sum(map(bool, lengths)) <= 1
        out.append({} if one else {s: (c, n) for s, n, c in _canonical(tuple(lengths))})
    return out


def _prefix(v: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of an amount of at least 1."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def _tokens(p: list[int], w: int, lz: bool, cache: int) -> list[tuple]:
    """Pixels as literals ('p', argb), references ('r', length, code of the distance) and places of the cache ('c', place)."""
    near = {}
    for k, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * w), k + 1)
    out, seen, kept, k = [], {}, [None] * (1 << cache), 0
    place = lambda v: CACHE_MULTIPLIER * v % (1 << 32) >> 32 - cache
    while k < len(p):
        best, back = 0, 0
        key = tuple(p[k : k + 3])
        if lz and len(key) == 3 and key in seen:
            a = seen[key]
            while k + best < len(p) and best < 4096 and p[a + best] == p[k + best]:
                best += 1
            back = k - a
        if best >= 3:
            out.append(("r", best, near.get(back, back + 120)))
        elif cache and kept[place(p[k])] == p[k]:
            best = 1
            out.append(("c", place(p[k])))
        else:
            best = 1
            out.append(("p", p[k]))
        for i in range(k, k + best):
            seen[tuple(p[i : i + 3])] = i
            if cache:
                kept[place(p[i])] = p[i]
        k += best
    return out


def _put_pixels(w: Writer, p: np.ndarray, main: bool = False, lz: bool = False, cache: int = 0, shift: int = 0) -> None:
    """An entropy-coded image; shift: the main image gets two groups of codes in a chequer of blocks of that size."""
    h, width = p.shape
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    groups = np.zeros((h, width), int)
    if main:
        w.put(1 if shift else 0, 1)
        if shift:
            chequer = np.indices((_blocks(h, shift), _blocks(width, shift))).sum(0) % 2
            w.put(shift - 2, 3)
            _put_pixels(w, (chequer << 8).astype("uint32"))
            groups = chequer[np.arange(h)[:, None] >> shift, np.arange(width)[None] >> shift]
    groups = groups.ravel().tolist()
    tokens = _tokens(p.ravel().tolist(), width, lz, cache)
    n = max(groups) + 1
    counts = [[np.zeros(s, int) for s in (256 + LENGTH_SYMBOLS + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_SYMBOLS)] for _ in range(n)]
    plan, at = [], 0
    for t in tokens:
        g = groups[at]
        if t[0] == "p":
            a, r, gr, b = t[1] >> 24, t[1] >> 16 & 255, t[1] >> 8 & 255, t[1] & 255
            steps = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif t[0] == "r":
            x, y = _prefix(t[1]), _prefix(t[2])
            steps = [(0, 256 + x[0], x[1], x[2]), (4, y[0], y[1], y[2])]
        else:
            steps = [(0, 256 + LENGTH_SYMBOLS + t[1], 0, 0)]
        for c, s, _, _ in steps:
            counts[g][c][s] += 1
        plan.append((g, steps))
        at += t[1] if t[0] == "r" else 1
    codes = [_put_codes(w, [code_lengths(c) if c.any() else [0] * len(c) for c in g]) for g in counts]
    for g, steps in plan:
        for c, s, extra, bits in steps:
            w.put(*codes[g][c].get(s, (0, 0)))
            w.put(extra, bits)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _start(width: int, height: int, alpha: bool = False) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 4)
    return w


def encode(p: np.ndarray, palette: bool = False, predictor: int = 0, cross: int = 0, green: bool = False, lz: bool = True, cache: int = 0, groups: int = 0, seed: int = 0) -> bytes:
    """A file of the ARGB pixels p. predictor, cross and groups are block sizes as powers of two (2 to 9), 0 for none.

    Each block of the predictor takes the mode of a random choice by seed, so that all get used; cross-colour likewise.
    """
    h, width = p.shape
    rng, w = np.random.default_rng(seed), _start(width, h, bool((p >> 24 != 255).any()))
    if palette:
        colours, index = np.unique(p, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        steps = np.diff(_split(colours), axis=0, prepend=0)
        _put_pixels(w, _merge(steps)[None])
        bits = _pack_bits(len(colours))
        index = np.pad(index.reshape(h, width).astype("uint32"), ((0, 0), (0, -width % (1 << bits))))
        p = np.full((h, _blocks(width, bits)), 255 << 24, "uint32")
        for k in range(1 << bits):
            p |= index[:, k :: 1 << bits] << np.uint32(8 + (8 >> bits) * k)
    for size, kind in ((predictor, PREDICTOR), (cross, CROSS)):
        if size:
            shape = (_blocks(p.shape[0], size), _blocks(p.shape[1], size))
            data = (rng.integers(0, 14, shape) << 8 if kind == PREDICTOR else rng.integers(0, 1 << 24, shape)).astype("uint32") | np.uint32(255 << 24)
            w.put(1 | kind << 1, 3)
            w.put(size - 2, 3)
            _put_pixels(w, data)
            p = (_predictor if kind == PREDICTOR else _cross)(p, data, size, False)
    if green:
        w.put(1 | GREEN << 1, 3)
        p = _green(p, False)
    w.put(0, 1)
    _put_pixels(w, p, True, lz, cache, groups)
    return _file(w.bytes())

