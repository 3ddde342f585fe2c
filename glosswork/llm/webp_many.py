"""Many small lossless WebP images at once, in numpy: every pixel of all of them is worked on side by side.

encode_many writes each image with a predictor (of the thirteen modes that
predict, the one whose residuals are least), subtract-green and cross-colour
(multipliers by least squares), back-references and a colour cache. decode_many
reads one symbol of every image at a time, whatever its kind, and inverts the
transforms of all images together: the predictor along diagonals on which no
pixel needs another.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import webp
from .webp import CACHE_MULTIPLIER, CROSS, DISTANCE_SYMBOLS, GREEN, LENGTH_SYMBOLS, NEAR, PREDICTOR, Bits, Writer

#: Longest code, blocks of 512 pixels (one an image), bits of the colour cache, shortest and longest back-reference.
LONGEST, SIDE, CACHE, LEAST, MOST = 11, 9, 6, 3, 4096
GREENS = 256 + LENGTH_SYMBOLS + (1 << CACHE)
#: A fixed complete code for the lengths of codes: symbols 0 to 11, 17 and 18.
LENGTH_CODE = (4, 6, 6, 5, 4, 3, 3, 3, 3, 4, 4, 4, 0, 0, 0, 0, 0, 4, 4)
#: Lanes that are decoded together.
LANES = 2048


@lru_cache(16)
def _turns(width: int) -> np.ndarray:
    """Each number of `width` bits with its bits turned round."""
    v, out = np.arange(1 << width), np.zeros(1 << width, "int64")
    for k in range(width):
        out |= (v >> k & 1) << (width - 1 - k)
    return out


@lru_cache(1)
def _amounts() -> tuple[np.ndarray, np.ndarray]:
    """Of each prefix of a length or distance: the least amount, and its extra bits."""
    s = np.arange(DISTANCE_SYMBOLS)
    extra = np.where(s < 4, 0, (s - 2) >> 1)
    return np.where(s < 4, s + 1, ((2 + (s & 1)) << extra) + 1), extra


# ---------------------------------------------------------------- writing


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for each row of counts; a row with one symbol gets length 1 for it."""
    used = counts > 0
    total = counts.sum(1, keepdims=True)
    # Rare symbols count as one in 512, so that no code is longer than LONGEST.
    n = np.where(used, np.maximum(counts, -(-total // 512)), 0)
    share = np.maximum(n.sum(1, keepdims=True), 1) / np.maximum(n, 1)
    out = np.where(used, np.maximum(np.ceil(np.log2(share)).astype("int64"), 1), 0)
    order = np.argsort(-n, 1, kind="stable")
    ls = np.take_along_axis(out, order, 1).T.copy()
    room = (1 << LONGEST) - np.where(ls > 0, 1 << (LONGEST - ls), 0).sum(0)
    room[used.sum(1) < 2] = 0
    most = int(used.sum(1).max(initial=0))
    while room.any():
        for k in range(most):
            cost = 1 << (LONGEST - ls[k])
            less = (ls[k] > 1) & (cost <= room)
            room -= cost * less
            ls[k] -= less
    np.put_along_axis(out, order, ls.T, 1)
    return out


def codewords(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code in the order of the stream, its bits) of each symbol of each row; a code of one symbol has no bits."""
    key = np.where(lengths > 0, lengths << 10 | np.arange(lengths.shape[1]), 1 << 20)
    order = np.argsort(key, 1)
    ls = np.take_along_axis(lengths, order, 1)
    width = np.where(ls > 0, 1 << (LONGEST - ls), 0)
    start = np.cumsum(width, 1) - width
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, np.where(ls > 0, _turns(LONGEST)[start & ((1 << LONGEST) - 1)], 0), 1)
    several = (lengths > 0).sum(1, keepdims=True) > 1
    return np.where(several, codes, 0), np.where(several, lengths, 0)


@lru_cache(1)
def _length_words() -> tuple[tuple[tuple[int, int], ...], int, int]:
    """Code and bits of each symbol of the code of lengths, and what announces it in the stream (value, bits)."""
    words = {s: (c, n) for s, n, c in webp._canonical(LENGTH_CODE)}
    w = Writer()
    w.put(0, 1)
    w.put(len(webp.CODE_LENGTH_ORDER) - 4, 4)
    for k in webp.CODE_LENGTH_ORDER:
        w.put(LENGTH_CODE[k], 3)
    return tuple(words.get(s, (0, 0)) for s in range(19)), w.value, w.size


def code_bits(lengths: np.ndarray) -> tuple[int, int]:
    """A code as it is announced in the stream: (value, bits)."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        return 0b101 | (used[0] if used else 0) << 3, 11
    _, value, size = _length_words()
    ls = lengths.tolist()
    if len(used) == 1:  # a code that can't be announced as a simple one gets a second symbol
        ls[0], used = 1, [0, *used]
    body, bits, count, at = 0, 0, 0, 0
    for s in used:
        v, n, k = _length_item(s - at, ls[s])
        body |= v << bits
        bits += n
        count += k
        at = s + 1
    if count < 2:
        v, n, k = _length_item(1, 0)
        body, bits, count = body | v << bits, bits + n, count + k
    more = count - 2
    wide = max(0, (more.bit_length() - 1) // 2)
    value |= (1 | wide << 1 | more << 4) << size
    size += 4 + 2 + 2 * wide
    return value | body << size, size + bits


@lru_cache(1 << 13)
def _length_item(gap: int, length: int) -> tuple[int, int, int]:
    """A gap of zeros and then a length (or only the gap, if 0) in the code of lengths: (value, bits, symbols)."""
    runs = []
    while gap >= 3:
        t = min(gap, 138)
        runs.append((18, t - 11, 7) if t >= 11 else (17, t - 3, 3))
        gap -= t
    runs += [(0, 0, 0)] * gap + ([(length, 0, 0)] if length else [])
    words, _, _ = _length_words()
    value = size = 0
    for s, extra, n in runs:
        c, m = words[s]
        value |= (c | extra << m) << size
        size += m + n
    return value, size, len(runs)


def _signed(v: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 256, as -128 to 127."""
    return v.astype("uint8").view("int8").astype("int16")


def _edges(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first pixels of images; of the others of their first rows; of the others of their first columns."""
    start = np.cumsum(size) - size
    row = (start[:, None] + np.arange(1, width)).ravel()
    rows = size // width - 1
    column = np.repeat(start, rows) + width * (np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows) + 1)
    return start, row, column


def _guesses(c: np.ndarray, mode: int, width: int) -> np.ndarray:
    """The predictions of a mode for all pixels of one channel (or more, last), but for those at the edges."""
    n = len(c)
    wide = np.concatenate([np.zeros((width + 1, *c.shape[1:]), c.dtype), c])
    around = [wide[k : k + n] for k in (width, 1, 0, 2)]
    return webp.predicted(mode, *(x if c.ndim > 1 else x[:, None] for x in around)).reshape(c.shape)


def _predict(mode: int, c: np.ndarray, edges: tuple, width: int) -> np.ndarray:
    """The prediction of each pixel (channels last) from its neighbours, at the edges from the one that is there."""
    start, row, column = edges
    out = np.array(_guesses(c, mode, width), "int16")
    out[row], out[column], out[start] = c[row - 1], c[column - width], 0
    return out


def residuals(c: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(mode of each image, what its predictions leave, modulo 256): of modes 1 to 13 the one that leaves green least, by the sum of magnitudes."""
    edges, green = _edges(size, width), np.ascontiguousarray(c[:, 1])
    inner = np.ones(len(green), "uint8")
    for at in edges:  # predicted alike in all modes; their neighbours in the batch are other images' pixels
        inner[at] = 0
    cost = [np.add.reduceat(np.abs((green - _guesses(green, mode, width)).astype("int8")).view("uint8") * inner, edges[0], dtype="int64") for mode in range(1, 14)]
    modes = 1 + np.argmin(np.stack(cost), 0)
    out, each = np.empty(c.shape, "uint8"), np.repeat(modes.astype("int8"), size)
    wide = np.concatenate([np.zeros((width + 1, c.shape[1]), c.dtype), c])
    for mode in np.unique(modes).tolist():
        mine = np.flatnonzero(each == mode)
        out[mine] = c[mine] - webp.predicted(mode, *(wide[mine + k] for k in (width, 1, 0, 2)))
    start, row, column = edges
    out[row], out[column], out[start] = c[row] - c[row - 1], c[column] - c[column - width], c[start]
    return modes, out


def _slope(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The multiplier, in 32nds, by which x tells most of y in each image."""
    xy, xx = (np.add.reduceat(np.multiply(x, v, dtype="int16"), first, dtype="int64") for v in (y, x))
    return np.clip(np.round(32 * xy / np.maximum(xx, 1)), -128, 127).astype("int16")


def _runs(key: np.ndarray, image: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of image, key and place; whether each but the first has the image and key of the one before). Keys have 42 bits.

    What comes out for an image does not depend on the others of the batch.
    """
    place = np.arange(len(key)) - first[image]
    if len(first) > 1 << 11 or (len(place) and place.max() >> 11):
        raise ValueError("at most 2048 images of 2048 pixels at once")
    both = np.sort(image.astype("uint64") << np.uint64(53) | key << np.uint64(11) | place.astype("uint64"))
    lead = both >> np.uint64(11)
    return first[(both >> np.uint64(53)).astype("int64")] + (both & np.uint64(2047)).astype("int64"), lead[1:] == lead[:-1]


def matches(p: np.ndarray, image: np.ndarray, first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the reference that could stand at each pixel, to where its next LEAST pixels stood last in the image; 0 for none."""
    n = len(p)
    key = np.zeros(n, "uint64")
    for k in range(LEAST):
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.append(p[k:], np.zeros(min(k, n), p.dtype)).astype("uint64")
    key[left < LEAST] = 0  # what follows is another image's
    key = (key ^ key >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    order, again = _runs(key >> np.uint64(22), image, first)
    back = np.full(n, -1)
    back[order[1:][again]] = order[:-1][again]
    # Equal keys are equal pixels but for clashes, so pixels are compared; all of them lie in the same image.
    ok = (back >= 0) & (left >= LEAST)
    at = np.flatnonzero(ok)
    for k in range(LEAST):
        at = at[p[at + k] == p[back[at] + k]]
    at = at[image[at] == image[back[at]]]
    distance = np.zeros(n, "int64")
    distance[at] = at - back[at]
    # Places in a row with the same distance are one match, as long as the row and LEAST - 1 more.
    new = np.append(True, distance[1:] != distance[:-1]) | np.append(True, image[1:] != image[:-1])
    ends = np.append(np.flatnonzero(new)[1:], n)
    reach = np.repeat(ends, np.diff(np.append(np.flatnonzero(new), n))) - np.arange(n)
    return np.where(distance > 0, np.minimum(reach + LEAST - 1, MOST), 0), distance


def cached(p: np.ndarray, image: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the colour cache, whether the pixel stands there before it comes)."""
    place = (p.astype("uint64") * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE)
    order, again = _runs(place, image, first)
    hit = np.zeros(len(p), bool)
    hit[order[1:][again]] = p[order[1:][again]] == p[order[:-1][again]]
    return place.astype("int64"), hit


@lru_cache(8)
def _near(width: int) -> np.ndarray:
    """The code of each distance up to 8 * width + 8 that a near place has, else 0."""
    out = np.zeros(8 * width + 9, "int64")
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        out[max(1, x + y * width)] = k + 1
    return out


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits' value, their number) of amounts of at least 1."""
    v = v - 1
    top = np.maximum(np.frexp(v.astype("float64"))[1] - 1, 0)
    big = v >= 4
    extra = np.where(big, top - 1, 0)
    return np.where(big, 2 * top + (v >> extra & 1), v), np.where(big, v & ((1 << extra) - 1), 0), extra


def _pixel(green: int, red: int, blue: int) -> tuple[int, int]:
    """An image of one opaque pixel in the stream (value, bits)."""
    value = 0
    for k, s in enumerate((green, red, blue, 255, 0)):
        value |= (0b101 | s << 3) << 11 * k
    return value << 1, 56


def encode_many(payloads: list[bytes], width: int) -> list[bytes]:
    """A file of each payload (RGB samples, rows of `width` pixels)."""
    size = np.array([len(x) // 3 for x in payloads])
    c = np.frombuffer(b"".join(payloads), "uint8").reshape(-1, 3).astype("int16")
    image = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    modes, d = residuals(c, size, width)
    g, r, b = _signed(d[:, 1]), _signed(d[:, 0] - d[:, 1]), _signed(d[:, 2] - d[:, 1])  # subtract-green
    # Cross-colour: red and blue without what green tells, blue without what red tells.
    to_red, to_blue = _slope(g, r, first), _slope(g, b, first)
    red = r - (to_red[image] * g >> 5)
    blue = b - (to_blue[image] * g >> 5)
    from_red = _slope(r, _signed(blue), first)
    blue -= from_red[image] * r >> 5
    p = (red & 255).astype("uint32") << 16 | (g & 255).astype("uint32") << 8 | (blue & 255).astype("uint32")

    left = np.repeat(first + size, size) - np.arange(len(p))
    length, distance = matches(p, image, first, left)
    place, hit = cached(p, image, first)
    # The greedy way through: a reference leads past its pixels, anything else to the next.
    starts, free = [], 0
    may = np.flatnonzero(length)
    for k, m in zip(may.tolist(), length[may].tolist(), strict=True):
        if k >= free:
            starts.append(k)
            free = k + m
    taken = np.array(starts, "int64")
    inside = np.zeros(len(p) + 1, "int32")
    inside[taken + 1] += 1
    np.subtract.at(inside, taken + length[taken], 1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] <= 0)
    whole = length[taken]
    length = np.zeros_like(length)
    length[taken] = whole
    lane, length, distance, hit = image[at], length[at], distance[at], hit[at]
    ref = length > 0
    hit &= ~ref
    plain = ~ref & ~hit
    q = p[at]
    green = np.where(hit, 256 + LENGTH_SYMBOLS + place[at], q >> 8 & 255)
    ls, lx, ln = _prefixed(np.where(ref, length, 1))
    green = np.where(ref, 256 + ls, green).astype("int64")
    near = _near(width)
    code = np.where(distance < len(near), near[np.minimum(distance, len(near) - 1)], 0)
    ds, dx, dn = _prefixed(np.where(ref, np.where(code > 0, code, distance + 120), 1))
    rr, bb = (q >> 16 & 255).astype("int64"), (q & 255).astype("int64")

    many = len(size)
    count = lambda rows, symbols, wide: np.bincount(lane[rows] * wide + symbols[rows], minlength=many * wide).reshape(many, wide)
    lengths = [code_lengths(x) for x in (count(slice(None), green, GREENS), count(plain, rr, 256) + count(plain, bb, 256), count(ref, ds, DISTANCE_SYMBOLS))]
    alone = (lengths[0] > 0).sum(1) == 1
    odd = alone & (lengths[0][:, 256:] > 0).any(1)
    lengths[0][odd, 0] = 1
    words = [codewords(x) for x in lengths]

    # Items of at most 33 bits: green (with the extra bits of a length, or with red and blue), and a distance.
    value, bits = words[0][0][lane, green], words[0][1][lane, green]
    value = value | np.where(ref, lx << bits, 0)
    bits = bits + np.where(ref, ln, 0)
    for symbols in (rr, bb):
        value = value | np.where(plain, words[1][0][lane, symbols] << bits, 0)
        bits = bits + np.where(plain, words[1][1][lane, symbols], 0)
    # A distance is an item of its own, behind that of its length.
    of = np.flatnonzero(ref)
    far = words[2][0][lane[of], ds[of]] | dx[of] << words[2][1][lane[of], ds[of]]
    value = np.insert(value, of + 1, far).astype("uint64")
    bits = np.insert(bits, of + 1, words[2][1][lane[of], ds[of]] + dn[of])
    lane = np.insert(lane, of + 1, lane[of])

    heads = []
    for k, (mode, blue_red, blue_green, red_green) in enumerate(zip(modes.tolist(), (from_red & 255).tolist(), (to_blue & 255).tolist(), (to_red & 255).tolist(), strict=True)):
        w = webp._start(width, int(size[k]) // width)
        shared = code_bits(lengths[1][k])
        # Each transform's image is one pixel: no cache, five codes of one symbol.
        predictor = _pixel(mode, 0, 0)
        cross = _pixel(blue_green, blue_red, red_green)
        for announced in ((1 | PREDICTOR << 1 | SIDE - 2 << 3, 6), predictor, (1 | GREEN << 1 | (1 | CROSS << 1 | SIDE - 2 << 3) << 3, 9), cross, ((1 | CACHE << 1) << 1, 7), code_bits(lengths[0][k]), shared, shared, (0b101, 11), code_bits(lengths[2][k])):
            w.put(*announced)
        heads.append(w)
    return _streams(heads, lane, value, bits)


def _streams(heads: list[Writer], lane: np.ndarray, value: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """A file of each head and its lane's items: items become bits at once, added, shifted, into the 32-bit words where they stand."""
    ends = np.cumsum(bits)
    own = np.bincount(lane, bits, len(heads)).astype("int64")
    before = np.cumsum(own) - own
    head = np.array([w.size for w in heads])
    need = head + own
    word = np.append(0, np.cumsum((need + 31) // 32 + 2))
    at = (32 * word[:-1] + head - before)[lane] + ends - bits
    live = bits > 0
    at, value = at[live], value[live]
    out = np.zeros(int(word[-1]) + 2, "uint64")
    if len(at):
        k = at >> 5
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        total = np.add.reduceat(value << (at & 31).astype("uint64"), new)
        out[k[new]] += total & np.uint64(0xFFFFFFFF)
        out[k[new] + 1] += total >> np.uint64(32)
    raw, files = out.astype("<u4").tobytes(), []
    for w, a, m in zip(heads, word[:-1].tolist(), need.tolist(), strict=True):
        n = (w.size + 7) // 8
        part = raw[4 * a : 4 * a + (m + 7) // 8]
        mixed = int.from_bytes(part[:n], "little") | w.value
        files.append(webp._file(mixed.to_bytes(n, "little") + part[n:]))
    return files


# ---------------------------------------------------------------- reading


@lru_cache(512)
def _constant(symbol: int) -> tuple[int, np.ndarray]:
    return 0, np.array([symbol << 4], "int64")


def _table(lengths: tuple[int, ...]) -> tuple[int, np.ndarray]:
    """(bits, array from the next bits to symbol << 4 | length). A code of one symbol takes no bits."""
    ls = np.array(lengths, "int64")
    used = np.flatnonzero(ls)
    if len(used) <= 1:
        return _constant(int(used[0]) if len(used) else 0)
    order = used[np.argsort(ls[used], kind="stable")]
    n = ls[order]
    width = int(n[-1])
    table = np.repeat(order << 4 | n, 1 << (width - n))
    if len(table) != 1 << width:
        raise ValueError("a prefix code is not complete")
    return width, table[_turns(width)]


class Lane:
    """An image whose pixels have one group of codes: where they start, the codes, and what to undo."""

    def __init__(self, data: bytes):
        self.b = b = Bits(webp._open(data))
        w, self.height = webp._head(b)
        self.found, self.width = webp._transforms(b, w, self.height)
        self.size = self.width * self.height
        start = b.at
        self.cache = b.read(4) if b.read(1) else 0
        self.grouped = bool(b.read(1))
        if self.grouped:
            b.at = start
            return
        codes = webp._codes(b, 1, self.cache)[0]
        made = {x: _table(x) for x in codes}
        self.tables = [made[x] for x in codes]
        self.grouped = self.tables[3][0] > 0
        if self.grouped:
            b.at = start

    def alone(self) -> np.ndarray:
        return webp._undo(webp._pixels(self.b, self.width, self.height, True), self.found)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The ARGB pixels of each file; those with several groups of codes or with transparency one by one."""
    out: list = [None] * len(files)
    for a in range(0, len(files), LANES):
        lanes = []
        for k, data in enumerate(files[a : a + LANES], a):
            lane = Lane(data)
            if lane.grouped:
                out[k] = lane.alone()
            else:
                lanes.append((k, lane))
        lanes.sort(key=lambda x: (-x[1].size, x[0]))
        some = [x for _, x in lanes]
        for (k, _), p in zip(lanes, undone(some, pixels(some)) if some else [], strict=True):
            out[k] = p
    return out


def pixels(lanes: list[Lane]) -> list[np.ndarray]:
    """The coded pixels of every lane, one symbol of each at a time; lanes come longest first, so those still running are a prefix."""
    streams = [x.b.data for x in lanes]
    base = np.cumsum([0] + [len(s) for s in streams])[:-1]
    raw = np.frombuffer(b"".join(streams) + bytes(16), "uint8")
    words = np.ascontiguousarray(np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,)))
    at = np.array([x.b.at for x in lanes], "int64") + 8 * base
    sizes, many = np.array([x.size for x in lanes]), len(lanes)
    where, parts, n = {}, [], 0
    for x in lanes:
        for _, t in x.tables:
            if id(t) not in where:
                where[id(t)] = n
                parts.append(t)
                n += len(t)
    tables = np.concatenate(parts)
    first = [np.array([where[id(x.tables[c][1])] for x in lanes]) for c in range(5)]
    mask = [np.array([(1 << x.tables[c][0]) - 1 for x in lanes], "uint64") for c in range(5)]
    alpha = (tables[first[3]] >> 4) << 24
    least, extra = _amounts()
    near_x, near_y = (np.array(v) for v in zip(*NEAR, strict=True))
    width = np.array([x.width for x in lanes])
    # Caches side by side; one place for a lane without, which no symbol names.
    slots = np.array([1 << x.cache for x in lanes])
    cache_at = np.cumsum(slots) - slots
    cache = np.zeros(int(slots.sum()), "int64")
    shift = np.array([32 - x.cache for x in lanes], "uint64")
    keep = any(x.cache for x in lanes)
    got = np.zeros((int(sizes[0]), many), "int64")
    flat = got.reshape(-1)
    copy, back = np.zeros(many, "int64"), np.zeros(many, "int64")
    running = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left").tolist()
    for step, m in enumerate(running):
        row = got[step]
        busy = np.flatnonzero(copy[:m])
        if len(busy):
            row[busy] = flat[(step - back[busy]) * many + busy]
            copy[busy] -= 1
            still = np.ones(m, bool)
            still[busy] = False
            free = np.flatnonzero(still)
        else:
            free = np.arange(m)
        if len(free):
            place = at[free]
            v = words[place >> 3] >> (place & 7).astype("uint64")
            e = tables[first[0][free] + (v & mask[0][free]).astype("int64")]
            n, s = e & 15, e >> 4
            v >>= n.astype("uint64")
            plain = np.flatnonzero(s < 256)
            if len(plain):
                lane, w, value = free[plain], v[plain], alpha[free[plain]] | s[plain] << 8
                for c, to in ((1, 16), (2, 0)):
                    e = tables[first[c][lane] + (w & mask[c][lane]).astype("int64")]
                    value |= (e >> 4) << to
                    e &= 15
                    w >>= e.astype("uint64")
                    n[plain] += e
                row[lane] = value
            if len(plain) < len(free):
                kept = np.flatnonzero(s >= 256 + LENGTH_SYMBOLS)
                row[free[kept]] = cache[cache_at[free[kept]] + s[kept] - 256 - LENGTH_SYMBOLS]
                ref = np.flatnonzero((s >= 256) & (s < 256 + LENGTH_SYMBOLS))
                if len(ref):
                    lane, w, sym = free[ref], v[ref], s[ref] - 256
                    length = least[sym] + (w & ((1 << extra[sym]) - 1).astype("uint64")).astype("int64")
                    w >>= extra[sym].astype("uint64")
                    e = tables[first[4][lane] + (w & mask[4][lane]).astype("int64")]
                    w >>= (e & 15).astype("uint64")
                    far = e >> 4
                    d = least[far] + (w & ((1 << extra[far]) - 1).astype("uint64")).astype("int64")
                    n[ref] += extra[sym] + (e & 15) + extra[far]
                    k = np.minimum(d, len(NEAR)) - 1
                    d = np.where(d > len(NEAR), d - len(NEAR), np.maximum(near_x[k] + near_y[k] * width[lane], 1))
                    if (d > step).any() or (length > sizes[lane] - step).any():
                        raise ValueError("a back-reference leaves the image")
                    back[lane], copy[lane] = d, length - 1
                    row[lane] = flat[(step - d) * many + lane]
            at[free] += n
        if keep:
            now = row[:m]
            cache[cache_at[:m] + ((now.astype("uint64") * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> shift[:m]).astype("int64")] = now
    for j, x in enumerate(lanes):
        if at[j] - 8 * base[j] > 8 * (len(x.b.data) - 8):
            raise ValueError("the stream ends early")
    return [got[: x.size, j].astype("uint32") for j, x in enumerate(lanes)]


def _ours(x: Lane) -> bool:
    """Whether an image is opaque and has the transforms that encode_many writes, one block each."""
    return [f[0] for f in x.found] == [PREDICTOR, GREEN, CROSS] and all(f[1].size == 1 for f in x.found[::2]) and x.width > 1 and not x.tables[3][1][0]


def undone(lanes: list[Lane], coded: list[np.ndarray]) -> list[np.ndarray]:
    """The images; transforms as encode_many writes them are inverted for all images of a width together."""
    out: list = [None] * len(lanes)
    groups: dict[int, list[int]] = {}
    for k, x in enumerate(lanes):
        if _ours(x):
            groups.setdefault(x.width, []).append(k)
        else:
            out[k] = webp._undo(coded[k].reshape(x.height, x.width), x.found)
    for width, ks in groups.items():
        size = np.array([lanes[k].size for k in ks])
        p = np.concatenate([coded[k] for k in ks])
        image = np.repeat(np.arange(len(ks)), size)
        data = np.array([int(lanes[k].found[2][1][0, 0]) for k in ks])
        from_red, to_blue, to_red = (_signed(data >> n & 255)[image] for n in (16, 8, 0))
        samples = p.astype("<u4").view("uint8").reshape(-1, 4)
        g, b = _signed(samples[:, 1]), _signed(samples[:, 0])
        r = _signed(_signed(samples[:, 2]) + (to_red * g >> 5))
        b = b + (to_blue * g >> 5) + (from_red * r >> 5)
        d = np.stack([r + g & 255, g & 255, b + g & 255], 1)
        modes = np.array([int(lanes[k].found[0][1][0, 0]) >> 8 & 15 for k in ks])
        c = unpredicted(d, size, modes, width)
        whole = np.full((len(c), 4), 255, "uint8")
        whole[:, :3] = c[:, ::-1]
        whole = whole.view("<u4").ravel()
        for k, a, n in zip(ks, (np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
            out[k] = whole[a : a + n].reshape(-1, width)
    return out


@lru_cache(64)
def _diagonals(width: int, height: int) -> list[np.ndarray]:
    """Places of inner pixels by the turn in which all that they need is there."""
    y, x = np.divmod(np.arange(width * height), width)
    inner = np.flatnonzero((x > 0) & (y > 0))
    turn = x[inner] + 2 * y[inner]
    order = np.argsort(turn, kind="stable")
    return np.split(inner[order], np.flatnonzero(np.diff(turn[order])) + 1) if len(inner) else []


def unpredicted(d: np.ndarray, size: np.ndarray, modes: np.ndarray, width: int) -> np.ndarray:
    """The samples of images from what their predictions left."""
    out, first = np.empty_like(d), np.cumsum(size) - size
    height = size // width
    tall = (height + 7) // 8 * 8
    for mode, high in sorted(set(zip(modes.tolist(), tall.tolist(), strict=True))):
        ks = np.flatnonzero((modes == mode) & (tall == high))
        # A plane of all images for each place, so that a turn copies whole rows.
        place = np.arange(width * high)[:, None] + first[ks]
        inside = np.arange(width * high)[:, None] < size[ks]
        c = d[np.where(inside, place, 0)].reshape(width * high, -1)
        c[:width] = np.cumsum(c[:width], 0) & 255
        c[::width] = np.cumsum(c[::width], 0) & 255
        shape = (-1, len(ks), d.shape[1])
        for at in _diagonals(width, high):
            around = [c[at + k].reshape(shape) for k in (-1, -width, -width - 1, 1 - width)]
            c[at] = c[at] + webp.predicted(mode, *around).reshape(len(at), -1) & 255
        out[place[inside]] = c.reshape(shape)[inside]
    return out
