"""Weighted word shingles and their consistent weighted samples, in numpy."""

from __future__ import annotations

import numpy as np

from .words import mix, word_hashes

#: Words of a shingle; bits of the table of document frequencies; share of the inverse document frequency in a weight.
WORDS, DF_BITS, IDF_SHARE = 5, 20, 0.25

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, number of distinct ones of each text), sorted by hash within a text.

    Words are cut at white space and lower-cased. A text with fewer words than a
    shingle has one shingle of all its words; one with no word has none.
    """
    h, n = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    doc = np.repeat(np.arange(len(n)), n)
    last = np.cumsum(n)
    left = np.repeat(last, n) - np.arange(len(h))  # words from here to the text's end
    x = np.zeros(len(h), "uint64")
    for k in range(words):
        y = np.zeros_like(x)
        if len(h) > k:
            y[: len(h) - k] = h[k:]
        y[left <= k] = 0
        x = x * _STEP + y
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    use = (left >= words) | first
    x, doc = mix(x[use]), doc[use]
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return x[at], np.diff(np.append(at, len(x))), np.bincount(doc[at], minlength=len(n))


def df_bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - DF_BITS)).astype("int64")


def idf_levels(df: np.ndarray, docs: int) -> np.ndarray:
    """The inverse document frequency of each bucket, in 256 steps: 255 where one document has it, 0 where all do."""
    part = np.log(np.maximum(df, 1)) / np.log(max(docs, 2))
    return np.round(255 * (1 - np.minimum(part, 1))).astype("uint8")


def weights(x: np.ndarray, times: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Times in the text, by 1 plus IDF_SHARE of the relative inverse document frequency."""
    return times * (1 + IDF_SHARE / 255 * levels[df_bucket(x)])


class Sampler:
    """Improved consistent weighted sampling (r and c from Gamma(2, 1), beta uniform).

    A shingle's variates come from sums of table rows that bits of its hash
    choose: two exponentials add up to a Gamma(2, 1), and beta counts only by
    its fraction, so that the sum of two uniforms serves. What samples are
    compared by is the logarithm of the least `a`, which the shingle and its
    quantised weight alone determine.
    """

    ROWS = 1024

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        # r and beta of one half of the bits beside each other, then c's two halves.
        self.size = size
        self.rb = [np.concatenate([rng.exponential(size=(self.ROWS, size)), rng.random((self.ROWS, size))], axis=1).astype("float32") for _ in range(2)]
        self.c = [rng.exponential(size=(self.ROWS, size)).astype("float32") for _ in range(2)]

    def sample(self, x: np.ndarray, w: np.ndarray, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """A row of `size` samples (float32) for each text; infinity where it has no shingle."""
        k, out = self.size, np.full((len(counts), self.size), np.inf, "float32")
        ends = np.cumsum(counts)
        mask = np.uint64(self.ROWS - 1)
        place = [((x >> np.uint64(s)) & mask).astype("int64") for s in (0, 10, 20, 30)]
        lw = np.log(w).astype("float32")
        rb, other = np.empty((block, 2 * k), "float32"), np.empty((block, 2 * k), "float32")
        c, c2, t = (np.empty((block, k), "float32") for _ in range(3))
        for a in range(0, len(x), block):
            b = min(a + block, len(x))
            n = b - a
            np.take(self.rb[0], place[0][a:b], axis=0, out=rb[:n])
            np.take(self.rb[1], place[1][a:b], axis=0, out=other[:n])
            np.take(self.c[0], place[2][a:b], axis=0, out=c[:n])
            np.take(self.c[1], place[3][a:b], axis=0, out=c2[:n])
            s = rb[:n]
            s += other[:n]
            r, beta, la, u = s[:, :k], s[:, k:], c[:n], t[:n]
            la += c2[:n]
            np.log(la, out=la)
            np.divide(lw[a:b, None], r, out=u)
            u += beta
            np.floor(u, out=u)
            u -= beta
            u += 1
            u *= r
            la -= u  # ln a = ln c - r (t - beta + 1)
            # The texts that have shingles in this block.
            d = int(np.searchsorted(ends, a, "right"))
            at = a
            while at < b:
                stop = min(int(ends[d]), b)
                if stop > at:
                    np.minimum(out[d], la[at - a : stop - a].min(axis=0), out=out[d])
                at, d = stop, d + 1
        return out


def bands(samples: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each of n bands of a row of samples."""
    bits = samples.view("uint32").astype("uint64").reshape(len(samples), n, -1)
    key = np.full((len(samples), n), 0, "uint64") + np.arange(1, n + 1, dtype="uint64")
    for j in range(bits.shape[2]):
        key = mix(key * _STEP + bits[:, :, j])
    return key.view("int64")


def jaccard(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingles: sum of minima over sum of maxima; 1 for two empty ones."""
    total = wa.sum() + wb.sum()
    if not total:
        return 1.0
    at = np.searchsorted(xb, xa)
    at[at == len(xb)] = 0
    same = (xb[at] == xa) if len(xb) else np.zeros(len(xa), bool)
    both = np.minimum(wa[same], wb[at[same]]).sum()
    return float(both / (total - both))
