"""Words of whole texts as 64-bit hashes, in numpy, with bounded working memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are worked on at once.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, "uint64", endpoint=False) | np.uint64(1)
_VALUE[_SPACE] = 0
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, "uint64")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype="uint64")
    return _powers


def _hashes(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a chunk's words and the places where they start."""
    b = np.frombuffer(raw, "uint8")
    if lower:
        b = _LOWER[b]
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, "uint64"), at
    b = b[at[0] :]
    reach = np.diff(np.append(at, at[0] + len(b)))
    place = np.arange(len(b)) - np.repeat(at - at[0], reach)
    return mix(np.add.reduceat(_VALUE[b] * _pow(int(reach.max()))[place], at - at[0])), at


def _chunks(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, cut where white space stands."""
    a = 0
    while a < len(raw):
        b, ends = a + CHUNK, []
        while b < len(raw) and not ends:
            part = np.frombuffer(raw, "uint8", min(CHUNK, len(raw) - b), b)
            ends = np.flatnonzero(_SPACE[part])[:1].tolist()
            b += ends[0] if ends else len(part)
        yield raw[a:b]
        a = b


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); lower: A-Z count as a-z."""
    hashes, counts, k = [np.zeros(0, "uint64")], np.zeros(len(texts), "int64"), 0
    while k < len(texts):
        if len(texts[k]) >= CHUNK:
            for raw in _chunks(texts[k]):
                h, _ = _hashes(raw, lower)
                hashes.append(h)
                counts[k] += len(h)
            k += 1
            continue
        end, n = k, 0
        while end < len(texts) and n + len(texts[end]) < CHUNK:
            n += len(texts[end]) + 1
            end += 1
        end = max(end, k + 1)
        h, at = _hashes(b" ".join(texts[k:end]), lower)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[k : end - 1])])
        edges = np.searchsorted(at, np.append(starts, n + 1))
        counts[k:end] = np.diff(edges)
        hashes.append(h)
        k = end
    return np.concatenate(hashes), counts


def batches(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each."""
    a, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)
