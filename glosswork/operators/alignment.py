"""Alignment of the sentences of a page with those of its translation, as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

#: Padding of both lengths in a ratio, its least and greatest value, and the steps of the alignment.
PAD, LEAST, MOST = 6, 0.7, 1.4
BEADS = ((1, 1), (2, 1), (1, 2))


def _reach(texts: list[str], n: int) -> np.ndarray:
    """Length of the n texts that end at each place, joined by blanks; nan where there aren't as many before it."""
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = np.full(len(ends), np.nan)
    out[n:] = ends[n:] - ends[:-n] - 1
    return out


def ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ratios of padded lengths, nan outside the range."""
    r = (a + PAD) / (b + PAD)
    return np.where((r >= LEAST) & (r <= MOST), r, np.nan)


def path(us: list[str], es: list[str], beads: tuple[tuple[int, int], ...] = BEADS) -> list[tuple[int, int]]:
    """The beads of the cheapest monotone way through both lists by the absolute log ratio; empty if there is none.

    One row of costs after another, each at once: a bead takes one sentence of
    either side at least, so a row needs only rows before it. What is kept is
    the bead by which each place is reached; of equal costs that of most
    sentences of the first side.
    """
    order = sorted(beads, reverse=True)
    mine, other = ([_reach(t, n) for n in range(1, 1 + max(b[k] for b in beads))] for k, t in enumerate((us, es)))
    cost = np.full((len(us) + 1, len(es) + 1), np.inf)
    how = np.full(cost.shape, -1, "int8")
    cost[0, 0] = 0
    for i in range(1, len(us) + 1):
        for k, (a, b) in enumerate(order):
            if a > i or b > len(es):
                continue
            step = np.abs(np.log(ratios(mine[a - 1][i], other[b - 1][b:])))
            reached = cost[i - a, : len(es) + 1 - b] + np.where(np.isnan(step), np.inf, step)
            less = reached < cost[i, b:]
            cost[i, b:][less] = reached[less]
            how[i, b:][less] = k
    out, i, j = [], len(us), len(es)
    while i or j:
        if how[i, j] < 0:
            return []
        out.append(order[how[i, j]])
        i, j = i - out[-1][0], j - out[-1][1]
    return out[::-1]


def align(us: list[str], es: list[str], beads: tuple[tuple[int, int], ...] = BEADS) -> list[tuple[str, str] | None] | None:
    """Pairs of a page; None for a pair whose lengths differ too much, and for a page that cannot be aligned.

    As many sentences on both sides go one to one. Otherwise the cheapest path
    of beads counts, if exactly one of its beads isn't one to one.
    """
    if not us or not es:
        return None
    if len(us) == len(es):
        good = ~np.isnan(ratios(np.array([len(u) for u in us]), np.array([len(e) for e in es])))
        return [(u, e) if ok else None for u, e, ok in zip(us, es, good, strict=True)]
    way = path(us, es, beads)
    if sum(x != (1, 1) for x in way) != 1:
        return None
    ends = np.cumsum(way, axis=0).tolist()
    return [(" ".join(us[i - a : i]), " ".join(es[j - b : j])) for (a, b), (i, j) in zip(way, ends, strict=True)]


@F.udtf(returnType="k int, target string, english string")
class Aligned:
    """SELECT … FROM pages, LATERAL aligned(us, es): one row for each pair that is kept, k its place on the page."""

    def eval(self, us: list, es: list) -> Iterator[tuple]:
        for k, pair in enumerate(align(us or [], es or []) or []):
            if pair is not None:
                yield (k, *pair)
