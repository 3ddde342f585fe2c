"""Packing over several islands and levels, and evolution against best fit."""

import random

import numpy as np
import pytest

from glosswork.llm import packing as P


def triplets(n, seed):
    """Pieces of which three each fill a sequence, and that best fit does not find together."""
    rng, out, groups = random.Random(seed), [], []
    for _ in range(n):
        a = rng.randrange(P.CAPACITY * 38 // 100, P.CAPACITY * 49 // 100)
        b = rng.randrange((P.CAPACITY - a) // 2 - P.CAPACITY // 8, (P.CAPACITY - a) // 2 + 1)
        groups.append([a, b, P.CAPACITY - a - b])
        out += groups[-1]
    rng.shuffle(out)
    return out, groups


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit(seed):
    lengths, _ = triplets(60, seed)
    best_fit = P._packed(np.array(lengths), P.CAPACITY, [], list(range(len(lengths))))
    bins = P.evolve(lengths, seed=seed)
    assert sorted(i for b in bins for i in b) == list(range(180))
    assert P.fills(bins, np.array(lengths)).max() <= P.CAPACITY
    assert 60 <= len(bins) < len(best_fit)


def test_evolution_fills_bins_that_best_fit_leaves_open():
    rng = random.Random(7)
    lengths = [rng.randrange(100, 900) for _ in range(1500)]
    best_fit = P._packed(np.array(lengths), P.CAPACITY, [], list(range(len(lengths))))
    bins = P.evolve(lengths, seed=1)
    full = lambda x: int((P.fills(x, np.array(lengths)) == P.CAPACITY).sum())
    assert len(bins) <= len(best_fit) and full(bins) > full(best_fit)


@pytest.mark.parametrize("kind", ["texts", "triplets"])
def test_crossover_makes_the_difference_on_a_whole_island(kind):
    """4,096 pieces: with crossing more bins are full than without, in as many generations, and children of crossings come in."""
    rng, n = random.Random(11), P.ISLAND_PIECES
    lengths = [1 + int(rng.lognormvariate(6.2, 1.2)) % (P.CAPACITY - 1) for _ in range(n)] if kind == "texts" else triplets(n // 3, 1)[0]
    known, won = np.array(lengths), {}
    full = lambda bins: (-len(bins), int((P.fills(bins, known) == P.CAPACITY).sum()))
    crossed, alone, best_fit = P.evolve(lengths, seed=3, won=won), P.evolve(lengths, seed=3, crossing=False), P._packed(known, P.CAPACITY, [], list(range(len(lengths))))
    assert sorted(i for b in crossed for i in b) == list(range(len(lengths))) and P.fills(crossed, known).max() <= P.CAPACITY
    assert full(crossed) > full(alone) >= full(best_fit) and won["crossed"] >= 3


def test_injected_bins_are_whole_and_cost_no_more_than_they_bring():
    rng = random.Random(2)
    for seed in range(20):
        lengths = np.array([rng.choice([512, 1024, 256, rng.randrange(1, 900)]) for _ in range(300)])
        parents = []
        for k in range(2):
            order = list(range(300))
            random.Random(seed + 100 * k).shuffle(order)
            b = P.Bins(lengths.tolist(), P.CAPACITY)
            for i in order:
                b.best_fit([i])
            parents.append(P.Packing(b.bins, lengths))
        child = P.crossover(*parents, lengths, P.CAPACITY, random.Random(seed))
        full = lambda x: {frozenset(v) for v, f in zip(x.bins, x.fill.tolist(), strict=True) if f == P.CAPACITY}
        assert sorted(i for x in child.bins for i in x) == list(range(300)) and child.fill.max() <= P.CAPACITY
        assert full(child) & (full(parents[1]) - full(parents[0])) and len(full(child)) >= len(full(parents[0]))


def packed(spark, lengths, island_pieces):
    rows = [(str(k), 0, 0, n, 0, k) for k, n in enumerate(lengths)]
    out = P.pack(spark.createDataFrame(rows, P.PIECES), island_pieces=island_pieces).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == sorted((k, n) for k, n in enumerate(lengths))
    bins = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        at = bins.get(r["sequence_id"], 0)
        assert r["offset"] == at
        bins[r["sequence_id"]] = at + r["length"]
    assert max(bins.values()) <= P.CAPACITY
    return len(bins)


def test_pieces_that_never_fit_together_end(spark):
    assert packed(spark, [1500] * 130, 32) == 130


def test_several_islands_and_levels_come_near_the_bound(spark):
    rng = random.Random(3)
    lengths = [rng.randrange(1, 1200) for _ in range(700)] + [P.CAPACITY] * 3
    assert packed(spark, lengths, 128) <= -(-sum(lengths) // P.CAPACITY) + 1


def test_elite_patterns_of_a_neighbour_are_taken_up():
    lengths, patterns = triplets(60, 2)
    alone = P.evolve(lengths, seed=2)
    bins = P.evolve(lengths, seed=2, start=alone, patterns=patterns)
    assert len(bins) == 60 < len(alone)


def test_islands_of_a_level_evolve_again_with_what_came(spark):
    """Three islands, each of which sends its full bins on: pieces stay whole and in one place."""
    lengths, _ = triplets(80, 5)
    assert packed(spark, lengths, 80) <= 84


def test_levels_halve():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        sizes = rng.integers(1, 5, n)
        ends = np.cumsum(sizes) - 1
        kept = int((ends < P._half(int(sizes.sum()), ends)).dot(sizes))
        assert 2 * kept >= sizes.sum()


def test_clashing_columns_and_ties(spark):
    docs = spark.createDataFrame([(k % 7, "same words here", k, "x") for k in range(40)], "doc_id long, text string, length long, piece string")
    out = P.pack(P.pieces_of(docs), island_pieces=8).collect()
    assert len(out) == 40 and {r["piece"] for r in out} == {0} and len({(r["sequence_id"], r["offset"]) for r in out}) == 40
