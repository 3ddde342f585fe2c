"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token pieces, cut only where a document is longer than a
sequence. Pieces of full length are sequences of their own. The others are
dealt by a hash of their place to islands of bounded size. On each island a
small population of packings evolves: crossover injects whole well-filled bins
of one parent into the other, those first that cost it no full bin of its own,
removes bins that hold duplicates of what was injected, and best-fits the
displaced pieces, longest first; mutation dissolves the emptiest bins. Then elites migrate: every island sends the
length patterns of its best full bins to the next island of the ring, which
builds an immigrant packing out of its own pieces of those lengths and evolves
again. Full bins are final, and the fullest others where those hold less than
half of an island's pieces; the other pieces go on to the next level's fewer
islands, until one island is left. Each level has half of the one before at
most, so there are as many as the logarithm of the input, and all together move
the input's pieces twice.

Defined results: null and empty texts are one piece of length 1 (the id 0);
repeated rows are packed as rows of their own; an empty table gives an empty
result. Ties between bins of equal room go to the one opened last. Extra
columns do not reach the result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, keyed, table, unkeyed
from .bpe import VOCABULARY, coder

CAPACITY = 2048
#: Pieces of an island, packings of a population, generations of an epoch, those without a new packing after which it ends, patterns that migrate.
ISLAND_PIECES, POPULATION, GENERATIONS, PATIENCE, ELITES = 4096, 4, 32, 8, 64

#: Code points of a text that is encoded by its words, not as a tree.
LEAF_CHARS = 1 << 20

#: Keys pass through pandas as text, see keyed.
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long, uid long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Tokenizes docs (doc_id, text) and cuts what is longer than capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, uid = coder(path, parted=True), TaskContext.get().partitionId() << 33
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                rows = []
                part = pdf[k : k + 512]
                for doc, ids in zip(part["doc_id"], c.encode(["" if t is None else t for t in part["text"]], LEAF_CHARS), strict=True):
                    ids += b"\0\0\0\0"
                    for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                        raw = ids[a : a + 4 * capacity]
                        rows.append((doc, i, i * capacity, len(raw) // 4, zlib.crc32(raw), uid))
                        uid += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return unkeyed(keyed(docs).mapInPandas(run, PIECES))


class Bins:
    """A packing under construction: bins by the room left in them, and a bit for each room that some bin has."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0

    def add(self, bin_: list[int], room: int) -> None:
        self.at[room].append(len(self.bins))
        self.bins.append(bin_)
        self.rooms |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        """Each item, longest first, into the fullest bin that takes it."""
        lengths, at, bins = self.lengths, self.at, self.bins
        for i in sorted(items, key=lengths.__getitem__, reverse=True):
            n = lengths[i]
            fits = self.rooms >> n
            if not fits:
                self.add([i], self.capacity - n)
                continue
            room = n + (fits & -fits).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                self.rooms ^= 1 << room
            bins[k].append(i)
            at[room - n].append(k)
            self.rooms |= 1 << (room - n)


def _packed(lengths: np.ndarray, capacity: int, whole: list[list[int]], rest: list[int]) -> list[list[int]]:
    b = Bins(lengths.tolist(), capacity)
    for x, room in zip(whole, (capacity - fills(whole, lengths)).tolist(), strict=True):
        b.add(list(x), room)
    b.best_fit(rest)
    return b.bins


def fills(bins: list[list[int]], lengths: np.ndarray) -> np.ndarray:
    """The sum of the lengths in each bin."""
    if not bins:
        return np.zeros(0, "int64")
    sizes = np.fromiter(map(len, bins), "int64", len(bins))
    flat = np.fromiter(chain.from_iterable(bins), "int64", int(sizes.sum()))
    return np.add.reduceat(lengths[flat], np.cumsum(sizes) - sizes)


class Packing:
    """A packing of all pieces of an island: its bins, how full they are, and the bin of each piece."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray):
        self.bins, self.fill = bins, fills(bins, lengths)
        sizes = np.fromiter(map(len, bins), "int64", len(bins))
        self.where = np.empty(len(lengths), "int64")
        self.where[np.fromiter(chain.from_iterable(bins), "int64", len(lengths))] = np.repeat(np.arange(len(bins)), sizes)

    def score(self) -> tuple[int, int]:
        """Fewer bins first; among as many, the sum of squared fills, which favours full ones beside one that holds the rest."""
        return -len(self.bins), int(self.fill @ self.fill)


def _gains(a: Packing, b: Packing, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """The full bins of b that a does not have, and how many full bins of a each would take pieces from."""
    items = [b.bins[k] for k in np.flatnonzero(b.fill == capacity).tolist()]
    if not items:
        return [], np.zeros(0, "int64")
    sizes = np.fromiter(map(len, items), "int64", len(items))
    hit = a.where[np.fromiter(chain.from_iterable(items), "int64", int(sizes.sum()))]
    of = np.repeat(np.arange(len(items)), sizes)
    order = np.lexsort((hit, of))
    of, hit = of[order], hit[order]
    new = np.ones(len(hit), bool)
    new[1:] = (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])
    of, hit = of[new], hit[new]
    costs = np.bincount(of, weights=a.fill[hit] == capacity, minlength=len(items)).astype("int64")
    # A full bin whose pieces lie in one full bin is that bin.
    own = (np.bincount(of, minlength=len(items)) == 1) & (costs == 1)
    return [x for x, same in zip(items, own.tolist(), strict=True) if not same], costs[~own]


def crossover(a: Packing, b: Packing, lengths: np.ndarray, capacity: int, rng: random.Random) -> Packing | None:
    """a with full bins of b injected whole; None if there is none to inject.

    Bins of a that hold a duplicate of an injected piece go, and the pieces they
    hold beside are best-fitted into the open bins. Bins that take from no full
    bin of a come first; those that take from one are a fair exchange, and every
    other of them is taken; no bin is injected that costs more than it brings.
    """
    items, costs = _gains(a, b, capacity)
    order = np.flatnonzero(costs <= 1).tolist()
    rng.shuffle(order)
    order.sort(key=costs.__getitem__)
    gone, taken, whole = set(), set(), []
    for k in order:
        if not taken.isdisjoint(items[k]):
            continue
        hit = set(a.where[items[k]].tolist()) - gone
        lost = sum(a.fill[j] == capacity for j in hit)
        if lost > 1 or lost == 1 and rng.random() < 0.5:
            continue
        gone |= hit
        taken.update(items[k])
        whole.append(items[k])
    if not whole:
        return None
    open_ = Bins(lengths.tolist(), capacity)
    for k in np.flatnonzero(a.fill < capacity).tolist():
        if k not in gone:
            open_.add(list(a.bins[k]), capacity - int(a.fill[k]))
    open_.best_fit([i for k in gone for i in a.bins[k] if i not in taken])
    kept = [a.bins[k] for k in np.flatnonzero(a.fill == capacity).tolist() if k not in gone]
    return Packing(kept + whole + open_.bins, lengths)


def fullest(items: list[int], lengths: list[int], capacity: int) -> list[int]:
    """The items of a subset whose sum comes nearest to the capacity from below; sums are the bits of a number."""
    mask, reach = (1 << (capacity + 1)) - 1, [1]
    for i in items:
        reach.append(reach[-1] | reach[-1] << lengths[i] & mask)
    at, out = reach[-1].bit_length() - 1, []
    for k in range(len(items) - 1, -1, -1):
        if not reach[k] >> at & 1:
            out.append(items[k])
            at -= lengths[items[k]]
    return out


def mutate(a: Packing, lengths: np.ndarray, capacity: int, rng: random.Random) -> Packing:
    """The emptiest bins and a few others are dissolved, and bins as full as can be are built from their items, one after another."""
    gone = set(np.argsort(a.fill, kind="stable")[:8].tolist()) | {rng.randrange(len(a.bins)) for _ in range(8)}
    left, bins, known = [i for k in gone for i in a.bins[k]], [x for k, x in enumerate(a.bins) if k not in gone], lengths.tolist()
    rng.shuffle(left)
    while left:
        x = fullest(left, known, capacity)
        taken = set(x)
        bins.append(x)
        left = [i for i in left if i not in taken]
    return Packing(bins, lengths)


def immigrant(patterns: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """A packing that holds the patterns as far as this island has pieces of their lengths."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        by.setdefault(n, []).append(i)
    whole = []
    for p in patterns:
        got: list[int] = []
        for n in p:
            if not by.get(n):
                break
            got.append(by[n].pop())
        else:
            whole.append(got)
            continue
        for i in got:
            by[int(lengths[i])].append(i)
    return _packed(lengths, capacity, whole, [i for x in by.values() for i in x])


def evolve(
    lengths: list[int], capacity: int = CAPACITY, seed: int = 0, start: list[list[int]] | None = None, patterns: list[list[int]] | None = None,
    population: int = POPULATION, generations: int = GENERATIONS, crossing: bool = True, won: dict[str, int] | None = None,
) -> list[list[int]]:
    """The best packing found, as lists of places in lengths.

    Each generation crosses the best packing with another, both ways, and
    mutates the children; a child that is better than the worst packing, and
    equal to none, takes its place. Few bins are not enough: what is left empty
    is to lie in one bin, whose pieces go on to the next level. So evolution ends
    before its generations where all bins but one are full, which no packing
    beats, or where PATIENCE generations have brought no child in.

    crossing: whether packings are crossed, for tests; won: gets the number of
    children of each kind that came in.
    """
    if not lengths:
        return []
    rng, known = random.Random(seed), np.array(lengths, "int64")
    perfect = lambda x: (x.fill < capacity).sum() <= 1
    first = Packing(start or _packed(known, capacity, [], list(range(len(lengths)))), known)
    if perfect(first):
        return first.bins
    people = [first]
    if patterns:
        people.append(Packing(immigrant(patterns, known, capacity), known))
    while len(people) < population:
        # Part of the items first in pairs at random, so that the parents differ.
        some = rng.sample(range(len(lengths)), len(lengths) // 3)
        b = Bins(lengths, capacity)
        for i in some:
            b.best_fit([i])
        b.best_fit(list(set(range(len(lengths))) - set(some)))
        people.append(Packing(b.bins, known))
    people.sort(key=Packing.score, reverse=True)
    won, idle = {} if won is None else won, 0
    for _ in range(max(generations, 12_000 // len(lengths))):
        if perfect(people[0]) or idle == PATIENCE:
            break
        idle += 1
        a, b = people[0], people[rng.randrange(1, len(people))]
        children = []
        for x, y in ((a, b), (b, a)):
            child = crossover(x, y, known, capacity, rng) if crossing else None
            if child:
                children.append(("crossed", child))
            children.append(("mutated", mutate(child or x, known, capacity, rng)))
        for kind, child in children:
            if child.score() > people[-1].score() and all(child.score() != x.score() for x in people):
                people = sorted([*people[:-1], child], key=Packing.score, reverse=True)
                won[kind], idle = won.get(kind, 0) + 1, 0
    return people[0].bins


def _placed(pdf: pd.DataFrame, lengths: list[int], bins: list[list[int]], capacity: int) -> pd.DataFrame:
    bin_, offset, fill = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    for k, x in enumerate(bins):
        at = 0
        for i in x:
            bin_[i], offset[i] = k, at
            at += lengths[i]
        fill[x] = at
    # Full bins are final, and the fullest of the others until half of the pieces are placed: so each level halves the rest at least.
    order = np.lexsort((bin_, -fill))
    rank = np.empty(len(fill), "int64")
    rank[order] = np.arange(len(fill))
    last = np.zeros(len(bins), "int64")
    np.maximum.at(last, bin_, rank)
    return pdf.assign(bin=bin_, offset=offset, fill=fill, final=(fill == capacity) | (last[bin_] < _half(len(fill), last)))


def _half(n: int, last: np.ndarray) -> int:
    """One past the last rank of the bin that holds the piece in the middle of n; last: the last rank in each bin."""
    ends = np.sort(last)
    return int(ends[np.searchsorted(ends, (n - 1) // 2)]) + 1 if n else 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = checkpoint(pieces.withColumn("doc_id", F.col("doc_id").cast("string")))
    cols = [c for c in pieces.columns if c != "uid"]
    done = [pieces.filter(F.col("length") == capacity).select(*cols, (F.col("uid") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, level = pieces.filter(F.col("length") < capacity), 0
    schema = PIECES + ", island long, bin long, offset long, fill long, final boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].tolist()
        return _placed(pdf, lengths, evolve(lengths, capacity, int(pdf["island"][0])), capacity)[names]

    def again(pdf: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf[names]
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].tolist()
        start = [x.tolist() for x in pdf.groupby("bin").indices.values()]
        patterns = [list(x) for x in sorted(map(tuple, came["pattern"]))]
        return _placed(pdf, lengths, evolve(lengths, capacity, int(pdf["island"][0]) + 1, start, patterns), capacity)[names]

    n = left.count()
    while n:
        islands = -(-n // island_pieces)
        dealt = left.withColumn("island", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands)))
        state = checkpoint(dealt.groupBy("island").applyInPandas(first, schema))
        if islands > 1:
            # Elite migration round the ring: whole full bins, as the lengths in them.
            full = state.filter(F.col("fill") == capacity).groupBy("island", "bin").agg(F.sort_array(F.collect_list("length"), False).alias("pattern"))
            elite = full.groupBy("island").agg(F.slice(F.sort_array(F.collect_list("pattern")), 1, ELITES).alias("e"))
            sent = elite.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.explode("e").alias("pattern"))
            state = checkpoint(state.groupBy("island").cogroup(sent.groupBy("island")).applyInPandas(again, schema))
        loose = state.filter("not final").count() if islands > 1 else 0
        number = F.lit(level << 56) + (F.col("island") * (1 << 20)) + F.col("bin")
        done.append((state.filter("final") if loose else state).select(*cols, number.alias("sequence_id"), "offset"))
        left, level, n = state.filter("not final").select(*cols, "uid"), level + 1, loose
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return unkeyed(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
