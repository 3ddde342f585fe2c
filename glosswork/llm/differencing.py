"""Packing into near-equal windows by multiway differencing (Karmarkar and Karp).

Documents become token pieces: whole windows are cut off from the start, and
what is left is cut into pieces of half a window at most. A tenth of these
rests is cut into small powers of two instead, so that differences end at
nothing. Pieces are dealt to islands by a hash of their place, each of bounded
tokens and pieces. On an island every piece begins as a partial partition into
as many windows as its tokens need; again and again the two partitions of the
largest spread merge, the fullest windows of one with the emptiest of the
other, until one partition is left. Where its fullest window exceeds the
capacity, the number of windows rises and differencing starts over.

What an island holds beyond whole windows goes, in small pieces, to sequences of
powers of two, which need no padding; where small pieces can't give that number
exactly, it stays with the windows, which then share one window's room.

Defined results: a document ends in the id END; null and empty texts are that
id alone; repeated rows are packed as rows of their own; an empty table gives an
empty result; partitions of equal spread merge in the order of their making, so
the same pieces give the same windows. Extra columns do not reach the result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, keyed, table, unkeyed
from .bpe import VOCABULARY, coder
from .packing import LEAF_CHARS

CAPACITY, END = 2048, 1
#: Share of the rests' tokens that is cut small, tokens of a task that are cut small at first, and the largest small piece.
SMALL_SHARE, SMALL_FIRST, SMALL = 0.1, 4096, 64
#: Windows and pieces of an island.
ISLAND_WINDOWS, ISLAND_PIECES = 256, 16384

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, uid long"


def small_pieces(n: int, largest: int = SMALL) -> list[int]:
    """n as powers of two: rounds of largest, its half and so on to 1, and the binary digits of what is left."""
    one = [largest >> k for k in range(largest.bit_length())]
    rounds, left = divmod(n, sum(one))
    return one * rounds + [one[0] >> k for k in range(len(one)) if left & one[0] >> k]


class Cutter:
    """Lengths of the pieces of document after document; keeps the share of small ones."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.small, self.all = capacity, 0, 0

    def cut(self, n: int) -> list[int]:
        whole, rest = divmod(n, self.capacity)
        self.all += rest
        if self.small < max(SMALL_FIRST, SMALL_SHARE * self.all):
            self.small += rest
            return [self.capacity] * whole + small_pieces(rest)
        half = self.capacity // 2
        return [self.capacity] * whole + [half] * (rest // half) + ([rest % half] if rest % half else [])


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Tokenizes docs (doc_id, text), ends each document and cuts it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, cutter, uid = coder(path, parted=True), Cutter(capacity), TaskContext.get().partitionId() << 33
        end = END.to_bytes(4, "little")
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                rows, part = [], pdf[k : k + 512]
                for doc, ids in zip(part["doc_id"], c.encode(["" if t is None else t for t in part["text"]], LEAF_CHARS), strict=True):
                    ids += end
                    at, n = 0, len(ids) // 4
                    for length in cutter.cut(n):
                        rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, uid))
                        at, uid = at + length, uid + 1
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "uid"])

    return unkeyed(keyed(docs).mapInPandas(run, PIECES))


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each length, sum of each window), by differencing into `windows` sets.

    A partition is its filled windows, fullest first, and a node for each. Where
    windows of two partitions meet, a new node has both as children; at the end
    the nodes pass their window's number down, from the last made to the first.
    """
    n = len(lengths)
    if not n:
        return np.zeros(0, "int64"), np.zeros(windows, "int64")
    spread = lambda s: int(s[0]) - (int(s[-1]) if len(s) == windows else 0)
    heap = [(-spread(lengths[k : k + 1]), k, lengths[k : k + 1], np.array([k])) for k in range(n)]
    heapq.heapify(heap)
    made, met, parents, children = n, n, [], []
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heap[0]
        both = max(0, len(sa) + len(sb) - windows)
        a, b = len(sa) - both, len(sb) - both
        sums, nodes = [sa[:a], sb[:b]], [na[:a], nb[:b]]
        if both:
            new = np.arange(met, met + both)
            met += both
            parents += [new, new]
            children += [na[a:], nb[b:][::-1]]
            sums.append(sa[a:] + sb[b:][::-1])
            nodes.append(new)
        s, m = np.concatenate(sums), np.concatenate(nodes)
        order = np.argsort(-s, kind="stable")
        s, m = s[order], m[order]
        heapq.heapreplace(heap, (-spread(s), made, s, m))
        made += 1
    _, _, s, m = heap[0]
    window = np.empty(met, "int64")
    window[m] = np.arange(len(m))
    # Nodes made at one meeting are a pair of entries; later meetings come first.
    for new, child in zip(reversed(parents), reversed(children), strict=True):
        window[child] = window[new]
    return window[:n], np.append(s, np.zeros(windows - len(s), "int64"))


def tail_of(lengths: np.ndarray, need: int) -> np.ndarray | None:
    """Places of small pieces whose sum is `need`, the largest first; None if these do not give it."""
    out = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if n & n - 1 == 0 and n <= SMALL and n <= need:
            out.append(k)
            need -= n
            if not need:
                break
    return None if need else np.array(out, "int64")


def windows_of(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece of an island."""
    lengths = np.asarray(lengths, "int64")
    whole, over = divmod(int(lengths.sum()), capacity)
    out, taken = np.zeros(len(lengths), "int64"), tail_of(lengths, over)
    if taken is not None and len(taken):
        # Sequences of the binary digits of what is over, largest first; powers of two in falling order fill each exactly.
        ends = np.cumsum([1 << k for k in range(over.bit_length() - 1, -1, -1) if over >> k & 1])
        out[taken] = whole + np.searchsorted(ends, np.cumsum(lengths[taken]))
    rest = np.setdiff1d(np.arange(len(lengths)), taken) if taken is not None else np.arange(len(lengths))
    if not len(rest):
        return out
    k = whole if taken is not None else whole + 1
    while True:
        window, sums = difference(lengths[rest], k)
        exceeding = int((sums > capacity).sum())
        if not exceeding:
            out[rest] = window
            return out
        if taken is not None and len(taken):
            # With a window more there is room for what was over, too.
            taken, rest, out = None, np.arange(len(lengths)), np.zeros(len(lengths), "int64")
        k += max(1, exceeding // 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = checkpoint(pieces.withColumn("doc_id", F.col("doc_id").cast("string")))
    cols = [c for c in pieces.columns if c != "uid"]
    full = pieces.filter(F.col("length") == capacity).select(*cols, (F.col("uid") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity)
    n, tokens = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    islands = max(1, -(-tokens // (ISLAND_WINDOWS * capacity)), -(-n // ISLAND_PIECES))
    schema = PIECES + ", island long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        window = windows_of(pdf["length"].to_numpy("int64"), capacity)
        pdf = pdf.assign(sequence_id=pdf["island"] * (1 << 32) + window)
        return pdf.assign(offset=pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"])[names]

    dealt = left.withColumn("island", F.pmod(F.xxhash64("uid"), F.lit(islands)))
    return unkeyed(full.unionByName(dealt.groupBy("island").applyInPandas(run, schema).select(*full.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
