"""Differencing: windows, capacity, padding, and pieces against the library's ids."""

import random
import zlib

import numpy as np
import pytest

from glosswork.llm import differencing as D
from glosswork.llm.bpe import coder

SCHEMA = "doc_id long, text string, offset string, length string"


def padding(sequences):
    """Tokens added to sequences (lengths): to the capacity, none at a power of two."""
    return sum(0 if n & n - 1 == 0 else D.CAPACITY - n for n in sequences)


def sums(lengths, windows):
    return np.bincount(windows, weights=lengths).astype(int)


@pytest.mark.parametrize("n,k,seed", [(1, 1, 0), (5, 8, 1), (40, 7, 2), (300, 64, 3)])
def test_differencing_partitions(n, k, seed):
    lengths = np.random.default_rng(seed).integers(1, 900, n)
    window, got = D.difference(lengths, k)
    assert (np.bincount(window, weights=lengths, minlength=k) == got).all() and (np.diff(got) <= 0).all()


def test_differencing_is_nearly_equal_where_greed_is_not():
    # The textbook case: 8 7 6 5 4 in two sets; differencing gives 16 and 14, greed 17 and 13.
    assert D.difference(np.array([8, 7, 6, 5, 4]), 2)[1].tolist() == [16, 14]
    lengths = np.concatenate([np.random.default_rng(1).integers(100, 1000, 600), *[D.small_pieces(300)] * 90])
    _, got = D.difference(lengths, 150)
    assert got[0] - got[-1] <= 1


@pytest.mark.parametrize("n", [1, 63, 64, 127, 128, 1000, 2047])
def test_small_pieces(n):
    assert sum(D.small_pieces(n)) == n and all(x & x - 1 == 0 and x <= D.SMALL for x in D.small_pieces(n))


def island(lengths_of_documents):
    cutter, out = D.Cutter(), []
    for n in lengths_of_documents:
        out += cutter.cut(n)
    return np.array([x for x in out if x < D.CAPACITY])


@pytest.mark.parametrize("documents", [[5] * 30, [1100] * 450, [1500] * 300 + [400] * 200, [1300] * 300 + [700] * 60, [1] * 3000, [2047] * 200])
def test_little_padding_whatever_the_lengths(documents):
    lengths = island(documents)
    got = sums(lengths, D.windows_of(lengths))
    assert got.max() <= D.CAPACITY and padding(got[got > 0].tolist()) <= 0.01 * lengths.sum()


def test_the_number_of_windows_rises_with_capacity_exceeded():
    lengths = np.array([1100] * 50)
    got = sums(lengths, D.windows_of(lengths))
    assert len(got) == 50 and got.max() == 1100


def test_the_tail_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array(D.small_pieces(rng.randrange(2100, 9000)) + [rng.randrange(65, 900) for _ in range(5)])
        need = rng.randrange(1, 2048)
        at = D.tail_of(lengths, need)
        assert lengths[at].sum() == need


def check(rows, docs):
    """Each id in one piece, gapless sequences of at most the capacity; gives the sequences' lengths."""
    c, by, seq = coder(), {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in docs:
        ids, at = c.encode([text or ""])[0] + b"\x01\0\0\0", 0
        for r in sorted(by[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    out = []
    for x in seq.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= D.CAPACITY
        out.append(at)
    return out


def test_whole_packing(spark):
    rng = random.Random(5)
    words = ["the", "packing", "windows", "ünder", "zzz9", "."]
    docs = [(k, " ".join(rng.choices(words, k=int(rng.lognormvariate(6, 1.3))))) for k in range(300)] + [(900, None), (901, ""), (902, " "), (903, "word and the other " * 20000)]
    df = spark.createDataFrame([(*x, "own", "own") for x in docs], SCHEMA).repartition(6)
    pieces = D.pieces_of(df)
    rows = D.pack(pieces).collect()
    assert set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    lengths = check(rows, docs)
    assert padding(lengths) <= 0.005 * sum(lengths)


def test_nothing_repeated_rows_and_null_keys(spark):
    assert D.pack(D.pieces_of(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = D.pack(D.pieces_of(spark.createDataFrame([(None, "a b", "", ""), (4, "the one", "", ""), (4, "the one", "", "")], SCHEMA))).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 6 and sum(r["length"] for r in rows if r["doc_id"] is None) == 3
