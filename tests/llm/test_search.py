"""Search against scores of all documents, over blocks of documents and of queries, ties, nulls and repeated rows."""

import math
import random
import re
from collections import Counter

import pytest

from glosswork.llm import search as S

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans(S._FOLD[65:91].decode().upper(), S._FOLD[65:91].decode())


def brute(docs, items):
    found = [PATTERN.findall((t or "").translate(LOW)) for _, t in docs]
    n, total = sum(map(bool, found)), sum(map(len, found))
    df = Counter(w for t in found for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), t in zip(docs, found, strict=True):
            if t:
                tf, m = Counter(t), 75 + 25 * len(t) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in PATTERN.findall((text or "").translate(LOW)) if w in tf)
                scores += [(-score, doc is not None, doc or 0)] if score else []
        out += [(item, k, doc if there else None, -score) for k, (score, there, doc) in enumerate(sorted(scores)[: S.TOP], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, parts=5, **more):
    d = spark.createDataFrame([(*x, "own", "own") for x in docs], "doc_id long, text string, score string, n string").repartition(parts)
    q = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, rank string")
    got = S.search(d, q, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    skewed = [1 / (k + 1) for k in range(120)]
    docs = [(k, " ".join(rng.choices(words, skewed, k=rng.randrange(0, 90)))) for k in range(n)]
    docs += [(n + k, "w3 W7, w3! w90") for k in range(n // 3)]  # copies of one text: equal scores beyond the k-th
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(12)] + [(50, "w3 w90 w7 w3"), (51, "w119")]
    return docs, items


@pytest.mark.parametrize("postings,depth,parts", [(S.BLOCK_POSTINGS, S.DEPTH, 5), (300, 2, 40)])
def test_all_scores(spark, monkeypatch, postings, depth, parts):
    docs, items = corpus(500, 1)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(S, "DEPTH", depth)
    assert found(spark, docs, items, parts) == brute(docs, items)


def test_queries_in_blocks(spark):
    docs, items = corpus(120, 2)
    assert found(spark, docs, items, block_bytes=60) == brute(docs, items)


def test_nulls_repeated_rows_and_nothing(spark):
    docs = [(1, None), (2, ""), (3, " ., "), (None, "Ärger é É a1"), (4, "Ärger é É A1"), (4, "Ärger é É A1"), (5, "ärger " * 100_000), (6, "a1\x00b\x7fc 😀x")]
    items = [(1, "A1 É"), (1, "A1 É"), (None, "ärger Ärger"), (2, None), (3, "nowhere"), (4, "😀x b c")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] == found(spark, docs, [])


def test_it_stops_before_the_end(spark):
    """One rare and one frequent term: the frequent one's list is left after some places."""
    import numpy as np

    n = 20_000
    ids = np.concatenate([[0, 1] if k < 40 else [1] for k in range(n)])
    sizes = np.array([2 if k < 40 else 1 for k in range(n)])
    impacts = np.where(ids == 0, 9_000_000, 1000 + np.arange(len(ids)) % 7)
    block = S.Block(np.arange(n), sizes, ids, impacts)
    looked, score = [], S.Block.score
    block.score = lambda docs, repeats: looked.append(len(docs)) or score(block, docs, repeats)
    got = block.best({0: 1, 1: 1}, np.array([1, 1]), np.zeros((0, 2), "int64"), 1)
    assert sum(looked) < 500 and len(got) == S.TOP
    every = np.add.reduceat(impacts, np.append(0, np.cumsum(sizes))[:-1])
    assert got[:, 1].tolist() == np.lexsort((np.arange(n), -every))[: S.TOP].tolist()
