import random

import numpy as np
import pytest

from glosswork.llm import near_dups
from glosswork.llm.shingles import DF_BITS, Sampler, bands, df_bucket, idf_levels, jaccard, shingles, weights

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Classes by comparing all pairs of texts."""
    texts = [t or "" for _, t in rows]
    x, times, n = shingles(texts)
    levels = idf_levels(np.bincount(df_bucket(x), minlength=1 << DF_BITS), len(texts))
    w, e = weights(x, times, levels), np.append(0, np.cumsum(n))
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for p in range(len(rows)):
        for q in range(p):
            a, b = slice(e[p], e[p + 1]), slice(e[q], e[q + 1])
            if texts[p] == texts[q] or n[p] and n[q] and jaccard(x[a], w[a], x[b], w[b]) >= 0.8:
                up[find(p)] = find(q)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values()}


def found(spark, rows):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA)
    got = near_dups.classes(df).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class_id"], set()).add(r["doc_id"])
    assert len(got) == len(rows)
    assert all(min(g) == c for c, g in groups.items())
    return {frozenset(g) for g in groups.values()}


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def edited(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = words(rng, 1)[0]
    return " ".join(out)


def test_groups_around_a_base_match_brute_force(spark):
    rng = random.Random(4)
    base, other, passage = words(rng, 150), words(rng, 400), words(rng, 60)
    rows = [(0, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 8, 12]))) for _ in range(60)]
    rows += [(0, " ".join(base[: rng.randrange(100, 150)])) for _ in range(15)]
    rows += [(0, edited(rng, other, rng.choice([0, 2, 6, 10]))) for _ in range(15)]
    rows += [(0, " ".join(words(rng, 30) + passage + words(rng, 30))) for _ in range(25)]
    rows += [(0, " ".join(words(rng, 40))) for _ in range(20)] + [(0, " ".join(base))] * 3
    assert found(spark, rows) == brute(rows)


def test_components_in_one_task_and_in_turns(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)] + [(500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = [{(r["node"], r["root"]) for r in near_dups.components(df, local).collect()} for local in (1 << 20, 0)]
    assert got[0] == got[1] and (430, 400) in got[0]


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "one two"), (5, "one two three"), (6, "x " * 30000), (7, "x " * 30000 + "y"), (8, " \n ")]
    df = spark.createDataFrame([(*r, "x", b"y", 3) for r in rows], SCHEMA + ", class_id string, digest binary, node int")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 8: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}
    assert near_dups.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_representatives_keep_columns_and_repeated_rows_count_once(spark):
    rows = [(1, "a b c d e f g", "k"), (1, "a b c d e f g", "k"), (2, "a b c d e f g", "l"), (None, "q r s t u v", "m"), (5, "other words are here too", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = near_dups.representatives(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 1), (False, 5), (True, None)]


@pytest.mark.parametrize("share", [0.95, 0.8, 0.5])
def test_samples_agree_as_often_as_the_similarity_says(share):
    rng = random.Random(1)
    text = " ".join(words(rng, 800))
    x, times, n = shingles([text])
    w = weights(x, times, np.full(1 << DF_BITS, 200, "uint8"))
    keep = np.random.default_rng(2).random(len(x)) < share
    s = Sampler(1500).sample(np.concatenate([x, x[keep]]), np.concatenate([w, w[keep]]), np.array([len(x), keep.sum()]))
    assert abs((s[0] == s[1]).mean() - jaccard(x, w, x[keep], w[keep])) < 0.06
    assert (bands(s, 10)[0] == bands(s[:1], 10)[0]).all()
