"""Syllables, component trees, rotating subsets and token places against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from glosswork.functions import combinations as K
from glosswork.functions import spans
from glosswork.operators import segments as S


def test_subsets_by_number(spark):
    rows = [(n, k, i) for n in range(7) for k in range(6) for i in range(-1, math.comb(n, k) + 1)] + [(40, 6, math.comb(40, 6) - 1)]
    x = spark.createDataFrame(rows, "n int, k int, i long").select("n", "k", "i", K.unranked(F.col("n"), F.col("k"), F.col("i")).alias("s")).collect()
    every = {(n, k): list(itertools.combinations(range(n), k)) for n in range(7) for k in range(6)}
    for r in x:
        if r["n"] < 7:
            some = every[r["n"], r["k"]]
            assert r["s"] == (list(some[r["i"]]) if 0 <= r["i"] < len(some) else None)
        else:
            assert r["s"] == list(range(34, 40))


def test_a_walk_visits_every_subset(spark):
    x = spark.range(math.comb(8, 3)).select(K.rotating(F.col("id"), F.lit(8), F.lit(3)).alias("s")).collect()
    got = [tuple(r["s"]) for r in x]
    assert set(got) == set(itertools.combinations(range(8), 3)) and max(len(set(a) & set(b)) for a, b in itertools.pairwise(got)) < 3


def best(word, inventory):
    found = []

    def go(at, cost, parts):
        if at == len(word):
            found.append((cost, [-len(p) for p in parts], parts))
        for n in range(1, 8):
            p = word[at : at + n]
            if len(p) == n and p in inventory:
                go(at + n, cost + 1 + (10 if at and p[0] in "aoe" else 0), [*parts, p])

    go(0, 0, [])
    return min(found)[2] if found else None


def test_syllables(spark):
    rng = random.Random(3)
    inventory = {"".join(rng.choices("xaneg", k=rng.randrange(1, 4))) for _ in range(25)} | {"xi", "an", "xian", "fang", "fan", "gan", "er"}
    words = {"".join(rng.choices("xaneg", k=rng.randrange(1, 9))) for _ in range(200)} | {"xian", "fangan", "q", "xianer"}
    got = S.syllables(spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "word string"), spark.createDataFrame([(s,) for s in inventory], "syllable string")).collect()
    assert {r["word"]: r["parts"] for r in got} == {w: best(w, inventory) for w in words}


def test_numbered_ways(spark):
    x = spark.createDataFrame([(["yi", "hui", "er"], [1, 4, 5])], "s array<string>, t array<int>")
    ways = F.transform(F.arrays_zip("s", "t"), lambda p: S.numbered(p["s"], p["t"]))
    assert x.select(S.products(ways)).first()[0] == ["yi1hui4er5", "yi1hui4er0", "yi1hui4er"]
    assert x.select(S.products(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda _: F.array(F.lit("a"), F.lit("b"), F.lit("c"))))).first()[0] == []


def test_trees_in_prefix_notation(spark):
    cases = {"⿰氵⿱艹田": [("⿰", -1, 0), ("氵", 0, 0), ("⿱", 0, 1), ("艹", 2, 0), ("田", 2, 1)], "⿲彳言亍": [("⿲", -1, 0), ("彳", 0, 0), ("言", 0, 1), ("亍", 0, 2)], "木": [("木", -1, 0)], "⿰木": None, "木木": None, "": None, "⿰木林森": None}
    x = spark.createDataFrame([(k,) for k in cases], "d string").select("d", S.tree(F.filter(F.split("d", ""), lambda m: m != "")).alias("t")).collect()
    assert {r["d"]: r["t"] and [tuple(n) for n in r["t"]] for r in x} == cases


def test_components_down_to_leaves(spark):
    rows = [("萌", "⿱艹明"), ("明", "⿰日月"), ("林", "⿰木木"), ("森", "⿱木林"), ("a", "⿰bc"), ("b", "⿰ad"), ("x", "⿰y"), ("u", "⿰？日")]
    parts = S.components(spark.createDataFrame(rows, "whole string, description string"))
    got = {}
    for r in S.leaves(parts).collect():
        got.setdefault(r["whole"], set()).add(r["leaf"])
    assert got == {"萌": {"艹", "日", "月"}, "明": {"日", "月"}, "林": {"木"}, "森": {"木"}, "a": {"c", "d"}, "b": {"c", "d"}, "u": {"日"}}


SPAN_CASES = [
    # text, tokens, fold, joiners, places
    ("The cat, the CAT.", ["the", "cat", "the", "cat"], None, "", [(0, 3), (4, 7), (9, 12), (13, 16)]),
    ("mercato e pane", ["e"], None, "", [None]),  # not inside a word, and no letter may be passed over
    ("del mercato e pane", ["de", "il", "mercato", "e", "pane"], None, "", [(0, 2), None, (4, 11), (12, 13), (14, 18)]),
    ("one two three", ["x", "three"], None, "", [None, None]),  # more letters than the lost token has
    ("one two three", ["abcdef", "three"], None, "", [None, (8, 13)]),
    ("one two", ["abc", "tw"], None, "", [None, None]),  # after a lost token a word's end
    ("می‌روم خانه", ["میروم", "خانه"], None, "‌", [(0, 6), (7, 11)]),
    ("laß das", ["lass", "das"], lambda s: s.replace("ß", "ss"), "", [(0, 3), (4, 7)]),
    ("über all", ["uber", "all"], lambda s: s.lower().replace("ü", "u"), "", [(0, 4), (5, 8)]),
    ("ét x", ["e", "zz", "t"], None, "", [(0, 2), None, (2, 3)]),
    ("لطفاً بیا", ["لطفا", "بیا"], None, "", [(0, 5), (6, 9)]),
    ("a - b", ["a", "-", "b", ""], None, "", [(0, 1), (2, 3), (4, 5), None]),
    ("", ["a"], None, "", [None]),
    ("😀 ok", ["😀", "OK"], None, "", [(0, 1), (2, 4)]),
]


@pytest.mark.parametrize("case", SPAN_CASES, ids=range(len(SPAN_CASES)))
def test_token_places(case):
    text, tokens, fold, joiners, places = case
    assert spans.token_offsets(text, tokens, fold, joiners) == places


def test_token_places_as_a_column(spark):
    x = spark.createDataFrame([("The cat", ["the", "x", "cat"]), (None, ["a"]), ("a", None)], "t string, k array<string>")
    got = x.select(spans.token_places()("t", "k").alias("p")).collect()
    assert [[p and tuple(p) for p in r["p"]] for r in got] == [[(0, 3), None, (4, 7)], [None], []]


def test_token_places_make_no_pattern_for_each_token(monkeypatch):
    monkeypatch.setattr(spans.re, "compile", lambda *_: pytest.fail("a pattern for a token"))
    words = [f"Wort{k}" for k in range(200)]
    said = [w.lower() + ("x" if k % 7 == 3 else "") for k, w in enumerate(words)]
    got = spans.token_offsets(", ".join(words), said)
    assert [x is None for x in got] == [k % 7 == 3 for k in range(200)]
    assert spans.token_offsets("ſie KK", ["SIE", "kk"]) == [(0, 3), (4, 6)]
