"""Names by consonants, readings over mixed writing, search forms and sweeps against brute force."""

import itertools
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from glosswork.functions import folding
from glosswork.functions import readings as D
from glosswork.operators import linking, names, planners, units
from glosswork.plans.catalogue import queries


def test_skeletons(spark):
    cases = {"Philip": "flp", "Shakira": "skr", "Jack's": "jk", "Quinn": "kn", "Max": "mks", "Ahmed": "md", "Wendy": "nd", "": "", "Aia": "", "Anna-Maria": "nmr"}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.skeleton(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == cases


@pytest.mark.parametrize("floor", [0.6, 0.8, 1.0])
def test_names_alike_against_all_pairs(spark, floor):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bkdfglmnrst", k=rng.randrange(0, 7)))
    a = [(rng.randrange(3), f"N{k}", word()) for k in range(90)]
    b = [(rng.randrange(3), f"t{k}", word()) for k in range(160)]
    got = names.alike(spark.createDataFrame(a, "story int, name string, skeleton string"), spark.createDataFrame(b, "story int, token string, skeleton string"), ["story"], floor).collect()
    want = {(s, n, t) for s, n, x in a for r, t, y in b if s == r and x and y and SequenceMatcher(None, x, y).ratio() >= floor - 1e-12}
    assert {(r["story"], r["name"], r["token"]) for r in got} == want and len(got) == len(want)


def test_a_spelt_name_drops_a_pair(spark):
    rows = [(1, "miina geht nach hause.", "Meena goes back home.", ["Tom"], ["miina"]), (2, "sie geht nach hause.", "She goes back home.", ["Tom"], ["miina"]), (3, "sie geht oft heim.", "She goes home often.", None, None)]
    pairs = spark.createDataFrame(rows, "k int, target string, english string, names array<string>, spelt array<string>")
    got = {r["k"]: r["reason"] for r in linking.story_drops(pairs, ["k"]).collect()}
    assert got == {1: "story_name", 2: "", 3: ""}


def splits(writing, reading):
    runs, found = re.findall("[ぁ-ゖー]+|[^ぁ-ゖー]+", writing), []

    def go(k, at, parts):
        if k == len(runs):
            if at == len(reading):
                found.append(parts)
            return
        if re.match("[ぁ-ゖー]", runs[k]):
            if reading.startswith(runs[k], at):
                go(k + 1, at + len(runs[k]), [*parts, (runs[k], None)])
        else:
            for end in range(at + 1, len(reading) + 1):
                go(k + 1, end, [*parts, (runs[k], reading[at:end])])

    if runs:
        go(0, 0, [])
    return found


def test_readings_against_all_splits(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices("あい漢字", k=rng.randrange(0, 6))), "".join(rng.choices("あいう", k=rng.randrange(0, 8)))) for _ in range(400)]
    rows += [("食べ物", "たべもの"), ("お茶", "おちゃ"), ("母はは", "ははは"), ("ab", "(x"), ("木.い", "き.い")]
    x = spark.createDataFrame(rows, "w string, r string").select("w", "r", D.split_reading(F.col("w"), F.col("r")).alias("x")).collect()
    for r in x:
        every = splits(r["w"], r["r"])
        assert r["x"]["status"] == ("none" if not every else "one" if len(every) == 1 else "several"), r
        assert [tuple(p) for p in r["x"]["parts"]] == (every[0] if len(every) == 1 else [])


def test_katakana_and_nulls(spark):
    x = spark.createDataFrame([("カバン屋", "かばんや"), (None, "a"), ("漢", None), ("漢", "")], "w string, r string").select(D.split_reading(F.col("w"), F.col("r")).alias("x")).collect()
    assert [(r["x"]["status"], [tuple(p) for p in r["x"]["parts"]]) for r in x] == [("one", [("カバン", None), ("屋", "や")]), ("none", []), ("none", []), ("none", [])]


def test_token_parts(spark):
    rows = [("食べ物", "たべもの", "食べ物"), ("食べ物", "しょくもつ", "食べ物"), ("食べ", "たべ", "食べ物"), ("水", "みず", "水"), ("食べ物", "タベモノ", "食べ物")]
    x = spark.createDataFrame(rows, "t string, r string, w string")
    word = D.split_reading(F.col("w"), F.when(F.col("w") == "水", "みず").otherwise("たべもの"))["parts"]
    got = [r["p"] and len(r["p"]) for r in x.select(D.token_parts(F.col("t"), F.col("r"), F.col("w"), word).alias("p")).collect()]
    assert got == [3, None, None, None, 3]


def test_the_article_is_optional_in_search():
    a, b = folding.search_forms("الكتاب"), folding.search_forms("كتاب")
    assert set(a) & set(b) and folding.search_forms("ال") == [folding.search_fold("ال")]
    assert folding.search_forms("two words") == ["two words", "twowords"] and folding.search_forms("") == []


def test_sweep_of_a_placement(spark):
    results = spark.createDataFrame([(1, 0, True), (1, 3, True), (1, 4, False), (2, 0, False)], "learner int, bucket int, passed boolean")
    swept = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 2, True), (1, 9, True)], "learner int, bucket int, right boolean")
    got = {(r["learner"], r["bucket"]): r["how"] for r in planners.placement_sweep(results, 6, swept).collect()}
    assert got == {(1, 0): "probed", (1, 1): "missed", (1, 2): "right", (1, 3): "probed"}
    assert planners.placement_sweep(results, 6, swept.limit(0)).filter("how = 'open'").count() == 2


def test_excerpt_runs_against_all_runs(spark):
    rng = random.Random(2)
    pages = [(s, p, lv, w, rng.randrange(w + 1)) for s in range(4) for p in range(rng.randrange(1, 15)) for w in [rng.randrange(0, 30)] for lv in (0, 1)]
    levels = [(0, 10, 40, 0.5), (1, 25, 90, 0.6)]
    got = {(r["story"], r["lv"]): r["runs"] for r in units.excerpt_runs(spark.createDataFrame(pages, "story int, page int, lv int, words int, known int"), spark.createDataFrame(levels, "lv int, least int, most int, coverage double")).collect()}
    want = {}
    for lv, least, most, coverage in levels:
        for s in range(4):
            own = sorted(x for x in pages if x[0] == s and x[2] == lv)
            for i, j in itertools.combinations_with_replacement(range(len(own)), 2):
                w, k = sum(x[3] for x in own[i : j + 1]), sum(x[4] for x in own[i : j + 1])
                if least <= w <= most and k >= coverage * w:
                    want[s, lv] = want.get((s, lv), 0) + 1
    assert got == want


def test_long_skeletons_are_alike(spark):
    a = "".join(random.Random(5).choices("bkdfglmnrst", k=240))
    frame = lambda c, s: spark.createDataFrame([(1, c, s)], f"story int, {c} string, skeleton string")
    assert names.alike(frame("name", a), frame("token", a[:120] + "z" + a[121:]), ["story"], 0.9).count() == 1


def test_names_of_a_text_are_alike_by_six_tenths(spark, tmp_path):
    rows = [(1, "We met Martin there. Some merten and marden, nobody else", "en", "s", 50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["name"], r["token"]) for r in queries()["q172_name_likeness"](spark, str(tmp_path)).collect()}
    assert got == {("Martin", "merten"), ("Martin", "marden")}  # mrtn, mrtn and mrdn: 0.75
