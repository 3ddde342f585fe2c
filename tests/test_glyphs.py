"""Glyphs in words and answers that are right as well, against all pairs."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from glosswork.operators import glyphs as G
from glosswork.plans import catalogue


def inside(form, text):
    f, t = G.letters(form), G.letters(text)
    return bool(f) and any(t[i : i + len(f)] == f for i in range(len(t)))


def test_letters():
    assert G.letters("책") == ["ㅊ", "ㅐ", "ㄱ"] and G.letters("É") == ["e", "́"] and G.letters("ﬁ") == ["f", "i"] and G.letters("") == []


def test_holders_against_all_pairs(spark):
    rng = random.Random(1)
    words = [(k, "".join(rng.choices("aeéfiﬁ책가ㄱk", k=rng.randrange(0, 7)))) for k in range(150)] + [(900, None), (901, "Kā")]
    units = [(k, "".join(rng.choices("aeéfi책ㄱk ", k=rng.randrange(0, 4)))) for k in range(60)] + [(900, "ㄱ"), (901, "A a"), (902, "  ")]
    got = {(r["unit"], r["word"]) for r in G.holders(spark.createDataFrame(units, "unit int, text string"), spark.createDataFrame(words, "word int, text string")).collect()}
    assert got == {(u, w) for u, t in units for w, x in words if x and any(inside(f, x) for f in t.split())}


def test_holders_deal_words_once(spark):
    words = spark.range(4).select(F.lit("x").alias("lang"), (F.col("id") % 2).alias("word"), F.concat(F.lit("banana"), "id").alias("text"))  # words of two texts
    words = words.unionByName(words)
    units = spark.createDataFrame([("x", 1, "an na"), ("x", 2, "a3 a1"), ("x", 3, "nn")], "lang string, unit int, text string")
    got = G.holders(F.broadcast(units), words, ("lang",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 2
    assert sorted((r["unit"], r["word"]) for r in got.collect()) == [(1, 0), (1, 1), (2, 1)]


def test_glyph_words_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    texts = [(k, rng.choice(["a", "b", None]), " ".join("".join(rng.choices("aeéfiTkß", weights=range(8, 0, -1), k=rng.randrange(1, 6))) for _ in range(12))) for k in range(40)] + [(900, "a", None), (901, "a", "")]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter((lang, w.lower()) for _, lang, text in texts if lang and text for w in text.split())
    pairs = defaultdict(Counter)
    for (lang, w), n in counts.items():
        for i in range(len(w) - 1):
            pairs[lang][w[i : i + 2]] += n
    expected = {(lang, p, w) for lang, c in pairs.items() for p in sorted(c, key=lambda p: (-c[p], p.encode()))[:20] for has, w in counts if has == lang and inside(p, w)}
    got = catalogue.queries()["q175_glyph_words"](spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {(r["lang"], r["unit"], r["word"]) for r in got} == expected


def test_also_right_against_all_pairs(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice(["a", "b", "c", "D", " d ", "", None])
    units = [(k, rng.choice(["X a", "y", "z", "Y"]) + str(k % 7), pick(), pick(), rng.choice([None, [], ["a"], ["b", "d"], ["c"]])) for k in range(40)]
    norm = lambda x: (x or "").strip().lower()

    def right(u, v):
        ur, vr = norm(u[3]), norm(v[3])
        names = lambda x: {norm(n) for n in [x[3], *(x[4] or [])]} - {""}
        return u[0] == v[0] or norm(u[1].split()[-1]) == norm(v[1].split()[-1]) or (norm(u[2]) and norm(u[2]) == norm(v[2])) or (ur and ur == vr) or bool(ur and vr and vr in names(u) and ur in names(v))

    df = spark.createDataFrame(units, "unit int, text string, say string, roman string, alt array<string>")
    got = {(r["unit"], r["other"]) for r in G.also_right(df).collect()}
    assert got == {(u[0], v[0]) for u in units for v in units if right(u, v)}


def test_option_counts_are_those_of_the_pairs(spark):
    rng = random.Random(8)
    some = lambda x: rng.choice(["", None, *x])
    rows = [(k, rng.randrange(3), some(["x A", "b", "c"]), some(["s", " S", "t"]), some(["p", "q", "r", "P"]), rng.choice([None, [], ["p"], ["q", "Q", ""], ["r", "p"], ["q", None]])) for k in range(150)]
    df = spark.createDataFrame(rows, "unit long, stage int, text string, say string, roman string, alt array<string>")
    stage = {r[0]: r[1] for r in rows}
    right = {k: 0 for k in stage}
    for r in G.also_right(df).collect():
        right[r["unit"]] += stage[r["unit"]] == stage[r["other"]]
    size = {s: sum(v == s for v in stage.values()) for s in range(3)}
    old, G.OPTIONS = G.OPTIONS, 1000
    try:
        got = {r["unit"]: r["options"] for r in G.option_counts(df).collect()}
    finally:
        G.OPTIONS = old
    assert got == {k: 1 + size[stage[k]] - right[k] for k in stage}


def test_option_counts_make_no_pairs(spark):
    n = 40000  # of one sound in one stage: 1.6 thousand million pairs
    df = spark.range(n).select(F.col("id").alias("unit"), F.lit(0).alias("stage"), F.col("id").cast("string").alias("text"), F.lit("s").alias("say"), F.col("id").cast("string").alias("roman"), F.array().cast("array<string>").alias("alt"))
    assert [tuple(r) for r in G.option_counts(df).groupBy("options").count().collect()] == [(1, n)]
