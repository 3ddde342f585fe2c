"""Glyphs of a script in words, by an inverted index of letters, and answers that are as right as the one asked for."""

from __future__ import annotations

import functools
import itertools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.folding import column
from glosswork.functions.text import norm_key

# Hangul letters by place in the syllable, from their first code points, and the letters they are.
HANGUL = (
    (0x1100, "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"),
    (0x1161, "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"),
    (0x11A8, "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"),
    (0x111A, "ㅀ"),
    (0x1121, "ㅄ"),
)
_LETTERS = {start + k: ord(c) for start, letters in HANGUL for k, c in enumerate(letters)}
#: Options of a choice, the answer among them.
OPTIONS = 4


def spelt(text: str) -> str:
    """A text in the letters and marks by which glyphs are compared: lower case, compatibility forms taken apart, Hangul letters wherever they stand."""
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFKD", low).translate(_LETTERS)


def letters(text: str) -> list[str]:
    """The letters and marks of a text as it is spelt."""
    return list(spelt(text))


def glyph(text: Column) -> Column:
    """The form that is asked of a unit written in several: the last."""
    return F.element_at(F.split(F.trim(text), r"\s+"), -1)


def holders(units: DataFrame, words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, unit, word): the words (*by, word, text) that hold a form of a unit (*by, unit, text; forms parted by blanks), each once.

    A word is a row of the index for each of its letters, however often it has
    it; a form meets the letters equal to its first, and is looked for in the
    whole word there. Empty forms are in no word. Words are a list, as a
    vocabulary is; repeated rows cost as often. They are dealt by (*by, word):
    where units are few and the caller says so (F.broadcast), that is the only
    shuffle, as what a word holds stays with it.
    """
    told = column(spelt, "string").asNondeterministic()  # else words are spelt again in a filter that Spark derives
    form = units.select(*by, "unit", F.explode(F.array_distinct(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))).alias("form"))
    form = form.select(*by, "unit", told("form").alias("f")).withColumn("letter", F.substring("f", 1, 1))
    index = words.select(*by, "word", told("text").alias("t")).repartition(*by, "word").select(*by, "word", "t", F.explode_outer(F.array_distinct(F.split("t", ""))).alias("letter"))
    met = index.join(form.filter("f <> ''"), [*by, "letter"])
    return met.filter(F.contains("t", "f")).select(*by, "unit", "word").distinct()


def _normal(units: DataFrame, *cols: str) -> DataFrame:
    return units.select(*cols, norm_key(glyph(F.col("text"))).alias("form"), norm_key(F.col("say")).alias("say"), norm_key(F.col("roman")).alias("roman"), F.transform(F.coalesce("alt", F.array().cast("array<string>")), norm_key).alias("alt"))


def also_right(units: DataFrame) -> DataFrame:
    """(unit, other): units that are as right as one, each itself too: of the same form, sound or name, or named by each other's other names.

    units: (unit, text, say, roman, alt: array). Blank names and sounds are like none.
    """
    x = _normal(units, "unit")
    out = x.select("unit", F.col("unit").alias("other"))
    for c in ("form", "say", "roman"):
        one = x.filter(F.col(c) != "").select("unit", c)
        out = out.unionByName(one.join(one.select(F.col("unit").alias("other"), c), c).select("unit", "other"))
    # The name of either is an other name of the other: a join on both names.
    named = x.filter("roman <> ''").select("unit", "roman", F.explode("alt").alias("name")).filter("name <> ''").distinct()
    two_way = named.join(named.select(F.col("unit").alias("other"), F.col("name").alias("roman"), F.col("roman").alias("name")), ["roman", "name"])
    return out.unionByName(two_way.select("unit", "other")).distinct()


def option_counts(units: DataFrame) -> DataFrame:
    """(unit, stage, options): how many options a choice of a unit has, the answer among them, up to OPTIONS; what is as right as the answer is none.

    units: as in also_right, a row each, with their stage; options come from one
    stage. No pairs are made: how many units share a form, a sound or a name is
    the sum of those that share some of these, less those that share two, and so
    on; those of each other's names are another name's and hence counted apart.
    Units alike in all of these are counted as one row with its number.
    """
    own = ("form", "say", "roman")
    x = _normal(units, "unit", "stage").withColumns({c: F.coalesce(c, F.lit("")) for c in own}).filter("stage IS NOT NULL")
    size = x.groupBy("stage").agg(F.count("*").alias("size"))
    alike = x.groupBy("stage", *own).agg(F.count("*").alias("c"))
    shared = _less_shared(alike, alike, [list(s) for k in (1, 2, 3) for s in itertools.combinations(own, k)], "shared")
    shared = shared.withColumn("shared", F.col("shared") + F.when((F.col("form") == "") & (F.col("say") == "") & (F.col("roman") == ""), 1).otherwise(0))
    names = F.array_distinct(F.filter("alt", lambda a: (a != "") & (a != F.col("roman")) & (F.col("roman") != "")))
    named = x.select("unit", "stage", *own, F.explode(names).alias("name"))
    kinds = named.groupBy("stage", *own, "name").agg(F.count("*").alias("c"))
    others = kinds.select("stage", "form", "say", F.col("name").alias("roman"), F.col("roman").alias("name"), "c")  # those that a unit's name and other name are the other way round
    more = _less_shared(kinds, others, [["roman", "name", *s] for k in (0, 1, 2) for s in itertools.combinations(("form", "say"), k)], "more")
    more = named.join(more, ["stage", *own, "name"]).groupBy("unit").agg(F.sum("more").alias("more"))
    out = x.select("unit", "stage", *own).join(shared, ["stage", *own]).join(more, "unit", "left").join(size, "stage")
    n = F.col("shared") + F.coalesce("more", F.lit(0))
    return out.select("unit", "stage", F.least(F.lit(OPTIONS).cast("long"), 1 + F.col("size") - n).alias("options"))


def _less_shared(rows: DataFrame, counted: DataFrame, keys: list[list[str]], name: str) -> DataFrame:
    """rows with the sum over sets of columns of how many of `counted` (c each) share all of a set within the stage, by turns added and taken off by the set's size; blanks are shared by none."""
    least = min(len(k) for k in keys)
    out, total = rows.drop("c"), F.lit(0).cast("long")
    for i, key in enumerate(keys):
        some = functools.reduce(lambda a, b: a & b, [F.col(c) != "" for c in key])
        n = counted.filter(some).groupBy("stage", *key).agg(F.sum("c").alias(f"_{i}"))
        out = out.join(n, ["stage", *key], "left")
        total = total + (1 if (len(key) - least) % 2 == 0 else -1) * F.coalesce(f"_{i}", F.lit(0))
    return out.select(*rows.drop("c").columns, total.alias(name))
