"""Names that are spelt alike in two writings, by their consonants, without comparing all with all."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.meanings import let

# Spellings of one sound in English names, in the order in which they are made one, and letters that may be missing in another writing.
SOUNDS = (("ph", "f"), ("th", "t"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("ck", "k"), ("qu", "k"), ("x", "ks"), ("q", "k"), ("w", "v"), ("c", "k"))
UNWRITTEN = "aeiouyhv"
FLOOR = 0.6
#: Pairs of skeletons whose likeness a task remembers.
CACHED = 1 << 17


def skeleton(name: Column) -> Column:
    """The consonants of a name in Latin letters, sounds made one, doubled ones once; what follows an apostrophe does not count."""
    out = F.get(F.split(F.lower(name), "['’]"), F.lit(0))
    for a, b in SOUNDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, f"[{UNWRITTEN}]|[^a-z]", ""), r"(.)\1+", "$1")


def _marks(s: Column, floor: float) -> Column:
    """The letters of a skeleton, told apart by their number, in the order of the alphabet, as many as one of which a skeleton near it must have.

    Two skeletons of m and n letters of likeness `floor` share floor / 2 * (m + n)
    letters at least, and n is m * floor / (2 - floor) at least; so they share one
    of the first m - ceil(m * floor / (2 - floor)) + 1.
    """
    # Equal letters stand together, so a letter's number is its distance from the first of them.
    told = lambda letters: F.transform(letters, lambda c, i: F.concat(c, (i + 2 - F.array_position(letters, c)).cast("string")))
    return F.slice(let(F.sort_array(F.split(s, "")), told), F.lit(1), F.length(s) - F.ceil(F.length(s) * (floor / (2 - floor)) - 1e-9).cast("int") + 1)


def _near(floor: float) -> Callable[[str, str], bool]:
    """Whether two skeletons have the likeness; the last CACHED answers are kept, and letters that they share are counted before their order is looked at. No letter is junk, however long a skeleton is."""

    @functools.lru_cache(CACHED)
    def near(x: str, y: str) -> bool:
        if x == y:
            return True
        least = floor * (len(x) + len(y)) / 2 - 1e-9
        return sum(min(x.count(c), y.count(c)) for c in set(x)) >= least and SequenceMatcher(None, x, y, autojunk=False).ratio() >= floor

    return near


def alike(names: DataFrame, tokens: DataFrame, by: list[str], floor: float = FLOOR) -> DataFrame:
    """(*by, name, token): the tokens (*by, token, skeleton) that may spell a name (*by, name, skeleton), of likeness `floor` or more.

    Skeletons meet where they share `by` (a story, a sentence) and one of their
    first letters, and only if their lengths allow it. Names and tokens go along
    with them, so both are read once, and only pairs that are alike are dealt
    anew. An empty skeleton is like nothing.
    """
    side = lambda df, c, s: df.filter("skeleton <> ''").select(*by, c, F.col("skeleton").alias(s), F.explode(_marks(F.col("skeleton"), floor)).alias("mark"))
    m, n = F.length("a"), F.length("b")
    met = side(names, "name", "a").join(side(tokens, "token", "b"), [*by, "mark"]).filter((m >= n * (floor / (2 - floor)) - 1e-9) & (n >= m * (floor / (2 - floor)) - 1e-9))

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        told = _near(floor)
        for a, b in batches:
            yield pd.Series([told(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return met.filter(near("a", "b")).select(*by, "name", "token").distinct()
