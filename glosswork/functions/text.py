"""Scalar functions on text that built-in expressions can say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(x: Column) -> Column:
    """Trimmed, lower case."""
    return F.lower(F.trim(x))


def gloss(x: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_two_words(x: Column) -> Column:
    """The first two words of letters a to z, the key of near synonyms."""
    return F.array_join(F.slice(F.split(F.regexp_replace(F.lower(x), r"[^a-z\s]", ""), r"\s+"), 1, 2), " ")


def german_ascii(x: Column) -> Column:
    """Umlauts and sharp s as ASCII digraphs."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def iso_day_number(x: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(x, F.lit("1970-01-01").cast("date"))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 code units, in which offsets of spans are counted."""
    return (F.octet_length(F.encode(x, "UTF-16LE")) / 2).cast("int")


def utf16_index(x: Column, i: Column) -> Column:
    """The UTF-16 offset of code point i."""
    return utf16_length(F.substring(x, F.lit(1), i))


def bead_ratio(a: Column, b: Column) -> Column:
    """|ln| of the smoothed length ratio of two texts."""
    return F.abs(F.ln((F.length(a) + 12) / (F.length(b) + 12)))


def streak_tier(s: Column, hold: int = 2, mastered: int = 3) -> Column:
    return F.when(s >= mastered, 2).when(s >= hold, 1).otherwise(0)


def passage_units(x: Column, letters: bool = False) -> Column:
    """Length of a passage in words, or in letters for scripts without spaces."""
    return F.size(F.regexp_extract_all(x, F.lit(r"(\p{L})" if letters else r"(\p{L}+)"), 1))


def strip_parens(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\([^()]*\)|\[[^\[\]]*\]", " "), r"\s+", " "))


def gloss_alternatives(x: Column, most: int = 3) -> Column:
    """The first alternatives of a gloss, without brackets, labels before a colon and repeated ones."""
    parts = F.transform(F.split(strip_parens(x), r"\s*[;,]\s*"), lambda p: F.regexp_replace(F.trim(p), r"^[a-z]+:\s*", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, most)


def gloss_fault(x: Column) -> Column:
    """The first thing a gloss audit finds: cut off, brackets only, long, many alternatives; null if nothing."""
    return (
        F.when(x.rlike(r"(\.\.\.|…)$"), "truncated")
        .when(strip_parens(x) == "", "brackets")
        .when(F.length(x) > 45, "long")
        .when(F.size(F.split(x, "[;,]")) >= 5, "many")
    )
