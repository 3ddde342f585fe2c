"""Readings over mixed writing: which part of a reading each run of characters has, as column expressions.

A writing is runs of kana, which the reading repeats, and runs of other
characters, each of which has one letter of the reading at least. A pattern
made of the runs is matched twice, each open run as short as can be and as long
as can be, from the left; where both agree there is one way only to split the
reading. Katakana reads as hiragana.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.meanings import let

KANA = r"ぁ-ゖゝゞー"
_KATAKANA = "".join(map(chr, (*range(0x30A1, 0x30F7), 0x30FD, 0x30FE)))
_HIRAGANA = "".join(chr(ord(c) - 0x60) for c in _KATAKANA)


def hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def split_reading(writing: Column, reading: Column) -> Column:
    """struct<status, parts>: parts is array<struct<text, reading>>, a kana run without a reading of its own.

    status: `one` way to split, `several` or `none`, where there are no parts.
    Null writing or reading, and an empty one, has none.
    """
    runs = F.regexp_extract_all(hiragana(F.coalesce(writing, F.lit(""))), F.lit(f"([{KANA}]+|[^{KANA}]+)"), 1)
    empty = F.array().cast("array<struct<text:string,reading:string>>")

    def split(rs: Column) -> Column:
        # What each run asks for is made once a row.
        kana = F.transform(rs, lambda r: r.rlike(f"^[{KANA}]"))
        return let(kana, lambda ks: let(told(rs, ks), lambda v: parts_of(rs, ks, v)))

    def told(rs: Column, ks: Column) -> Column:
        quoted = lambda r: F.concat(F.lit(r"\Q"), r, F.lit(r"\E"))
        shape = lambda group: F.concat(F.lit("^"), F.array_join(F.transform(rs, lambda r, i: F.when(F.get(ks, i), quoted(r)).otherwise(F.lit(group))), ""), F.lit("$"))
        # As the runs of the writing itself, not of its fold.
        own = F.regexp_extract_all(writing, F.lit(f"([{KANA}{_KATAKANA[0]}-{_KATAKANA[-3]}]+|[^{KANA}{_KATAKANA[0]}-{_KATAKANA[-3]}]+)"), 1)
        return F.struct(shape("(.+?)").alias("short"), shape("(.+)").alias("long"), hiragana(F.coalesce(reading, F.lit(""))).alias("said"), F.size(F.filter(ks, lambda k: ~k)).alias("n"), own.alias("own"))

    def parts_of(rs: Column, ks: Column, v: Column) -> Column:
        groups = lambda pattern: F.when(v["n"] > 0, F.transform(F.sequence(F.lit(1), v["n"]), lambda i: F.call_function("regexp_extract", v["said"], pattern, i))).otherwise(F.array().cast("array<string>"))
        fits = (F.size(rs) > 0) & F.call_function("rlike", v["said"], v["short"])
        numbers = lambda i: F.size(F.filter(F.slice(ks, F.lit(1), i + 1), lambda k: ~k))
        made = lambda gs: F.transform(rs, lambda r, i: F.struct(F.get(v["own"], i).alias("text"), F.when(~F.get(ks, i), F.get(gs, numbers(i) - 1)).alias("reading")))
        one = let(groups(v["short"]), lambda a: let(groups(v["long"]), lambda b: F.when(a == b, made(a))))
        return F.when(fits, let(one, lambda p: F.struct(F.when(p.isNull(), "several").otherwise("one").alias("status"), F.coalesce(p, empty).alias("parts")))).otherwise(F.struct(F.lit("none").alias("status"), empty.alias("parts")))

    return let(runs, split)


def token_parts(text: Column, reading: Column, word: Column, parts: Column) -> Column:
    """The parts of a token that is exactly a word and has the word's own reading; null for another reading, another span, or a word of one part that has a reading."""
    whole = F.array_join(F.transform(parts, lambda p: F.coalesce(p["reading"], p["text"])), "")
    several = (F.size(parts) > 1) | F.exists(parts, lambda p: p["reading"].isNull())
    return F.when((text == word) & (hiragana(whole) == hiragana(F.coalesce(reading, F.lit("")))) & several, parts)
