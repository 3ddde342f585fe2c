"""Meanings of a gloss: alternatives, groups in brackets, and the keys by which a typed meaning is right.

A gloss is read by brackets' depth, in column expressions: a text is cut into
marks and what stands between them, and a fold over these carries the depth.
Separators inside brackets do not separate; a bracket that is not closed is
text. An alternative with groups in round brackets stands for all texts that
keep some of its first groups and leave out the others.

A key is the alternative's words without accents, case, stops, articles and
what a dictionary writes for persons and things, joined by KEY_SEP, so that
different words never make one key. Null and empty glosses have no keys.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SEP = "\u0001"
#: Groups of an alternative that may be kept or left out, unless a caller says None, for all; more are always kept.
MOST_GROUPS = 4
# Words that are no part of a key, and words that alone are no meaning.
DROPPED = ("a", "an", "the", "sb", "sth", "someone", "somebody", "something", "etc", "eg")
FUNCTION_WORDS = (*DROPPED, "to", "be", "is", "are", "am", "was", "were", "been", "being", "of", "and", "or", "that")
# Notes on a reading, which are shown after the answer and are no meaning.
READING_NOTE = r"(?i)^\(?\s*(also|colloquial)\s+pr\.\s*\[[^\]]*\]\s*\)?$|^\[[^\]]*\]$"
# Stops and apostrophes that part no words.
SILENT = ".'‘’ʼ`"

PIECES = "array<struct<t:string,g:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters alone, by the decomposition that Unicode gives them."""
    pairs = []
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(k):
            pairs.append((chr(k), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(text: Column) -> Column:
    """Latin letters without their marks, and without combining marks."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{M}", "")


def split_top(text: Column, seps: str) -> Column:
    """The parts of a text between separators outside ( ) and [ ]; a closing bracket without an opening one does not count."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([(\[\])]|[{seps}]|[^()\[\]{seps}]+)"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, mark: Column) -> Column:
        depth = s["depth"] + F.when(mark.isin("(", "["), 1).when(mark.isin(")", "]") & (s["depth"] > 0), -1).otherwise(0)
        ends = (depth == 0) & mark.isin(*seps)
        return F.struct(depth.alias("depth"), F.when(ends, "").otherwise(F.concat(s["cur"], mark)).alias("cur"), F.when(ends, F.concat(s["parts"], F.array(s["cur"]))).otherwise(s["parts"]).alias("parts"))

    return F.aggregate(marks, start, step, lambda s: F.concat(s["parts"], F.array(s["cur"])))


def pieces(text: Column) -> Column:
    """array<struct<t, g>>: the outer groups in round brackets (g) of a text and what stands between them, in order."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([()]|[^()]+)"), 1)
    none = F.array().cast(PIECES)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), none.alias("out"))

    def step(s: Column, mark: Column) -> Column:
        opens, closes = mark == "(", (mark == ")") & (s["depth"] > 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begins, ends = opens & (s["depth"] == 0), closes & (depth == 0)
        out = F.when(begins & (s["cur"] != ""), F.concat(s["out"], _piece(s["cur"], False))).when(ends, F.concat(s["out"], _piece(F.concat(s["cur"], mark), True))).otherwise(s["out"])
        return F.struct(depth.alias("depth"), F.when(begins, mark).when(ends, "").otherwise(F.concat(s["cur"], mark)).alias("cur"), out.alias("out"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], _piece(s["cur"], False))).otherwise(s["out"]))


def _piece(text: Column, group: bool) -> Column:
    return F.array(F.struct(text.alias("t"), F.lit(group).alias("g")))


def joined(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: p["t"]), "")


def outside(ps: Column) -> Column:
    """What stands outside the groups."""
    return joined(F.filter(ps, lambda p: ~p["g"]))


def is_note(text: Column) -> Column:
    return F.trim(text).rlike(READING_NOTE)


def words(text: Column) -> Column:
    """The words of a meaning: lower case, without marks and silent stops."""
    bare = F.translate(F.lower(plain(F.coalesce(text, F.lit("")))), SILENT, "")
    return F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def key(text: Column) -> Column:
    """The key of a meaning; the empty text if it has no word."""

    def of(w: Column) -> Column:
        some = F.filter(w, lambda x: ~x.isin(*DROPPED))
        kept = F.when(F.size(some) > 0, some).otherwise(w)
        return let(kept, lambda k: F.array_join(F.when((F.size(k) > 1) & (k[0] == "to"), F.slice(k, 2, 1 << 20)).otherwise(k), KEY_SEP))

    return let(words(text), of)


def has_content(text: Column) -> Column:
    return F.exists(words(text), lambda w: ~w.isin(*FUNCTION_WORDS))


def variants(text: Column, most: int | None = MOST_GROUPS) -> Column:
    """The texts that an alternative stands for: each of its first `most` groups (None: of all) kept, without its brackets, or left out.

    A group written against the word before it is part of that word. Texts grow
    piece by piece, and those that have come out equal go on as one.
    """
    if most is None:

        def grown(ts: Column, p: Column) -> Column:
            kept = F.concat(F.when(p["glued"], "").otherwise(" "), F.substring(p["t"], F.lit(2), F.length(p["t"]) - 2), F.lit(" "))
            ends = F.when(p["g"], F.array(kept, F.lit(" "))).otherwise(F.array(p["t"]))
            return F.array_distinct(F.flatten(F.transform(ts, lambda t: F.transform(ends, lambda e: F.concat(t, e)))))

        glued = lambda ps: F.transform(ps, lambda p, i: F.struct(p["t"].alias("t"), p["g"].alias("g"), ((i > 0) & ~F.coalesce(F.get(ps, i - 1)["t"], F.lit(" ")).rlike(r"\s$")).alias("glued")))
        return let(pieces(text), lambda ps: F.aggregate(glued(ps), F.array(F.lit("")), grown))

    def number(ps: Column) -> Column:
        before = lambda i: F.slice(ps, F.lit(1), i)
        return F.transform(ps, lambda p, i: F.struct(p["t"].alias("t"), p["g"].alias("g"), F.size(F.filter(before(i), lambda q: q["g"])).alias("k"), ((i > 0) & ~F.coalesce(F.get(ps, i - 1)["t"], F.lit(" ")).rlike(r"\s$")).alias("glued")))

    def chosen(ps: Column, mask: Column) -> Column:
        def text_of(p: Column) -> Column:
            keep = (p["k"] >= most) | (F.bit_get(mask, F.least(p["k"], F.lit(most))) == 1)
            inner = F.concat(F.when(p["glued"], "").otherwise(" "), F.substring(p["t"], F.lit(2), F.length(p["t"]) - 2), F.lit(" "))
            return F.when(~p["g"], p["t"]).when(keep, inner).otherwise(F.lit(" "))

        return F.array_join(F.transform(ps, text_of), "")

    def all_of(ps: Column) -> Column:
        groups = F.least(F.size(F.filter(ps, lambda p: p["g"])), F.lit(most))
        return F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), groups).cast("int") - 1), lambda mask: chosen(ps, mask))

    return let(let(pieces(text), number), all_of)


def left_of_or(text: Column) -> Column:
    """What stands before the first " or " outside brackets, if one word follows it outside groups; else the empty text."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([(\[\])]| or |(?:(?! or )[^()\[\]])+)"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found"), F.lit("").alias("left"), F.lit("").alias("right"))

    def step(s: Column, mark: Column) -> Column:
        depth = s["depth"] + F.when(mark.isin("(", "["), 1).when(mark.isin(")", "]") & (s["depth"] > 0), -1).otherwise(0)
        here = ~s["found"] & (depth == 0) & (mark == " or ")
        left = F.when(s["found"] | here, s["left"]).otherwise(F.concat(s["left"], mark))
        return F.struct(depth.alias("depth"), (s["found"] | here).alias("found"), left.alias("left"), F.when(s["found"], F.concat(s["right"], mark)).otherwise(s["right"]).alias("right"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["found"] & (F.size(words(outside(pieces(s["right"])))) == 1), s["left"]).otherwise(F.lit("")))


def alternatives(gloss: Column) -> Column:
    """The alternatives of a gloss without reading notes, as written."""
    bare = lambda a: joined(F.filter(pieces(a), lambda p: ~(p["g"] & is_note(p["t"]))))
    return F.transform(F.filter(split_top(gloss, ";,"), lambda a: ~is_note(a) & (F.trim(a) != "")), bare)


def keys_of(alternative: Column, quality: Callable[[Column], Column] | None = None, most: int | None = MOST_GROUPS) -> Column:
    """The keys of one alternative; quality: a word that a meaning names beside itself, or the empty text; most as in variants."""

    def own(v: Column) -> Column:
        # A lone letter that punctuation leaves is no meaning; one that is all of the text is.
        return let(key(v), lambda k: F.when((k != "") & ~(k.rlike(r"^\p{L}$") & (F.lower(F.trim(v)) != k)), k))

    def all_keys(vs: Column) -> Column:
        made = F.transform(vs, own)
        return F.concat(made, F.transform(vs, lambda v: F.nullif(key(quality(v)), F.lit("")))) if quality else made

    left = let(left_of_or(alternative), lambda t: F.when(t != "", F.transform(F.filter(variants(t, most), has_content), own)).otherwise(F.array().cast("array<string>")))
    open_end = alternative.rlike(r"(…|\.\.\.)\s*$") & ~has_content(outside(pieces(alternative)))
    found = F.concat(let(variants(alternative, most), all_keys), left)
    return F.when(open_end, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda k: k.isNotNull())))


def meaning_keys(gloss: Column, quality: Callable[[Column], Column] | None = None, most: int | None = MOST_GROUPS) -> Column:
    """All keys by which a typed meaning of a gloss is right, each once."""
    return F.array_distinct(F.flatten(F.transform(alternatives(gloss), lambda a: keys_of(a, quality, most))))


def bare_keys(gloss: Column) -> Column:
    """The key of each alternative as it is shown, groups included."""
    return F.filter(F.transform(alternatives(gloss), lambda a: key(F.translate(a, "()", "  "))), lambda k: k != "")


def stripped(k: Column) -> Column:
    """A key as one word."""
    return F.replace(k, F.lit(KEY_SEP), F.lit(""))


def senses(gloss: Column) -> Column:
    """The senses of a gloss, parted by semicolons outside brackets, without reading notes."""
    return F.filter(F.transform(split_top(F.regexp_replace(gloss, r"\s+", " "), ";"), lambda a: F.trim(a)), lambda a: (a != "") & ~is_note(a))
