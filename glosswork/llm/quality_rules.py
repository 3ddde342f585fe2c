"""Quality rules: a table of thresholds compiled into one projection.

Every metric of a text and the verdict are built-in expressions of a single
projection, so there is no shuffle, no join and no Python: each row is judged
by the task that reads it, at any scale.

Defined results: a null text counts as one with no words (every count 0,
rejected by the word floor). Texts of any length are taken whole. Repeated
rows and ties give repeated rows; an empty table gives an empty result. Extra
columns stay as they are; an input column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, free, let, table

#: Frequent short words of the four languages that the rules know.
STOP_WORDS = (
    "a and are as at be but by for from had has have he her his i in is it its not of on or that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur sich sie sind so und von vor war wie wir zu zum zur "
    "al como con de del donde el ella en es esta este ha hay la las lo los más me mi muy no o para pero por que se si sin sobre su sus también un una y ya"
)


_STOP = sorted(set(STOP_WORDS.split()))


@dataclass(frozen=True)
class Rule:
    """A metric must lie in [least, most]; None leaves that side open."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The table that is compiled. Ratios are of words, lines or characters as their names say.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("bangs", "bangs_per_word", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.02),
    Rule("letters", "letter_word_ratio", least=0.6),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.3),
)


def _repeat_words(w: Column) -> Column:
    """Words that lie in some window of three which the text has twice or more.

    Each window becomes one long: high bits of a hash, low bits its place, as
    many as the text needs. Sorted, equal windows are neighbours, which the
    words themselves then confirm. The marked windows' places are sorted again
    and the lengths of their union summed: n log n, with no shuffle.
    """
    n = F.size(w)
    bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

    def counted(ww: Column, b: Column, ones: Column) -> Column:
        # (hash with the low bits cleared) | place
        keys = F.transform(
            F.sequence(F.lit(0), F.size(ww) - 3),
            lambda i: F.xxhash64(ww[i], ww[i + 1], ww[i + 2]).bitwiseAND(F.bitwise_not(ones)).bitwiseOR(i.cast("long")),
        )

        def same(x: Column, y: Column) -> Column:
            i, j = x.bitwiseAND(ones).cast("int"), y.bitwiseAND(ones).cast("int")
            return (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(ones)) == 0) & (ww[i] == ww[j]) & (ww[i + 1] == ww[j + 1]) & (ww[i + 2] == ww[j + 2])

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            hit = F.filter(s, lambda x, k: F.when(k > 0, same(x, s[k - 1])).otherwise(False) | F.when(k < last, same(x, s[k + 1])).otherwise(False))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(ones)))

        def union(p: Column) -> Column:
            last = F.size(p) - 1
            return F.aggregate(
                F.transform(p, lambda x, k: F.when(k < last, F.least(F.lit(3).cast("long"), p[k + 1] - x)).otherwise(F.lit(3).cast("long"))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return let(F.sort_array(keys), lambda s: let(places(s), union))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        let(F.struct(w.alias("w"), bits.alias("b")), lambda t: let(F.expr("1L").cast("long"), lambda one: counted(t["w"], t["b"], F.call_function("shiftleft", one, t["b"]) - 1)))
    )


def metrics(text: Column) -> Column:
    """A struct of all that the rules look at, from whole text."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
        return let(F.struct(t.alias("t"), words.alias("w"), lines.alias("l")), counts)

    def counts(x: Column) -> Column:
        t, w, lines = x["t"], x["w"], x["l"]
        total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, y: s + f(y))
        one = lambda c: F.when(c, 1).otherwise(0).cast("long")
        bare = F.split(F.lower(F.regexp_replace(t, r"[^\p{L}\x20\x09-\x0D]", "")), SPACE)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            total(w, F.length).alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(t, r"[^!]", "")).cast("long").alias("n_bangs"),
            F.size(F.filter(bare, lambda y: y.isin(*_STOP))).cast("long").alias("n_stop"),
            F.size(F.filter(bare, lambda y: y != "")).cast("long").alias("n_letter_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            total(lines, lambda y: one(F.ltrim(y).rlike(r"^[-*•]\s"))).alias("n_bullet_lines"),
            total(lines, lambda y: one(F.rtrim(y).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return let(text, of)


def _ratios(m: Column) -> dict[str, Column]:
    per = lambda a, b: m[a] / F.greatest(m[b], F.lit(1).cast("long"))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "bangs_per_word": per("n_bangs", "n_words"),
        "stop_word_ratio": per("n_stop", "n_words"),
        "letter_word_ratio": per("n_letter_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
    }


def compiled(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as an array."""
    ratios, broken = _ratios(m), []
    for r in rules:
        x = ratios.get(r.metric, m[r.metric] if r.metric not in ratios else None)
        out = F.lit(False)
        if r.least is not None:
            out = out | (x < F.lit(r.least))
        if r.most is not None:
            out = out | (x > F.lit(r.most))
        broken.append(F.when(out, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with the metrics, base_failed, broken_rules and kept.

    base_failed: fewer words than least_words, or over most_repeated percent of
    them in repeated windows. kept: not base_failed and no rule broken.
    """
    # One expression gives all results: a filter on any of them, pushed below the projection, then computes the metrics once.
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
        kept = lambda x: F.struct(*[m[k].alias(k) for k in names], x["b"].alias("base_failed"), x["r"].alias("broken_rules"), (~x["b"] & (F.size(x["r"]) == 0)).alias("kept"))
        return let(F.struct(base.alias("b"), compiled(m, rules).alias("r")), kept)

    v = free("_v", docs)
    made = docs.withColumn(v, let(metrics(F.col(text)), verdict))
    return made.withColumns({k: F.col(f"{v}.{k}") for k in (*names, "base_failed", "broken_rules", "kept")}).drop(v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
  list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS l,
  regexp_split_to_array(lower(regexp_replace(t, '[^\p{L}\x20\x09-\x0D]', '', 'g')), '[\x20\x09-\x0D]+') AS b FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
  len(list_filter(b, lambda x: list_contains([{stop}], x))) AS n_stop, len(list_filter(b, lambda x: x <> '')) AS n_letter_words,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]\s'))) AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipsis_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / nw BETWEEN 2.0 AND 20.0 AND n_symbols / nw <= 0.1 AND n_bangs / nw <= 0.3 AND n_stop / nw >= 0.02
  AND n_letter_words / nw >= 0.6 AND n_dup_lines / nl <= 0.5 AND n_bullet_lines / nl <= 0.9 AND n_ellipsis_lines / nl <= 0.3 AS kept
FROM f""".replace("{stop}", ", ".join(f"'{x}'" for x in _STOP))
