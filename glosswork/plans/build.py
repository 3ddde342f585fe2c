"""The build of a pack from a corpus: words with ranks, levels and tiers, admitted sentences, examples, coverage, attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.functions.language import LANGUAGES, LanguageSpec
from glosswork.operators import corpus, relations
from glosswork.sources import tables, writers


@dataclass
class Pack:
    words: DataFrame
    sentences: DataFrame
    examples: DataFrame
    attribution: DataFrame
    reasons: DataFrame

    def write(self, path: str) -> None:
        writers.pack_json(self.words, f"{path}/words", ["lang", "rank"])
        writers.pack_json(self.examples, f"{path}/examples", ["lang", "token", "place"])
        writers.pack_json(self.attribution, f"{path}/attribution", ["licence", "place"])
        writers.pack_json(self.reasons, f"{path}/reasons", ["reason"])
        self.sentences.write.mode("overwrite").parquet(f"{path}/sentences")


def build(spark: SparkSession, corpus_dir: str, lang: str, spec: LanguageSpec | None = None) -> Pack:
    spec = spec or LANGUAGES[lang]
    words = tables.words(spark, corpus_dir).filter(F.col("lang") == lang).withColumn("lv", spec.level(F.col("rank")))
    words = corpus.freq_tiers(words, spec.shares).filter(F.col("rank") <= sum(n for _, n in spec.bands))
    admitted = corpus.admission(tables.sentences(spark, corpus_dir).filter(F.col("lang") == lang), spec.lengths[1])
    kept = corpus.first_seen(admitted.filter("reason IS NULL").drop("reason"), F.lower("text"), "doc_id", "sent")
    inside = kept.withColumn("toks", F.transform(tables.words_of(F.col("text")), lambda w: F.lower(w)))
    examples = corpus.example_selection(words, inside, listed=words)
    used = kept.join(examples.select("doc_id", "sent").distinct(), ["doc_id", "sent"], "left_semi")
    reasons = admitted.groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))
    return Pack(words, used, examples, relations.attribution(used, "lang", "source"), reasons)


def word_rules(words: DataFrame, bands: tuple[str, ...], tiers: tuple[int, ...] = (0, 1, 2), least: int = 1) -> DataFrame:
    """(rule, ok, n): what must hold for a list of words (lang, token, rank, lv, ft); n counts what is at fault.

    Keys not empty and unique in their language; ranks from 1 without a gap;
    levels and tiers known; each language's levels in the order of the bands,
    one after another, and filled with at least `least` words.
    """
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), (F.col("n") == 0).alias("ok"), "n")
    lang = words.groupBy("lang").agg(F.count("*").alias("n"), F.max("rank").alias("z"), F.min("rank").alias("a"), F.count_distinct("rank").alias("d"))
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("lv"))
    level = words.groupBy("lang", place.alias("k")).agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("z"))
    after = W.partitionBy("lang").orderBy("k")  # as many rows as there are bands
    mixed = level.withColumn("before", F.lag("z").over(after)).filter("before >= a")
    out = count(words.filter("coalesce(token, '') = ''"), "keys_filled")
    for df, rule in (
        (words.groupBy("lang", "token").agg(F.count("*").alias("c")).filter("c > 1"), "keys_unique"),
        (lang.filter("a <> 1 OR z <> n OR d <> n"), "ranks_without_gap"),
        (words.filter(~F.coalesce(F.col("lv").isin(*bands), F.lit(False))), "levels_known"),
        (words.filter(~F.coalesce(F.col("ft").isin(*tiers), F.lit(False))), "tiers_known"),
        (mixed, "levels_in_order"),
        (level.filter(F.col("n") < least), "levels_filled"),
    ):
        out = out.unionByName(count(df, rule))
    return out


def check(pack: Pack) -> DataFrame:
    """(rule, ok, n): the gate of a pack: its words (word_rules), and examples that cover them, have sentences and hold their words."""
    gate = corpus.coverage_histogram(pack.words.filter("rank <= 200"), pack.examples).select(F.lit("examples_cover").alias("rule"), F.col("gate").alias("ok"), F.col("one").alias("n"))
    none = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), (F.col("n") == 0).alias("ok"), "n")
    lost = pack.examples.join(pack.sentences, ["doc_id", "sent"], "left_anti")
    text = pack.sentences.select("doc_id", "sent", F.transform(tables.words_of(F.col("text")), lambda w: F.lower(w)).alias("toks"))
    strange = pack.examples.join(text, ["doc_id", "sent"]).filter(~F.array_contains("toks", F.col("token")))
    unnamed = pack.sentences.join(pack.attribution.select(F.col("user").alias("source")), "source", "left_anti")
    bands = tuple(r[0] for r in pack.words.groupBy("lv").agg(F.min("rank").alias("a")).orderBy("a").limit(100).collect())  # a band each
    out = gate.unionByName(word_rules(pack.words, bands))
    for df, rule in ((lost, "examples_have_sentences"), (strange, "examples_hold_words"), (unnamed, "sources_attributed")):
        out = out.unionByName(none(df, rule))
    return out
