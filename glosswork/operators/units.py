"""Units of characters and patterns, goals, seeding and settling of records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gender_code(gender: Column, plural: Column) -> Column:
    """m, f, n with p for plurals; empty for what has none."""
    g = F.when(F.lower(gender).startswith("m"), "m").when(F.lower(gender).startswith("f"), "f").when(F.lower(gender).startswith("n"), "n").otherwise("")
    return F.when(plural & (g != ""), F.concat(g, F.lit("p"))).otherwise(g)


def noun_display(lemma: Column, article: Column, proper: Column) -> Column:
    """A noun with its article, an elided one without a blank; proper nouns stand alone."""
    parted = F.when(article.endswith("'"), F.concat(article, lemma)).otherwise(F.concat_ws(" ", article, lemma))
    return F.when(proper | (F.coalesce(article, F.lit("")) == ""), lemma).otherwise(parted)


def unit_tiers(units: DataFrame, tiers: DataFrame) -> DataFrame:
    """(unit, first_word, tier): a unit's first word and the least tier of its words. units: (unit, words: array); tiers: (word, ft)."""
    x = units.select("unit", F.posexplode("words").alias("i", "word")).join(tiers, "word", "left")
    return x.groupBy("unit").agg(F.min_by("word", "i").alias("first_word"), F.coalesce(F.min("ft"), F.lit(1)).alias("tier"))


def usable_entries(entries: DataFrame) -> DataFrame:
    """Entries (id, senses: array of (gloss, tags)) with a sense that has a gloss and isn't only a form of another word or obsolete."""
    bad = lambda s: F.arrays_overlap(s["tags"], F.array(F.lit("form-of"), F.lit("obsolete")))
    return entries.filter(F.exists("senses", lambda s: (F.length(s["gloss"]) > 0) & ~bad(s)))


def stage_gates(learned: Column, has_set: Column, sentences: Column, scripts: Column) -> dict[str, Column]:
    """What a day can offer: new words, review, sentences, script."""
    return {"new": has_set, "review": learned > 0, "listen": sentences >= 5, "script": scripts > 0}


def stable_order(words: DataFrame, group: str = "lang") -> DataFrame:
    """Adds ord: levels in turn, ranked words first, by rank, then by place in the file."""
    w = W.partitionBy(group).orderBy("lv_index", F.col("rank").isNull(), "rank", "at")
    return words.withColumn("ord", F.row_number().over(w))


def settled_counter(stored: Column, known: Column, size: Column, set_size: int) -> Column:
    """The number of sets done: at least what the records show, at most what there is."""
    most = F.ceil(size / set_size)
    return F.greatest(F.least(F.coalesce(stored, F.lit(0)), most), F.floor(known / set_size)).cast("long")


def current_goal(positions: DataFrame, done: float = 0.9) -> DataFrame:
    """(learner, goal): the first goal, in their order, whose position is under `done`; -1 when all are reached."""
    open_ = positions.filter(F.col("x") + 1e-9 < done).groupBy("learner").agg(F.min("goal").alias("goal"))
    return positions.select("learner").distinct().join(open_, "learner", "left").select("learner", F.coalesce("goal", F.lit(-1)).alias("goal"))


def primary_sense(entries: DataFrame) -> DataFrame:
    """(lemma, id): the entry whose sense comes first, then the least id."""
    return entries.groupBy("lemma").agg(F.min_by("id", F.struct("sense", "id")).alias("id"))


def seed_records(state: DataFrame, passed: DataFrame, streak: int = 3) -> DataFrame:
    """state (learner, item, r, w, s) with a first record for every passed (learner, item) that has none."""
    new = passed.join(state.select("learner", "item"), ["learner", "item"], "left_anti").distinct()
    zero = F.lit(0).cast("long")
    return state.select("learner", "item", "r", "w", "s").unionByName(new.select("learner", "item", zero.alias("r"), zero.alias("w"), F.lit(streak).cast("long").alias("s")))


def stale_sessions(sessions: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Adds stale: saved too long ago, or for another version of the pack."""
    old = F.unix_timestamp(now) - F.unix_timestamp("saved") > hours * 3600
    return sessions.withColumn("stale", old | ~F.col("fingerprint").eqNullSafe(F.col("pack")))


def charge(state: DataFrame, weak: DataFrame) -> DataFrame:
    """state (learner, item, r, w, s) with the weights of weak words (learner, item, weight) added to the misses and their streaks set to 0."""
    g = weak.groupBy("learner", "item").agg(F.sum("weight").alias("weight"))
    x = state.join(g, ["learner", "item"], "left")
    return x.select("learner", "item", "r", (F.col("w") + F.coalesce("weight", F.lit(0))).alias("w"), F.when(F.col("weight").isNotNull(), 0).otherwise(F.col("s")).cast("long").alias("s"))


def gender_conflicts(words: DataFrame, table: DataFrame) -> DataFrame:
    """(id, status): words whose gender a table (lemma, gender) contradicts or fills in."""
    x = words.join(table.select("lemma", F.col("gender").alias("other")), "lemma")
    status = F.when(F.col("gender").isNull(), "filled").when(F.col("gender") != F.col("other"), "conflict")
    return x.select("id", status.alias("status")).filter("status IS NOT NULL")


def excerpts(pages: DataFrame, text: str) -> DataFrame:
    """(story, page): pages (story, page, text) whose text holds an excerpt."""
    return pages.filter(F.contains("text", F.lit(text))).select("story", "page")


def excerpt_runs(pages: DataFrame, levels: DataFrame) -> DataFrame:
    """(story, lv, runs): how many contiguous runs of a story's pages are excerpts of a level, where any is.

    pages: (story, page, words, known), the words of a page and how many of them
    a level (lv) knows, a row for each level; levels: (lv, least, most, coverage).
    A run counts if it has `least` to `most` words and knows `coverage` of them.

    The words before a page place it on a line; a run ends `most` words after it
    begins at the latest, so pages meet within two blocks of that length.
    """
    up = W.partitionBy("story", "lv").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    x = pages.join(F.broadcast(levels), "lv")  # a row a level, a fixed list
    x = x.withColumn("end", F.sum("words").over(up)).withColumn("upto", F.sum("known").over(up)).withColumn("start", F.col("end") - F.col("words"))
    block = lambda c: F.floor(F.col(c) / F.col("most"))
    first = x.select("story", "lv", F.col("page").alias("i"), "start", (F.col("upto") - F.col("known")).alias("before"), "least", "most", "coverage", F.explode(F.array(block("start"), block("start") + 1)).alias("b"))
    last = x.select("story", "lv", F.col("page").alias("j"), "end", "upto", block("end").alias("b"))
    n = F.col("end") - F.col("start")
    fits = (F.col("j") >= F.col("i")) & (n >= F.col("least")) & (n <= F.col("most")) & (F.col("upto") - F.col("before") >= F.col("coverage") * n)
    return first.join(last, ["story", "lv", "b"]).filter(fits).groupBy("story", "lv").agg(F.count("*").alias("runs"))


def bare_first(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Candidates (learner, item, bare, s, session) with reserved: the first bare ones of each learner take the places before all others."""
    w = W.partitionBy("learner").orderBy((~F.col("bare")).cast("int"), "s", "session", "item")
    x = candidates.withColumn("i", F.row_number().over(w))
    return x.withColumn("reserved", F.col("bare") & (F.col("i") <= most)).drop("i")


def day_slices(tiered: DataFrame, n: int, miss: float = 0.6, refresh: float = 0.2) -> DataFrame:
    """(learner, item, tier, place): a day's n items: open misses up to their share, strong ones up to theirs, weak ones, then the rest by tier."""
    own = F.row_number().over(W.partitionBy("learner", "tier").orderBy("item"))
    first = F.when((F.col("tier") == 0) & (F.col("i") <= max(1, int(miss * n))), 0).when((F.col("tier") == 2) & (F.col("i") <= math.ceil(refresh * n - 1e-9)), 1).when(F.col("tier") == 1, 2).otherwise(3)
    x = tiered.withColumn("i", own).withColumn("slice", first)
    place = F.row_number().over(W.partitionBy("learner").orderBy("slice", "tier", "item"))
    return x.withColumn("place", place).filter(F.col("place") <= n).select("learner", "item", "tier", "place")


def script_examples(uses: DataFrame, taught: DataFrame, most_unknown: int = 2, n: int = 3) -> DataFrame:
    """(unit, place, word, unknown): for each unit of a script words that use it and few units taught later; only the fewest unknowns of a unit, n words, by rank.

    uses: (word, rank, unit) with one row for each distinct unit of a word;
    taught: (unit, ord), the order of teaching.
    """
    u = uses.join(taught, "unit")
    word = u.groupBy("word", "rank").agg(F.sort_array(F.collect_list("ord")).alias("ords"))
    later = F.size(F.filter("ords", lambda o: o > F.col("ord")))
    x = u.select("word", "unit", "ord").join(word, "word").select("unit", "word", "rank", later.alias("unknown")).filter(F.col("unknown") <= most_unknown)
    best = x.groupBy("unit").agg(F.min("unknown").alias("unknown"))
    x = x.join(best, ["unit", "unknown"]).withColumn("place", F.row_number().over(W.partitionBy("unit").orderBy("rank", "word")))
    return x.filter(F.col("place") <= n).select("unit", "place", "word", "unknown")


def restored_links(kept: DataFrame, dropped: DataFrame, floor: int) -> DataFrame:
    """(word, sentence) of dropped links that come back, the first sentences first, until a word has `floor` candidates."""
    have = kept.groupBy("word").agg(F.count("*").alias("have"))
    i = F.row_number().over(W.partitionBy("word").orderBy("sentence"))
    x = dropped.withColumn("i", i).join(have, "word", "left")
    return x.filter(F.col("i") <= floor - F.coalesce("have", F.lit(0))).select("word", "sentence")


def refill(words: DataFrame, candidates: DataFrame, chosen: DataFrame, top: int) -> DataFrame:
    """(token, place, sentence): a second pass for words without an example: their candidates (token, sentence, cost) that the first pass left out."""
    bare = words.select("token").join(chosen.select("token"), "token", "left_anti")
    x = candidates.join(bare, "token").withColumn("place", F.row_number().over(W.partitionBy("token").orderBy("cost", "sentence")))
    return x.filter(F.col("place") <= top).select("token", "place", "sentence")
