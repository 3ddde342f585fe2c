"""Linking of tokens, senses, pages and old keys, and the gates and choices that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators.settle import carried


def truecase(sentences: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds cased: the text, its first word in lower case where that is the word's usual form inside sentences.

    sentences: (lang, …, text); counts: (lang, token, low, cap).
    """
    first = F.regexp_extract("text", r"^(\p{L}+)", 1)
    x = sentences.withColumn("token", F.lower(first)).join(counts, ["lang", "token"], "left")
    lower = (F.coalesce("low", F.lit(0)) > F.coalesce("cap", F.lit(0))) & (F.length("token") > 0)
    return x.withColumn("cased", F.when(lower, F.concat("token", F.substring("text", F.length("token") + 1, F.length("text")))).otherwise(F.col("text"))).drop("token", "low", "cap")


def resolve(surfaces: DataFrame, entries: DataFrame, edges: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(surface, lemma, how): each surface's lemma: its own entry first, else the most frequent entry that a form edge leads to.

    entries: (lemma, n); edges: (surface, lemma). Surfaces are distinct, so each
    is resolved once however often it occurs. `on` names columns of all three,
    such as a language, within which they meet; they come first in the result.
    """
    own = surfaces.join(entries.select(*on, F.col("lemma").alias("surface"), "n"), [*on, "surface"]).select(*on, "surface", F.col("surface").alias("lemma"), "n", F.lit(0).alias("p"))
    form = edges.join(surfaces, [*on, "surface"]).join(entries, [*on, "lemma"]).select(*on, "surface", "lemma", "n", F.lit(1).alias("p"))
    best = own.unionByName(form).groupBy(*on, "surface").agg(F.min(F.struct("p", (-F.col("n")).alias("m"), "lemma")).alias("b"))
    return best.select(*on, "surface", "b.lemma", F.when(F.col("b.p") == 0, "entry").otherwise("form").alias("how"))


def sentence_links(tokens: DataFrame, keys: DataFrame, allowed: DataFrame, content: Column, on: tuple[str, ...] = ("token",)) -> DataFrame:
    """(sentence, links, outside): the linked keys of each sentence; it cannot ship if a content token is neither a key nor allowed.

    tokens: (sentence, pos, token); keys and allowed: (token); `on` names what a token is known by, such as its language too.
    """
    k, a = keys.select(*on, F.lit(True).alias("key")).distinct(), allowed.select(*on, F.lit(True).alias("ok")).distinct()
    x = tokens.join(k, list(on), "left").join(a, list(on), "left")
    out = content & F.col("key").isNull() & F.col("ok").isNull()
    return x.groupBy("sentence").agg(F.count_distinct(F.when(F.col("key"), F.col("token"))).alias("links"), F.coalesce(F.bool_or(out), F.lit(False)).alias("outside"))


#: Words of one form and the same cues that are one row of homographs' join.
BLOCK = 512


def homographs(words: DataFrame) -> DataFrame:
    """(form, a, b, shared): words of one form, a < b, and whether their cues overlap. words: (id, form, cues).

    The pairs are many by nature, so each costs little: words of one form and
    the same cues go in blocks, cues are compared once for two blocks, and pairs
    of blocks are dealt to all tasks before their words are listed, whatever
    their form. No task holds more than two blocks.
    """
    i = F.row_number().over(W.partitionBy("form", "cues").orderBy("id"))
    blocks = words.withColumn("i", F.floor((i - 1) / BLOCK)).groupBy("form", "cues", "i").agg(F.collect_list("id").alias("ids"))
    side = lambda c: blocks.select("form", F.struct("cues", "i").alias(c), F.col("ids").alias(f"{c}s"))
    met = side("x").join(side("y"), "form").filter("x <= y")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select("form", "xs", "ys", (F.col("x") == F.col("y")).alias("same"), F.arrays_overlap("x.cues", "y.cues").alias("shared"), F.xxhash64("form", "x", "y").alias("k")).repartition(tasks, "k")
    pairs = dealt.select("form", "same", "shared", "ys", F.explode("xs").alias("p")).select("form", "same", "shared", "p", F.explode("ys").alias("q"))
    # Within a block each pair comes both ways, between two blocks once.
    kept = pairs.filter((F.col("p") < F.col("q")) | (~F.col("same") & (F.col("p") > F.col("q"))))
    return kept.select("form", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared")


def level_budget(passages: DataFrame, words: DataFrame, cap: int, on: tuple[str, ...] = ("word",)) -> DataFrame:
    """(passage, above, over): distinct words of a passage that are above its level, and whether they exceed the cap.

    passages: (passage, lv, word); words: (word, lv) with ordinal levels; `on` names what a word is known by.
    """
    x = passages.join(words.select(*on, F.col("lv").alias("wl")), list(on))
    g = x.groupBy("passage", "lv").agg(F.count_distinct(F.when(F.col("wl") > F.col("lv"), F.col("word"))).alias("above"))
    return g.select("passage", "above", (F.col("above") > cap).alias("over"))


def migrate(records: DataFrame, keymap: DataFrame) -> DataFrame:
    """(id, key, status): old records by their new ids; of several old keys of an id the first counts, keys without one are unmapped.

    records: (key, n); keymap: (key, id).
    """
    x = records.join(keymap, "key", "left")
    i = F.row_number().over(W.partitionBy("id").orderBy(F.col("n").desc(), "key"))
    lost = x.filter("id IS NULL").select(F.lit(-1).cast("long").alias("id"), "key", F.lit("unmapped").alias("status"))
    kept = x.filter("id IS NOT NULL").withColumn("i", i).select("id", "key", F.when(F.col("i") == 1, "moved").otherwise("duplicate").alias("status"))
    return kept.unionByName(lost)


def page_shift(pages: DataFrame, twins: DataFrame, most: int = 3, least_pages: int = 3, better: float = 0.6, bad: float = 0.2) -> DataFrame:
    """(story, shift, usual, pages, misfit): the constant shift of page numbers by which a story's pages answer its twin's.

    pages, twins: (story, n, len), each n once in a story. The usual shift is
    that of two numberings which differ by a constant, whatever its size, else
    0. Misfit is the deviation of the log length ratio over the pages that a
    shift pairs, if at least `least_pages`. Another shift up to `most` wins only
    if its misfit is under `better` of the usual one's, and that above `bad`.
    pages and misfit (-1 where too few pages meet) are those of the shift.
    """
    ends = lambda t, k: t.groupBy("story").agg(F.count("*").alias(f"c{k}"), F.min("n").alias(f"m{k}"))
    both = ends(pages, "a").join(ends(twins, "b"), "story", "left")
    moved = pages.join(both, "story").select("story", (F.col("n") + F.col("mb") - F.col("ma")).alias("n"))
    met = moved.join(twins.select("story", "n"), ["story", "n"]).groupBy("story").agg(F.count("*").alias("met"))
    alike = (F.col("ca") == F.col("cb")) & (F.col("met") == F.col("ca"))
    story = both.join(met, "story", "left").select("story", F.when(alike, F.col("mb") - F.col("ma")).otherwise(0).cast("long").alias("usual"))
    near = F.array_distinct(F.concat(F.array("usual"), F.array(*[F.lit(k).cast("long") for k in range(-most, most + 1)])))
    a = pages.join(story, "story").select("story", "n", F.col("len").alias("la"), F.explode(near).alias("shift"))
    x = a.withColumn("m", F.col("n") + F.col("shift")).join(twins.select("story", F.col("n").alias("m"), F.col("len").alias("lb")), ["story", "m"])
    g = x.groupBy("story", "shift").agg(F.count("*").alias("pages"), F.round(F.stddev_pop(F.ln((F.col("la") + 12) / (F.col("lb") + 12))), 9).alias("misfit"))
    g = g.filter(F.col("pages") >= least_pages).join(story, "story")
    rated = F.struct("misfit", (F.col("shift") != F.col("usual")).alias("other"), F.abs("shift").alias("size"), "shift", "pages")
    own = F.max(F.when(F.col("shift") == F.col("usual"), F.struct("misfit", "pages")))
    g = g.groupBy("story").agg(F.min(rated).alias("best"), own.alias("own"))
    wins = (F.col("best.misfit") < better * F.col("own.misfit")) & (F.col("own.misfit") > bad)
    x = story.join(g, "story", "left").withColumn("wins", F.coalesce(wins, F.lit(False)))
    pick = lambda other, own, none: F.when(F.col("wins"), F.col(other)).otherwise(F.coalesce(F.col(own), F.lit(none)))
    return x.select("story", F.when(F.col("wins"), F.col("best.shift")).otherwise(F.col("usual")).alias("shift"), "usual", pick("best.pages", "own.pages", 0).cast("long").alias("pages"), pick("best.misfit", "own.misfit", -1.0).alias("misfit"))


def as_of(rows: DataFrame, curves: DataFrame) -> DataFrame:
    """Each row (id, grp, at) with the curve (grp, since, curve) of the greatest `since` not after it: one ordered pass over the union, no pairs; a group is spread over tasks."""
    u = rows.select("id", "grp", "at", F.lit(None).cast("string").alias("curve"), F.lit(1).alias("o")).unionByName(curves.select(F.lit(None).cast("long").alias("id"), "grp", F.col("since").alias("at"), "curve", F.lit(0).alias("o")))
    # Rows of one place may meet in any order after its curves.
    x = carried(u, ["grp"], [F.col("at"), F.col("o"), F.col("curve"), F.col("id")], "curve", "found")
    return x.filter("o = 1").select("id", "grp", "at", F.coalesce("found", F.lit("")).alias("curve"))


def compose_gloss(senses: DataFrame, fits: int = 45) -> DataFrame:
    """(id, gloss): the best sense, and the second of half its score or more if it is disjoint from it and both fit; only the first such candidate is tried.

    senses: (id, sense, score, stems).
    """
    w = W.partitionBy("id").orderBy(F.col("score").desc(), "sense")
    x = senses.withColumn("i", F.row_number().over(w)).withColumn("top", F.first(F.struct("sense", "score", "stems")).over(w))
    able = (F.col("i") > 1) & (F.col("score") >= 0.5 * F.col("top.score"))
    second = F.min(F.when(able, F.struct("i", "sense", "stems")))
    g = x.groupBy("id", "top").agg(second.alias("b"))
    both = F.concat(F.col("top.sense"), F.lit("; "), F.col("b.sense"))
    ok = F.col("b").isNotNull() & ~F.arrays_overlap(F.col("top.stems"), F.col("b.stems")) & (F.length(both) <= fits)
    return g.select("id", F.when(ok, both).otherwise(F.col("top.sense")).alias("gloss"))


def phrase_share(sentences: DataFrame, phrases: DataFrame, by: tuple[str, ...] = (), size: int = 2) -> DataFrame:
    """(*by, phrase, n, bound, share): sentences that hold a phrase's head word, and the share of them that hold the phrase between blanks.

    sentences: (*by, text, toks), a row each, text and tokens in lower case; phrases: (*by, phrase, head), `size` words of letters parted by blanks, the first the head.
    Both counts are sums over what each sentence holds, so no text is shuffled:
    a phrase stands between blanks where the pieces of a text between blanks are its words.
    """
    holds = sentences.select(*by, F.explode_outer(F.array_distinct("toks")).alias("head")).groupBy(*by, "head").agg(F.count("*").alias("n"))
    runs = F.transform(F.slice("pieces", 1, F.greatest(F.size("pieces") - (size - 1), F.lit(0))), lambda _, i: F.array_join(F.slice("pieces", i + 1, size), " "))
    head = lambda p: F.substring_index(p, " ", 1)
    # Pieces of letters are tokens; only a dotted capital I has a mark in lower case.
    letters = "[\\p{L}\u0307]+"
    told = lambda p: p.rlike(f"^{letters}( {letters}){{{size - 1}}}$") & (~F.contains(p, F.lit("\u0307")) | F.array_contains("toks", head(p)))
    x = sentences.select(*by, "toks", F.split("text", " ").alias("pieces"))
    x = x.select(*by, "toks", F.array_distinct(runs).alias("runs")).select(*by, F.explode_outer(F.filter("runs", told)).alias("phrase"))
    bound = x.groupBy(*by, "phrase").agg(F.count("*").alias("bound"))
    g = phrases.select(*by, "phrase", "head").join(holds, [*by, "head"]).join(bound, [*by, "phrase"], "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    return g.select(*by, "phrase", "n", "bound", F.round(F.col("bound") / F.col("n"), 6).alias("share"))


def flat_profile(buckets: DataFrame, spread: float = 15.0) -> DataFrame:
    """(learner, flat, pct): whether the percentages of a placement differ by no more than the spread, and then the overall one."""
    g = buckets.groupBy("learner").agg(F.max("pct").alias("a"), F.min("pct").alias("b"), F.sum("right").alias("r"), F.sum("asked").alias("n"))
    flat = F.col("a") - F.col("b") <= spread
    return g.select("learner", flat.alias("flat"), F.when(flat, F.round(100.0 * F.col("r") / F.col("n"), 6)).otherwise(-1.0).alias("pct"))


def story_drops(pairs: DataFrame, order: list[str], tokens: tuple[int, int] = (3, 14), glued: int = 20, openers: tuple[str, ...] = (), relative: tuple[str, ...] = (), meta: str = "$^") -> DataFrame:
    """Adds reason: the first filter that a pair (target, english, names) of a story fails, '' where it passes all.

    names: the story's names, an array (an empty or null one drops nothing);
    spelt, where pairs have it: the words of the target's language that spell one
    of them in its own writing, see names.alike. Of kept pairs with the same target, but for case and blanks, the first in the
    order stays and the others are duplicates; they meet in an aggregate.
    """
    t, e = F.regexp_extract_all(F.lower("target"), F.lit(r"(\p{L}+)"), 1), F.regexp_extract_all("english", F.lit("([A-Za-z']+)"), 1)
    low = F.transform(e, lambda w: F.lower(w))
    n, ratio = F.size(t), (F.length("target") + 6) / (F.length("english") + 6)
    one_sound = ((n >= 2) & (F.size(F.array_distinct(t)) <= F.greatest(F.lit(1), F.floor(n / 3)))) | ((F.size(e) >= 3) & (F.size(F.array_distinct(low)) == 1))
    uneven = lambda c: (F.regexp_count(c, F.lit('"')) % 2 == 1) | (F.regexp_count(c, F.lit(r"\(")) != F.regexp_count(c, F.lit(r"\)")))
    words = lambda x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    spelt = F.coalesce(F.arrays_overlap(t, "spelt"), F.lit(False)) if "spelt" in pairs.columns else F.lit(False)
    reason = (
        F.when((ratio < 0.7) | (ratio > 1.4), "pair_alignment")
        .when(~F.col("target").rlike(r"[.!?]$"), "not_terminated")
        .when(F.col("target").rlike(r"[|#$%&*<>]"), "foreign_chars")
        .when(F.exists(t, lambda w: F.length(w) > glued), "glued_words")
        .when((n < tokens[0]) | (n > tokens[1]) | (F.size(F.split("english", " ")) > 3 * tokens[1]), "token_count")
        .when(one_sound, "onomatopoeia")
        .when(F.get(t, F.lit(0)).isin(*openers), "opener")
        .when((n > 10) & F.arrays_overlap(t, words(relative)), "complex_clause")
        .when(uneven("target") | uneven("english"), "quotation_fragment")
        .when(F.col("english").rlike(r"^[A-Z][a-z]+[.!?]$"), "names_only")
        .when(F.coalesce(F.arrays_overlap(e, "names"), F.lit(False)) | spelt, "story_name")
        .when(F.col("english").rlike(meta), "meta_line")
        .otherwise("")
    )
    x = pairs.withColumn("reason", reason).withColumn("_k", F.regexp_replace(F.lower("target"), r"\s+", " "))
    first = x.filter("reason = ''").groupBy("_k").agg(F.min(F.struct(*order)).alias("_first"))
    same = F.struct(*order) == F.col("_first")
    x = x.join(first, "_k", "left").withColumn("reason", F.when((F.col("reason") == "") & ~same, "duplicate").otherwise(F.col("reason")))
    return x.drop("_k", "_first")


def cloze(sentences: DataFrame, function_words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(sentence, token, pos): tokens that can be left out: no function word, once in the sentence, and something left outside.

    sentences: (*by, sentence, toks), a row each with its tokens in order;
    function_words: (*by, token), few rows for each `by`. Sorted, equal tokens
    stand side by side in a sentence's own row, so no token is shuffled.
    """
    placed = F.sort_array(F.transform("toks", lambda t, i: F.struct(t.alias("token"), i.cast("long").alias("pos"))))
    x = sentences.select(*by, "sentence", placed.alias("_s"))
    near = lambda i: F.get("_s", i)["token"]
    alone = lambda x, i: (F.size("_s") > 1) & ~(x["token"] == F.coalesce(near(i - 1), F.lit(""))) & ~(x["token"] == F.coalesce(near(i + 1), F.lit("")))
    x = x.select(*by, "sentence", F.explode_outer(F.filter("_s", alone)).alias("_t")).filter("_t IS NOT NULL").select(*by, "sentence", "_t.token", "_t.pos")
    return x.join(F.broadcast(function_words.select(*by, "token")), [*by, "token"], "left_anti").select("sentence", "token", "pos")


def occurrences(texts: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """(id, surface, n, first): whole-word occurrences of surfaces (surface), of all words without them, in texts and the first one's offset.

    texts: (id, text, toks), a row each, the text's words in order. Sorted, equal
    words stand side by side; they are counted in the text's own row, so no text
    is shuffled.
    """
    s = texts.select("id", "text", F.sort_array("toks").alias("_s"))
    starts = F.filter(F.transform("_s", lambda _, i: i), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    s = s.select("id", "text", "_s", starts.alias("_a"))
    # The outer form: the filter that Spark derives from the other would sort again for each word.
    x = s.select("id", "text", "_s", "_a", F.posexplode_outer("_a").alias("_k", "_i")).filter("_i IS NOT NULL")
    x = x.select("id", "text", F.get("_s", F.col("_i")).alias("surface"), (F.coalesce(F.get("_a", F.col("_k") + 1), F.size("_s")) - F.col("_i")).alias("n"))
    x = x if surfaces is None else x.join(surfaces.select("surface"), "surface", "left_semi")
    whole = F.concat(F.lit(r"(?<!\p{L})"), "surface", F.lit(r"(?!\p{L})"))
    return x.select("id", "surface", "n", (F.regexp_instr("text", whole) - 1).alias("first"))


def pool(words: DataFrame, most: int) -> DataFrame:
    """All readings (lemma, pos, rank) of the first `most` distinct lemmas in order of rank."""
    first = words.groupBy("lemma").agg(F.min("rank").alias("first")).orderBy("first", "lemma").limit(most)
    return words.join(first.select("lemma"), "lemma")


def keep_live(primary: DataFrame, live: DataFrame) -> DataFrame:
    """primary (id, text) and, of the live ones, those whose text isn't there yet, one for each text."""
    more = live.join(primary.select("text"), "text", "left_anti").groupBy("text").agg(F.min("id").alias("id"))
    return primary.select("id", "text").unionByName(more.select("id", "text"))


def interleaved(stages: DataFrame, done: DataFrame) -> DataFrame:
    """(learner, track, step): the next unfinished stage of each learner in the order of steps, tracks in turn; no row where all are done.

    stages: (step, track, ord), the path: an array of its places, tens of them, beside each learner's own.
    """
    path = stages.agg(F.sort_array(F.collect_list(F.struct("step", "ord", "track"))).alias("path"))  # one row
    mine = done.groupBy("learner").agg(F.collect_set(F.struct("track", "step")).alias("mine")).crossJoin(F.broadcast(path))
    open_ = F.filter("path", lambda s: ~F.array_contains("mine", F.struct(s["track"].alias("track"), s["step"].alias("step"))))
    x = mine.select("learner", F.get(open_, F.lit(0)).alias("s")).filter("s IS NOT NULL")
    return x.select("learner", "s.track", "s.step")


def exam_misses(sentences: DataFrame, state: DataFrame, per_sentence: int = 2, cap: int = 6) -> DataFrame:
    """(learner, exam, item): items of missed sentences to flag: of lowest streak, per_sentence of each, cap in an exam.

    sentences: (learner, exam, sentence, item); state: (learner, item, s).
    """
    x = sentences.join(state.select("learner", "item", "s"), ["learner", "item"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    a = F.row_number().over(W.partitionBy("learner", "exam", "sentence").orderBy("s", "item"))
    x = x.withColumn("a", a).filter(F.col("a") <= per_sentence).groupBy("learner", "exam", "item").agg(F.min("s").alias("s"))
    b = F.row_number().over(W.partitionBy("learner", "exam").orderBy("s", "item"))
    return x.withColumn("b", b).filter(F.col("b") <= cap).select("learner", "exam", "item")


def next_passage(passages: DataFrame, seed: str) -> DataFrame:
    """(learner, passage): the passage read least often; ties by a seeded hash."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("learner").cast("string"), F.col("passage").cast("string")))
    return passages.groupBy("learner").agg(F.min_by("passage", F.struct("times", h.alias("h"))).alias("passage"))
