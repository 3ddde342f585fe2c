"""Further predicates, gates and unit bookkeeping over words, units and learners' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def learned(words: DataFrame, state: DataFrame, set_size: int, sets_done: DataFrame) -> DataFrame:
    """Adds learned: a record exists, or the word lies in the prefix of sets that its level counts as done.

    words: (learner, item, level, ord); sets_done: (learner, level, sets).
    """
    rec = state.select("learner", "item", F.lit(True).alias("met"))
    i = F.row_number().over(W.partitionBy("learner", "level").orderBy("ord", "item"))
    x = words.withColumn("i", i).join(rec, ["learner", "item"], "left").join(sets_done, ["learner", "level"], "left")
    return x.withColumn("learned", F.coalesce("met", F.lit(False)) | (F.col("i") <= F.coalesce("sets", F.lit(0)) * set_size)).drop("met", "sets", "i")


def known(pairs: DataFrame, peripheral: Column, needed: int) -> DataFrame:
    """(learner, item, known): every one of the needed pairs has its streak, 2 for peripheral items and else 3."""
    bar = F.when(peripheral, 2).otherwise(3)
    g = pairs.groupBy("learner", "item").agg(F.count("*").alias("n"), F.bool_and(F.col("s") >= bar).alias("all"))
    return g.select("learner", "item", ((F.col("n") >= needed) & F.col("all")).alias("known"))


def available(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """Sentences (id, word) all of whose words are in words (word)."""
    missing = sentences.join(words.select("word").distinct(), "word", "left_anti").select("id").distinct()
    return sentences.select("id").distinct().join(missing, "id", "left_anti")


def ambiguous(words: DataFrame, key: str) -> DataFrame:
    """Words whose typed key another word has as well."""
    shared = words.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    return words.join(shared, key, "left_semi")


def next_set(words: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """(learner, level, set, item): the first `size` items of each level that the learner has not met, and the number of the set they begin in."""
    i = (F.row_number().over(W.partitionBy("learner", "level").orderBy("ord")) - 1).alias("i")
    x = words.select("learner", "level", "item", "ord", i)
    left = x.join(done.select("learner", "item"), ["learner", "item"], "left_anti")
    k = F.row_number().over(W.partitionBy("learner", "level").orderBy("ord"))
    first = F.min("i").over(W.partitionBy("learner", "level"))
    return left.withColumn("k", k).withColumn("set", F.floor(first / size) + 1).filter(F.col("k") <= size).select("learner", "level", "set", "item")


def ramp(sets: DataFrame) -> DataFrame:
    """(level, chunk, size, start, stop): running sums over the sizes of a level's chunks."""
    w = W.partitionBy("level").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    return sets.withColumn("stop", F.sum("size").over(w)).withColumn("start", F.col("stop") - F.col("size"))


def chunk_at(ramped: DataFrame, taught: DataFrame) -> DataFrame:
    """(learner, level, chunk): the chunk in which the number taught lies. A range lookup within the level."""
    x = taught.join(ramped, "level").filter((F.col("taught") >= F.col("start")) & (F.col("taught") < F.col("stop")))
    return x.select("learner", "level", "chunk")


def majority_reading(counts: DataFrame) -> DataFrame:
    """(lemma, pos, n): counts whose pos is '?' go to the lemma's most frequent one; lemmas without any keep '?'."""
    best = counts.filter("pos <> '?'").groupBy("lemma").agg(F.min_by("pos", F.struct((-F.col("n")).alias("m"), "pos")).alias("best"))
    x = counts.join(best, "lemma", "left")
    pos = F.when((F.col("pos") == "?") & F.col("best").isNotNull(), F.col("best")).otherwise(F.col("pos"))
    return x.groupBy("lemma", pos.alias("pos")).agg(F.sum("n").alias("n"))


def accent_excess(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token, n) after what a bare spelling has beyond its expected share is moved to the accented one.

    counts: (token, n); pairs: (bare, accented, share), share the part of the
    two that the bare form should have. All moves read the original counts, so
    their sums do not depend on an order.
    """
    c = counts.select(F.col("token").alias("bare"), F.col("n").alias("nb")), counts.select(F.col("token").alias("accented"), F.col("n").alias("na"))
    x = pairs.join(c[0], "bare").join(c[1], "accented")
    x = x.withColumn("moved", F.floor(F.greatest(F.lit(0.0), F.col("nb") - F.col("share") * (F.col("nb") + F.col("na")))).cast("long"))
    delta = x.select(F.col("bare").alias("token"), (-F.col("moved")).alias("d")).unionByName(x.select(F.col("accented").alias("token"), F.col("moved").alias("d")))
    return counts.join(delta.groupBy("token").agg(F.sum("d").alias("d")), "token", "left").select("token", (F.col("n") + F.coalesce("d", F.lit(0))).alias("n"))


def weak_words(tapped: DataFrame, wrong: DataFrame) -> DataFrame:
    """(passage, item, weight, why): words tapped (weight 1) or answered wrongly (2) in a passage, with the greater weight and all reasons."""
    one = lambda df, w, why: df.select("passage", "item", F.lit(w).alias("weight"), F.lit(why).alias("why"))
    g = one(tapped, 1, "tapped").unionByName(one(wrong, 2, "wrong")).groupBy("passage", "item")
    return g.agg(F.max("weight").alias("weight"), F.array_join(F.sort_array(F.collect_set("why")), "+").alias("why"))


def goal_curve(traces: DataFrame, goals: DataFrame, least: int = 2, step: float = 0.05) -> DataFrame:
    """(x, runs, left): on a grid of positions, the mean over runs of the sessions from first reaching x to the goal, where `least` runs have it.

    traces: (run, session, x); goals: (run, session) of the crossing.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(round(1 / step))), lambda k: F.round(k * step, 9)))
    g = goals.select("run", F.col("session").alias("goal"), grid.alias("g"))
    first = traces.join(g, "run").filter(F.col("x") >= F.col("g") - 1e-9).groupBy("run", "g", "goal").agg(F.min("session").alias("first"))
    out = first.filter(F.col("first") <= F.col("goal")).groupBy(F.col("g").alias("x")).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("goal") - F.col("first")), 9).alias("left"))
    return out.filter(F.col("runs") >= least)


def eta_gate(curve: DataFrame, actual: DataFrame, tolerance: float = 0.3) -> DataFrame:
    """(x, n, within, ok): how many runs lie within the tolerance of the curve, and whether two thirds do."""
    x = actual.join(curve.select("x", "left"), "x")
    near = F.abs(F.col("actual") - F.col("left")) <= tolerance * F.greatest(F.col("left"), F.lit(1.0))
    g = x.groupBy("x").agg(F.count("*").alias("n"), F.count_if(near).alias("within"))
    return g.withColumn("ok", 3 * F.col("within") >= 2 * F.col("n"))


def pattern_picks(open_: DataFrame, n: int) -> DataFrame:
    """The n patterns of each learner to ask: lowest streak, longest unasked, then order."""
    w = W.partitionBy("learner").orderBy("s", "session", "pattern")
    return open_.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def last_snapshots(positions: DataFrame, keep: int = 14) -> DataFrame:
    """The last `keep` snapshots of each learner, one a session."""
    one = positions.groupBy("learner", "session").agg(F.max_by("x", "at").alias("x"))
    w = W.partitionBy("learner").orderBy(F.col("session").desc())
    return one.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= keep).drop("i")


def upsert_passages(done: DataFrame) -> DataFrame:
    """(learner, passage, score, session, listened, times): the latest completion of each passage; once listened, always listened."""
    g = done.groupBy("learner", "passage")
    return g.agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"), F.max("session").alias("session"), F.bool_or("listened").alias("listened"), F.count("*").alias("times"))


def spans_faulty(spans: DataFrame) -> DataFrame:
    """(id, fault) of rows (id, length, spans: array of (start, stop)): out of range, empty, unsorted or overlapping."""
    out = F.exists("spans", lambda s: (s["start"] < 0) | (s["stop"] > F.col("length")))
    empty = F.exists("spans", lambda s: s["stop"] <= s["start"])
    pairs = F.zip_with(F.slice("spans", 1, F.greatest(F.size("spans") - 1, F.lit(0))), F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))), lambda a, b: b["start"] < a["stop"])
    fault = F.when(out, "range").when(empty, "empty").when(F.exists(pairs, lambda x: x), "overlap")
    return spans.select("id", fault.alias("fault")).filter("fault IS NOT NULL")


def manifest_diff(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(key, status): missing, stale (another hash) or orphan entries of a manifest."""
    a, b = wanted.select(F.col("key").alias("_a"), F.col("hash").alias("_ha")), there.select(F.col("key").alias("_b"), F.col("hash").alias("_hb"))
    x = a.join(b, a["_a"] == b["_b"], "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan").when(~F.col("_ha").eqNullSafe(F.col("_hb")), "stale")
    return x.select(F.coalesce("_a", "_b").alias("key"), status.alias("status")).filter("status IS NOT NULL")


def overrides(rows: DataFrame, table: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the override where there is one, overrides that fit no row). table: (id, value)."""
    x = rows.join(table.select("id", F.col("value").alias("_v")), "id", "left").withColumn(column, F.coalesce("_v", column)).drop("_v")
    return x, table.join(rows.select("id"), "id", "left_anti")


def exclusions(words: DataFrame, rules: list[tuple[str, Column]], key: str, order: list, samples: int = 25) -> tuple[DataFrame, DataFrame]:
    """(words that no rule excludes; (reason, n, samples) of the others): the first rule that holds is the reason; samples are its first words in the order, a list of bounded length."""
    reason = F.coalesce(*[F.when(c, name) for name, c in rules], F.lit(""))
    x = words.withColumn("reason", reason)
    out = x.filter("reason <> ''")
    i = F.row_number().over(W.partitionBy("reason").orderBy(*order))
    some = out.withColumn("_i", i).filter(F.col("_i") <= samples).groupBy("reason").agg(F.sort_array(F.collect_list(F.struct("_i", key))).alias("s"))
    told = out.groupBy("reason").agg(F.count("*").alias("n")).join(some, "reason").select("reason", "n", F.array_join(F.transform("s", lambda r: r[key]), " ").alias("samples"))
    return x.filter("reason = ''").drop("reason"), told


def without(df: DataFrame, name: str) -> DataFrame:
    """df without the fields of a name, however deep in structs and arrays they stand."""

    def pruned(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(pruned(kind.elementType), kind.containsNull)
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, pruned(f.dataType), f.nullable) for f in kind.fields if f.name != name])
        return kind

    def kept(c: Column, kind: T.DataType) -> Column:
        if kind == pruned(kind):
            return c
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: kept(x, kind.elementType))
        return F.when(c.isNotNull(), F.struct(*[kept(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name != name]))

    return df.select(*[kept(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name != name])
