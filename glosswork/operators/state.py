"""Folds of the answer log into per-item state, batch form.

Every fold whose result is a matter of sets (counts, the last miss, what came
after it) is written as aggregates; folds that need each step's state run
`aggregate` over the sorted answers of one (learner, item) group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.sources.tables import PRODUCTION

#: Streaks at which an item counts as mastered, and from which only typed answers advance it.
MASTERED, HOLD = 3, 2
#: Sessions that count as recent, sessions after which a miss expires, sessions of the list of recent misses.
RECENT, MISS_SESSIONS, MISS_WINDOW = 2, 6, 7


def answer_fold(answers: DataFrame) -> DataFrame:
    """(learner, item, r, w, s, k, t, u): right, wrong, streak, kind of the open miss, last day and last session.

    The streak is the number of right answers after the last miss; the miss is
    open unless one of those was of its own kind.
    """
    at = F.struct("ts", "event_id")
    a = answers.groupBy("learner", "item").agg(
        F.count_if("ok").alias("r"),
        F.count_if(~F.col("ok")).alias("w"),
        F.max(F.when(~F.col("ok"), F.struct(at.alias("at"), "kind"))).alias("miss"),
        F.max("day").alias("t"),
        F.max("session").alias("u"),
    )
    after = answers.filter("ok").join(a.select("learner", "item", "miss"), ["learner", "item"]).filter(F.col("miss").isNull() | (at > F.col("miss.at")))
    s = after.groupBy("learner", "item").agg(F.count("*").alias("s"), F.coalesce(F.bool_or(F.col("kind") == F.col("miss.kind")), F.lit(False)).alias("settled"))
    out = a.join(s, ["learner", "item"], "left")
    k = F.when(~F.coalesce("settled", F.lit(False)), F.col("miss.kind"))
    return out.select("learner", "item", "r", "w", F.coalesce("s", F.lit(0)).alias("s"), k.alias("k"), "t", "u")


def streak_islands(answers: DataFrame) -> DataFrame:
    """(learner, item, longest, runs): the longest run of right answers and the number of runs, by the count of misses before each."""
    w = W.partitionBy("learner", "item").orderBy("ts", "event_id")
    runs = answers.withColumn("island", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)).filter("ok").groupBy("learner", "item", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("learner", "item").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


def _steps(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct("ts", "event_id", *fields)))


def typed_hold_fold(answers: DataFrame, hold: int = HOLD) -> DataFrame:
    """(learner, item, r, w, s): from streak `hold` only typed answers advance, and a miss steps down by one instead of to 0."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("w"), F.lit(0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        held = a["s"] >= hold
        up = F.when(held & (x["kind"] != "type"), a["s"]).otherwise(a["s"] + 1)
        down = F.when(held, a["s"] - 1).otherwise(F.lit(0))
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct((a["r"] + one(x["ok"])).alias("r"), (a["w"] + one(~x["ok"])).alias("w"), F.when(x["ok"], up).otherwise(down).alias("s"))

    folded = answers.groupBy("learner", "item").agg(F.aggregate(_steps("ok", "kind"), start, step).alias("f"))
    return folded.select("learner", "item", "f.*")


def pair_state(answers: DataFrame) -> DataFrame:
    """(learner, item, kind, s, session): the streak of each way of asking, with one credit a session and choices held at 2."""
    start = F.struct(F.lit(0).alias("s"), F.lit(-1).alias("session"))

    def step(a: Column, x: Column) -> Column:
        free = (x["session"] != a["session"]) & (x["prod"] | (a["s"] < 2))
        s = F.when(~x["ok"], 0).when(free, a["s"] + 1).otherwise(a["s"])
        return F.struct(s.alias("s"), x["session"].alias("session"))

    p = answers.withColumn("prod", F.col("kind").isin(*PRODUCTION))
    folded = p.groupBy("learner", "item", "kind").agg(F.aggregate(_steps("ok", "session", "prod"), start, step).alias("f"))
    return folded.select("learner", "item", "kind", "f.*")


def jitter(*parts: Column, seed: str = "7") -> Column:
    """A number in [-0.5, 0.5) that the parts and the seed determine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0) - 0.5


def weak_first(state: DataFrame, n: int = 5) -> DataFrame:
    """The n items of each learner that need review most: 3w - s plus jitter, falling."""
    score = F.round(3 * F.col("w") - F.col("s") + jitter(F.col("learner"), F.col("item")), 9)
    top = state.withColumn("score", score)
    w = W.partitionBy("learner").orderBy(F.col("score").desc(), "item")
    return top.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("learner", "place", "item", "r", "w", "s", "score")


def day_tiers(state: DataFrame, answers: DataFrame) -> DataFrame:
    """(learner, item, tier) at each learner's last session: 0 open miss, 1 weak, 2 strong, 3 recent with kinds unasked, 4 done for now."""
    now = answers.groupBy("learner").agg(F.max("session").alias("sn"), F.max("day").alias("today"))
    misses = answers.filter("not ok").groupBy("learner", "item").agg(F.max("session").alias("missed"))
    asked = answers.join(now, "learner").filter("day = today").groupBy("learner", "item").agg(F.count_distinct("kind").alias("asked"), F.bool_or("ok").alias("right"))
    x = state.join(now, "learner").join(misses, ["learner", "item"], "left").join(asked, ["learner", "item"], "left")
    pending = F.col("k").isNotNull() & (F.col("sn") - F.col("missed") < MISS_SESSIONS)
    recent = F.coalesce("right", F.lit(False)) | (F.col("u") >= F.col("sn") - RECENT)
    tier = F.when(pending, 0).when(~recent, F.when(F.col("s") >= MASTERED, 2).otherwise(1)).when(F.coalesce("asked", F.lit(0)) < 4, 3).otherwise(4)
    return x.select("learner", "item", tier.alias("tier"))


def pair_candidates(pairs: DataFrame) -> DataFrame:
    """Each learner's pairs in the order they are asked: low ones by streak, typed first and age; known ones by age."""
    low = F.col("s") < MASTERED
    typed = F.when(F.col("kind") == "type", 0).otherwise(1)
    j = jitter(F.col("learner"), F.col("item"), F.col("kind"))
    w = W.partitionBy("learner", "list").orderBy(F.when(low, F.col("s")).otherwise(0), F.when(low, typed).otherwise(0), "session", j, "item", "kind")
    x = pairs.withColumn("list", F.when(low, "low").otherwise("high"))
    return x.withColumn("place", F.row_number().over(w)).select("learner", "list", "place", "item", "kind", "s", "session")


def recent_misses(answers: DataFrame) -> DataFrame:
    """Items missed in each learner's last MISS_WINDOW sessions, the latest first."""
    now = answers.groupBy("learner").agg(F.max("session").alias("sn"))
    m = answers.filter("not ok").groupBy("learner", "item").agg(F.max("session").alias("a"), F.count("*").alias("misses"))
    m = m.join(now, "learner").filter(F.col("a") >= F.col("sn") - (MISS_WINDOW - 1))
    return m.withColumn("place", F.row_number().over(W.partitionBy("learner").orderBy(F.col("a").desc(), "item"))).select("learner", "place", "item", "a", "misses")


def session_ordinals(answers: DataFrame) -> DataFrame:
    """(learner, session, day, answers, share of right ones)."""
    g = answers.groupBy("learner", "session", "day").agg(F.count("*").alias("answers"), F.round(F.avg(F.col("ok").cast("int")), 9).alias("right_share"))
    return g


def critical_events(answers: DataFrame, most: int = 3) -> DataFrame:
    """The critical set of each learner: an error adds the item at its session, a later typed pass removes it; oldest first, `most` of them."""
    at = F.struct("ts", "event_id")
    last = answers.filter((F.col("kind") == "type")).groupBy("learner", "item").agg(F.max(F.struct(at.alias("at"), "ok", "session")).alias("l"))
    x = last.filter(~F.col("l.ok")).select("learner", "item", F.col("l.session").alias("added"))
    w = W.partitionBy("learner").orderBy("added", "item")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
