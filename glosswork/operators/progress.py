"""Progress, gates, pace and estimates over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators.state import MASTERED

GATE, GOAL, TOLERANCE, RING = 0.7, 0.9, 0.02, 14
UNIT_WEIGHT = PASSAGE_WEIGHT = 0.2
#: Weights of units and passages in the position on the whole map; words have the rest.
MAP_WEIGHTS = (0.25, 0.25)


def position(known: Column, units: Column | None, listened: Column | None, weights: tuple[float, float] = (UNIT_WEIGHT, PASSAGE_WEIGHT)) -> Column:
    """Weighted position of a level or goal in [0, 1], with MAP_WEIGHTS on the whole map; absent parts give their weight to the words."""
    wu = 0.0 if units is None else weights[0]
    wp = 0.0 if listened is None else weights[1]
    out = (1 - wu - wp) * known
    if units is not None:
        out = out + wu * units
    if listened is not None:
        out = out + wp * listened
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def level_of(item: Column, size: int = 4) -> Column:
    return F.floor(item / size).cast("int")


def progress_position(state: DataFrame, pairs: DataFrame, items: int = 10, weights: tuple[float, float] = (UNIT_WEIGHT, PASSAGE_WEIGHT)) -> DataFrame:
    """(learner, known, units_ok, listened, position) over all items, seen or not."""
    k = state.groupBy("learner").agg((F.count_if(F.col("s") >= MASTERED) / items).alias("known"))
    p = pairs.groupBy("learner").agg((F.count_if((F.col("kind") == "recall") & (F.col("s") >= 2)) / items).alias("units_ok"), (F.count_if((F.col("kind") == "hear") & (F.col("s") >= 1)) / items).alias("listened"))
    x = k.join(p, "learner")
    pos = position(F.col("known"), F.col("units_ok"), F.col("listened"), weights)
    return x.select("learner", *[F.round(c, 9).alias(c) for c in ("known", "units_ok", "listened")], F.round(pos, 9).alias("position"))


def level_shares(state: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(learner, level, share): known share of every level; a level without items counts as known."""
    levels = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(n).alias("size")) for lv, n in sizes.items()]))
    grid = state.select("learner").distinct().select("learner", levels.alias("x")).select("learner", "x.*")
    known = state.filter(F.col("s") >= MASTERED).groupBy("learner", level_of(F.col("item")).alias("level")).agg(F.count("*").alias("n"))
    share = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("size"))
    return grid.join(known, ["learner", "level"], "left").select("learner", "level", F.round(share, 9).alias("share"))


def level_gate(shares: DataFrame) -> DataFrame:
    """The first level of each learner that is not known to GOAL, and whether the one before it holds it back."""
    before = F.lag("share").over(W.partitionBy("learner").orderBy("level"))
    x = shares.withColumn("before", before).filter(F.col("share") + 1e-9 < GOAL)
    first = x.groupBy("learner").agg(F.min(F.struct("level", "share", "before")).alias("f"))
    return first.select("learner", "f.level", "f.share", F.coalesce(F.col("f.before") + 1e-9 < GATE, F.lit(False)).alias("held"))


def session_positions(answers: DataFrame, items: int = 10) -> DataFrame:
    """(learner, session, x): the share of items that were answered rightly twice by each session."""
    w = W.partitionBy("learner", "item").orderBy("ts", "event_id")
    second = answers.filter("ok").withColumn("i", F.row_number().over(w)).filter("i = 2").groupBy("learner", "session").agg(F.count("*").alias("n"))
    grid = answers.select("learner", "session").distinct().join(second, ["learner", "session"], "left")
    run = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("learner").orderBy("session"))
    return grid.select("learner", "session", F.round(run / items, 9).alias("x"))


def pace_eta(positions: DataFrame, ring: int = RING, goal: float = GOAL) -> DataFrame:
    """Sessions to the goal at the pace of the last `ring` sessions; null pace until there are that many, and no estimate where it isn't positive."""
    w = W.partitionBy("learner").orderBy(F.col("session").desc())
    last = positions.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= ring)
    g = last.groupBy("learner").agg(F.count("*").alias("n"), F.min(F.struct("session", "x")).alias("a"), F.max(F.struct("session", "x")).alias("b"))
    pace = F.when(F.col("n") == ring, (F.col("b.x") - F.col("a.x")) / F.nullif(F.col("b.session") - F.col("a.session"), F.lit(0)))
    eta = F.when(F.col("b.x") >= goal, F.lit(0)).when(pace > 0, F.ceil((goal - F.col("b.x")) / pace - 1e-9))
    return g.select("learner", F.col("b.x").alias("x"), F.round(pace, 9).alias("pace"), eta.cast("double").alias("sessions_to_go"))


#: A curve of sessions left by position.
CURVE = ((0.1, 40.0), (0.3, 28.0), (0.5, 17.0), (0.7, 8.0), (0.85, 2.0))


def eta_lookup(positions: DataFrame, curve: tuple[tuple[float, float], ...] = CURVE) -> DataFrame:
    """Adds sessions_left: the piecewise linear curve at x; its first value before it, 0 beyond it, at least 1 under the goal.

    The segments are literals of one expression, so the as-of lookup needs no join.
    """
    x, y = F.col("x"), F.lit(0.0)
    for (x0, y0), (x1, y1) in reversed(list(zip(curve, curve[1:], strict=False))):
        y = F.when((x >= x0) & (x <= x1), y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(y)
    y = F.when(x < curve[0][0], F.lit(curve[0][1])).otherwise(y)
    left = F.when(x >= GOAL, 0).otherwise(F.greatest(F.lit(1), F.ceil(y - 1e-9)))
    return positions.withColumn("sessions_left", left.cast("long"))


def goal_crossing(positions: DataFrame, goal: float, tolerance: float = TOLERANCE) -> DataFrame:
    """(learner, session): the earliest session at the goal after which x never falls under goal - tolerance."""
    ahead = F.min("x").over(W.partitionBy("learner").orderBy("session").rowsBetween(0, W.unboundedFollowing))
    ok = positions.withColumn("ahead", ahead).filter((F.col("x") >= goal) & (F.col("ahead") >= goal - tolerance))
    return ok.groupBy("learner").agg(F.min("session").alias("session"))


def holds(series: DataFrame, gate: float, least: int = 2) -> DataFrame:
    """(learner, start, stop, n): runs of at least `least` sessions whose share of right answers stays under the gate."""
    w = W.partitionBy("learner").orderBy("session")
    x = series.withColumn("shut", F.col("right_share") < gate)
    change = F.when(F.col("shut") != F.coalesce(F.lag("shut").over(w), ~F.col("shut")), 1).otherwise(0)
    runs = x.withColumn("change", change).withColumn("island", F.sum("change").over(w)).filter("shut")
    g = runs.groupBy("learner", "island").agg(F.min("session").alias("start"), F.max("session").alias("stop"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= least).drop("island")


def reading_stats(reads: DataFrame) -> DataFrame:
    """(level, total, done, mean_pct): passages of each level, those done, and the mean of their percentages."""
    return reads.groupBy("level").agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.round(F.avg(F.when(F.col("done"), 100.0 * F.col("score"))), 6).alias("mean_pct"))


def reading_speed(reads: DataFrame, least: int = 3) -> DataFrame:
    """(learner, speed): the median of units a minute over at least `least` passages, else null."""
    g = reads.groupBy("learner").agg(F.count("*").alias("n"), F.median("speed").alias("m"))
    return g.select("learner", "n", F.when(F.col("n") >= least, F.greatest(F.lit(1.0), F.round("m"))).cast("long").alias("speed"))
