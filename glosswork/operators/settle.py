"""Written tables: lineage cut for loops, and orders over whole tables that no single task has to sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder that the session names; one of our own is set only where none is and all runs in one process (tests)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join for which both sides are dealt to tasks, whatever size Spark takes it for.

    Spark guesses from the files: packed columns and exploded arrays are many
    times the guess, and a broadcast that follows from it fills the driver.
    """
    return df.hint("merge")


def ordered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df with _p and _k: rows in the order of (by, order), dealt to tasks by ranges of it; _p is a row's task and _k its place there.

    Written once, so that neither changes when a task runs again. Rows of equal
    `by` and `order` meet in one task.
    """
    keys = [*map(F.col, by), *order]
    dealt = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_m", F.monotonically_increasing_id())
    return dealt.withColumn("_p", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """df with the row number, from 1, by `order` within `by`; a group of any size, also the whole table, is spread over tasks.

    A row's number is its place in its task after what earlier tasks hold of the group.
    """
    x = ordered(df, by, order)
    held = x.groupBy(*by, "_p").agg(F.min("_k").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*_named(by), (before - F.col("_first")).alias("_start"))
    return x.join(starts, _same(by)).select(*df.columns, (F.col("_start") + F.col("_k") + 1).alias(name))


def _named(by: list[str]) -> list[Column]:
    return [F.col("_p").alias("_q"), *[F.col(c).alias(f"_q{k}") for k, c in enumerate(by)]]


def _same(by: list[str]) -> list[Column]:
    """A row's task and group are those of a row of _named; null groups are groups, too."""
    return [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_q{k}")) for k, c in enumerate(by)]]


def carried(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """df with the last value that is not null up to each row, by `order` within `by`; a group of any size is spread over tasks.

    Within a task it is a window; what stands before a task comes from the last
    values of earlier tasks, a row for each task and group.
    """
    x = ordered(df, by, order)
    own = W.partitionBy(*by, "_p").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    ends = x.groupBy(*by, "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_k"))).alias("_end"))
    earlier = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*_named(by), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    return x.join(ends, _same(by)).select(*df.columns, F.coalesce("_own", "_before").alias(name))
