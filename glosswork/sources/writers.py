"""Writers of packs, snapshots and stage tables."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_json(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one JSON-lines file with sorted rows and columns in the order of their names, the same bytes for the same rows.

    For tables of a pack (thousands of rows); large tables are written as stage tables.
    """
    cols = sorted(df.columns)
    df.select(*cols).coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def stage(df: DataFrame, path: str, version: str) -> str:
    """A stage's table under its version; a version that is there already is not written again."""
    where, spark = f"{path}/stage_version={version}", df.sparkSession
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    except Py4JError:
        there = False
    if not there:
        df.write.mode("overwrite").parquet(where)
    return where


def snapshot(df: DataFrame, path: str, number: int) -> None:
    """A numbered version of a table; earlier ones stay, so an import can be taken back."""
    df.withColumn("_written", F.current_timestamp()).write.mode("error").parquet(f"{path}/v={number}")
