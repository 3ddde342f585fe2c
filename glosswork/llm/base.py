"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of white space by which the operators cut words: blank and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, n: int) -> Column:
    """Fold of a row: the CRC-32 of the key as text, modulo n (a null key: that of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def widened(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of df with more fields (name, type); df's own is left as it is."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def with_made(df: DataFrame, column: str, fields: list[tuple[str, str]], make, rows: int = 512) -> DataFrame:
    """df with more columns, made from one of its columns by make(list of values) -> list of columns.

    The others pass as Arrow data, so their types and nulls stay as they are.
    A call of make gets at most `rows` values.
    """
    df = df.drop(*[name for name, _ in fields])
    schema = widened(df, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                made = make(part.column(column).to_pylist())
                new = [pa.array(x, kinds.field(name).type) for x, (name, _) in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=kinds.names)

    return df.mapInArrow(run, schema)


def free(name: str, df: DataFrame) -> str:
    """A name that no column of df has, whatever the case: name, with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as string, text): pandas would turn whole numbers with nulls among them into floats."""
    return docs.select(F.col(key).cast("string").alias(key), text)


def unkeyed(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with the key as a long again, in its place."""
    return df.select(*[F.col(c).cast("long").alias(c) if c == key else F.col(c) for c in df.columns])


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of our own is set only where there is none and all runs in one process (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
