"""A pipeline over the documents table, each stage one operator of the subpackage llm.

Each stage takes what its predecessor kept, whole. Repeated rows go through as
rows of their own until near duplicates, which keep one document of each class.

Defined results: a null text counts as empty, has no words and so is rejected
by the quality rules; a null doc_id goes through all stages, and its class of
near duplicates keeps a row; an empty table gives an empty result; columns of
documents beside COLUMNS don't matter, whatever their names. Labels of one kind
only, or none, tell nothing of toxicity, and all documents stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import near_dups, packing, quality_rules, toxicity
from glosswork.llm.base import checkpoint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.apply_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold by a classifier of the labels of what is here."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.weights):
        return docs.select(*COLUMNS)
    return toxicity.score(docs.select(*COLUMNS), model).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one whose id names the class."""
    return near_dups.representatives(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, each with its sequence and place."""
    return packing.pack(packing.pieces_of(docs.select("doc_id", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("near_duplicates", one_of_each),
    ("packing", packed),
]

#: The classifier, the samples and the packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, from the documents table. Each stage's rows are checkpointed, as the next reads them more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
