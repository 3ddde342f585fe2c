"""python -m glosswork.cli COMMAND: build, check, sample, passages, enrich, sentence-ids, diff, review, progress."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glosswork.operators import corpus, progress, relations, state
from glosswork.plans import build
from glosswork.sources import tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glosswork", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in {
        "build": ("--lang", "--out"), "check": ("--lang",), "sample": ("--lang", "--seed", "--n"), "passages": ("--lang",), "enrich": ("--lang",),
        "sentence-ids": ("--lang", "--issued", "--out"), "diff": ("--old", "--new", "--key"), "review": ("--n",), "progress": (),
    }.items():
        c = sub.add_parser(name)
        c.add_argument("--data", required=name != "diff", help="folder of the tables")
        for flag in extra:
            c.add_argument(flag, required=flag not in ("--seed", "--n", "--out"), default={"--seed": "qa1", "--n": "5"}.get(flag))
    return p


def run(spark: SparkSession, argv: list[str]):
    """The command's result as a DataFrame; build and sentence-ids write to --out if it is given."""
    a = _parser().parse_args(argv)
    if a.command in ("build", "check"):
        pack = build.build(spark, a.data, a.lang)
        if a.command == "build" and a.out:
            pack.write(a.out)
        return build.check(pack)
    if a.command == "sample":
        docs = tables.read(spark, a.data, "documents").filter(F.col("lang") == a.lang)
        return relations.stratified(docs.select("lang", "source", "doc_id"), "source", "doc_id", int(a.n), a.seed)
    if a.command == "passages":
        known = tables.words(spark, a.data).filter("rank <= 500").filter(F.col("lang") == a.lang)
        return corpus.token_coverage(tables.tokens(spark, a.data).filter(F.col("lang") == a.lang), known)
    if a.command == "enrich":
        return corpus.tier_counts(corpus.freq_tiers(corpus.level_bands(tables.words(spark, a.data).filter(F.col("lang") == a.lang))))
    if a.command == "sentence-ids":
        s = tables.sentences(spark, a.data).filter(F.col("lang") == a.lang).select((F.col("doc_id") * 100000 + F.col("sent")).alias("ord"), "text")
        out = relations.carry_ids(s, spark.read.parquet(a.issued))
        if a.out:
            out.write.mode("overwrite").parquet(a.out)
        return out
    if a.command == "diff":
        old, new = spark.read.parquet(a.old), spark.read.parquet(a.new)
        return relations.version_diff(old, new, a.key, [c for c in old.columns if c != a.key and c in new.columns])
    log = tables.answers(spark, a.data)
    if a.command == "review":
        return state.weak_first(state.answer_fold(log), int(a.n))
    return progress.progress_position(state.answer_fold(log), state.pair_state(log))


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]).show(50, truncate=False)
