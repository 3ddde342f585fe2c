"""Keyed state over days and sessions: the day log of misses, mixes of kinds, and a simulated learner."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators.state import MISS_SESSIONS, RECENT
from glosswork.sources.tables import PRODUCTION


def settles(missed: str, kind: str) -> bool:
    """A miss is settled by a right answer of its own kind or by any that asks for the form."""
    return missed == kind or kind in PRODUCTION


def _aged(e: dict, session: int) -> bool:
    return e["again"] and session - e["since"] >= MISS_SESSIONS


def answer(book: dict, item: int, kind: str, ok: bool, session: int, drill: int) -> int:
    """One answer noted in the day's book of items; returns how many missed kinds it settled.

    A right answer in the drill of the miss proves nothing and settles nothing.
    """
    e = book.setdefault(item, {"missed": [], "since": session, "again": False, "right": [], "last": None, "drill": None})
    if e["missed"] and e["drill"] != drill:
        e["again"] = True
    if not ok:
        e["drill"] = drill
        if not e["missed"] or _aged(e, session):
            e |= {"missed": [], "since": session, "again": False}
        if kind not in e["missed"]:
            e["missed"].append(kind)
        return 0
    e["last"] = session
    if e["drill"] == drill:
        return 0
    if kind not in e["right"]:
        e["right"].append(kind)
    left = [m for m in e["missed"] if not settles(m, kind)]
    settled, e["missed"] = len(e["missed"]) - len(left), left
    if not left:
        e["again"] = False
    return settled


def midnight(book: dict, session: int) -> tuple[dict, int]:
    """(what the next day starts with, misses that expired): open misses, and right kinds of the last sessions."""
    out, expired = {}, 0
    for item, e in book.items():
        missed = [] if _aged(e, session) else e["missed"]
        expired += len(e["missed"]) - len(missed)
        right = e["right"] if e["last"] is not None and e["last"] >= session - RECENT else []
        if missed or right:
            out[item] = e | {"missed": missed, "right": right, "drill": None}
    return out, expired


def day_log(answers: DataFrame) -> DataFrame:
    """(learner, day, carried, settled, expired, pending): open misses brought from before, settled, dropped for age, and left for the next day.

    A fold by learner with the day as its clock: each task goes through the sorted
    answers of its learners, and holds one learner's open items.
    """
    names = ["learner", "day", "session", "item", "kind", "ok"]
    out = pa.schema([("learner", pa.int64()), ("day", pa.date32()), *[(c, pa.int32()) for c in ("carried", "settled", "expired", "pending")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = day = None
        book, row, rows = {}, [], []
        left = lambda: sum(len(e["missed"]) for e in book.values())
        for batch in batches:
            for who, when, session, item, kind, ok in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if who != learner or when != day:
                    if row:
                        rows.append((*row, left()))
                    book, expired = midnight(book if who == learner else {}, session)
                    learner, day, row = who, when, [who, when, left(), 0, expired]
                row[3] += answer(book, item, kind, ok, session, session)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                rows = []
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*row, left()), out, strict=True)], schema=out)

    own = answers.filter("learner IS NOT NULL AND day IS NOT NULL").repartition("learner").sortWithinPartitions("learner", "ts", "event_id")
    return own.select(*names).mapInArrow(fold, "learner long, day date, carried int, settled int, expired int, pending int")


def kind_mix(n: int, production: float, kinds: tuple[str, ...] = ("type", "recall"), others: tuple[str, ...] = ("hear", "read")) -> list[str]:
    """n kinds with the given share of production, each sort in turn and spread evenly."""
    asked = min(n, math.floor(production * n + 0.5))
    places = {math.floor((k + 0.5) * n / asked) for k in range(asked)} if asked else set()
    a, b = iter(range(n)), iter(range(n))
    return [kinds[next(a) % len(kinds)] if k in places else others[next(b) % len(others)] for k in range(n)]


def missed_kinds(plan: list[tuple[int, str]], misses: dict[int, list[str]]) -> list[tuple[int, str]]:
    """The plan with the kinds that were missed in place of others, at most half of it moved."""
    out, moved = [], 0
    for item, kind in plan:
        want = next((m for m in misses.get(item, []) if not settles(m, kind)), None)
        if want is not None and 2 * (moved + 1) <= len(plan):
            kind, moved = want, moved + 1
        out.append((item, kind))
    return out


def mixed_kinds(plan: DataFrame, production: float, kinds: tuple[str, ...] = ("type", "recall"), others: tuple[str, ...] = ("hear", "read")) -> DataFrame:
    """plan (learner, place, item) with the kind that kind_mix gives each place, from 1, of a learner's plan; each row by itself, but for the plan's length."""
    n = F.count("*").over(W.partitionBy("learner"))
    asked = F.floor(F.lit(production) * n + 0.5)
    at = F.col("place") - 1
    spots = F.when(asked > 0, F.transform(F.sequence(F.lit(0).cast("long"), asked - 1), lambda j: F.floor((j + 0.5) * n / asked))).otherwise(F.array().cast("array<bigint>"))
    x = plan.withColumn("_s", spots)
    before = F.size(F.filter("_s", lambda p: p < at))
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    return x.withColumn("kind", F.when(F.array_contains("_s", at), pick(kinds, before)).otherwise(pick(others, at - before))).drop("_s")


def swapped_kinds(plan: DataFrame, misses: DataFrame) -> DataFrame:
    """plan (learner, place, item, kind) with the kinds that were missed in place of others, at most half of a learner's plan moved, from the first place on.

    misses: (learner, item, missed), the missed kinds of an item in their order;
    the first that the planned kind would not settle is asked.
    """
    x = plan.join(misses, ["learner", "item"], "left")
    settled_by = lambda m: (m == F.col("kind")) | F.col("kind").isin(*PRODUCTION)
    want = F.get(F.filter(F.coalesce("missed", F.array().cast("array<string>")), lambda m: ~settled_by(m)), F.lit(0))
    x = x.withColumn("_w", want)
    own = W.partitionBy("learner")
    moved = F.count("_w").over(own.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    swap = F.col("_w").isNotNull() & (2 * moved <= F.count("*").over(own))
    return x.withColumn("kind", F.when(swap, F.col("_w")).otherwise(F.col("kind"))).select(*plan.columns)


def weighted_pick(weights: dict[str, float], u: float) -> str:
    """The kind in whose part of the summed weights u, in [0, 1), falls."""
    names, cuts = list(weights), np.cumsum(list(weights.values()))
    return names[int(np.searchsorted(cuts / cuts[-1], u, "right"))]


def hearable(kind: Column, playable: Column) -> tuple[Column, Column]:
    """(kind, asked): a listening item that the device cannot play is read instead and still counts as heard; null playable is not playable."""
    mute = (kind == "hear") & ~F.coalesce(playable, F.lit(False))
    return F.when(mute, "read").otherwise(kind), kind


def weighted_kind(u: Column, weights: dict[str, float]) -> Column:
    """weighted_pick of each row, as a column: the kind in whose part of the summed weights u, in [0, 1), falls."""
    total, at, out = sum(weights.values()), 0.0, None
    for kind, w in weights.items():
        at += w
        low = u < F.lit(at / total)
        out = F.when(low, kind) if out is None else out.when(low, kind)
    return out.otherwise(list(weights)[-1])


def simulate(seeds: DataFrame, items: int = 60, sessions: int = 60, size: int = 15, accuracy: float = 0.85) -> DataFrame:
    """(run, session, x): share of items mastered after each session of a learner who answers with a fixed accuracy; one run for each seed.

    New items come in sets of five while fewer than ten are unmastered.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, streak, met, rows = np.random.default_rng(int(pdf["seed"].iloc[0])), np.zeros(items, int), 0, []
        for session in range(1, sessions + 1):
            if (streak[:met] < 3).sum() < 10:
                met = min(items, met + 5)
            order = np.lexsort((rng.random(met), streak[:met]))[:size]
            right = rng.random(len(order)) < accuracy
            streak[order] = np.where(right, streak[order] + 1, 0)
            rows.append((int(pdf["seed"].iloc[0]), session, round(float((streak >= 3).mean()), 9)))
        return pd.DataFrame(rows, columns=["run", "session", "x"])

    return seeds.groupBy("seed").applyInPandas(run, "run long, session int, x double")
