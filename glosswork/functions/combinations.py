"""Subsets by their number, as column expressions: a walk over the k-subsets of a list that gives another one at each visit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strides of a walk, tried in this order; the first without a factor in common with the number of subsets counts.
STRIDES = (7, 11, 13, 17, 5, 3)


def binomial(n: Column, k: Column) -> Column:
    """How many k-subsets n things have, as a long; 0 where k is negative or more than n. Exact while k times it fits a long."""
    n, k = n.cast("long"), k.cast("long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))
    value = F.aggregate(steps, F.lit(1).cast("long"), lambda c, i: F.call_function("div", c * (n - k + i), i))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(value)


def unranked(n: Column, k: Column, number: Column) -> Column:
    """The k-subset of 0 … n-1 with a number, in lexicographic order from 0, as array<int>; null where there is no such subset.

    One pass over the n things: each is taken if the subsets that take it, given
    what is taken before, are more than the number that is left.
    """
    out = F.array().cast("array<int>")
    start = F.struct(k.cast("long").alias("k"), number.cast("long").alias("left"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        taking = binomial(n.cast("long") - x - 1, s["k"] - 1)
        take = (s["k"] > 0) & (s["left"] < taking)
        skip = (s["k"] > 0) & (s["left"] >= taking)
        return F.struct(
            F.when(take, s["k"] - 1).otherwise(s["k"]).alias("k"), F.when(skip, s["left"] - taking).otherwise(s["left"]).alias("left"), F.when(take, F.concat(s["out"], F.array(x.cast("int")))).otherwise(s["out"]).alias("out")
        )

    things = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when((number >= 0) & (number < binomial(n, k)), F.aggregate(things, start, step, lambda s: s["out"]))


def walk(visit: Column, n: Column, k: Column) -> Column:
    """The number of the subset at a visit of the walk; visits next to each other differ in most members, and all subsets come before one comes again."""
    total = binomial(n, k)
    stride = F.coalesce(*[F.when(total % p != 0, F.lit(p)) for p in STRIDES], F.lit(1))
    return F.when(total > 0, F.pmod(visit.cast("long") * stride, total))


def rotating(visit: Column, n: Column, k: Column) -> Column:
    """The subset at a visit."""
    return unranked(n, k, walk(visit, n, k))
