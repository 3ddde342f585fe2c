"""The plans of a day and of pairs against plain Python, one learner after another."""

import math
import random

import pytest

from glosswork.operators import planners as P
from glosswork.operators import sessions as S

COLUMNS = "learner int, item int, tier int, word boolean, held boolean, consolidating boolean, since int, weak int, s int, age int, asked int, jitter double, aged boolean"


def day(rows, n, held, consolidate, last_tier):
    """Lists that are taken from in turn; an item stands in several, and counts where it is taken first."""
    low = lambda x: -math.inf if x is None else x
    end = lambda r: (r["jitter"], r["item"])
    tier = lambda k: [r for r in rows if r["tier"] == k and not r["consolidating"]]
    of = {
        0: sorted(tier(0), key=lambda r: (math.inf if r["since"] is None else r["since"], -r["weak"], *end(r))),
        1: sorted(tier(1), key=lambda r: (r["s"], low(r["age"]), *end(r))),
        2: sorted(tier(2), key=lambda r: (low(r["age"]), r["s"], *end(r))),
        3: sorted(tier(3), key=lambda r: (r["asked"], r["s"], *end(r))),
        4: sorted(tier(4), key=lambda r: (r["asked"], *end(r))),
        "c": sorted((r for r in rows if r["consolidating"]), key=lambda r: (not r["aged"], low(r["age"]), r["s"], *end(r))),
    }
    out = []

    def take(some, k):
        for r in some:
            if k <= 0 or len(out) >= n:
                return
            if r not in out:
                out.append(r)
                k -= 1

    up = lambda x: math.ceil(x * n - 1e-9)
    c = len(of["c"])
    take(of[0], max(1, math.floor(0.6 * n + 1e-9)))
    if held:
        take(sorted((r for r in of[1] + of[3] if r["held"]), key=lambda r: (low(r["age"]), *end(r))), min(math.floor(held * n + 0.5), n - len(out) - min(up(0.25), c)))
    take([r for r in of[1] if r["word"]], min(math.floor(0.4 * n + 0.5) - sum(r["word"] for r in out), n - len(out) - min(up(0.15), c)))
    take(of["c"], up(consolidate))
    take(of[2], up(0.2))
    take(of[1], n)
    take(of[3], up(0.25))
    for k in ("c", 2, 3, 0):
        take(of[k], n)
    take(of[4], n if last_tier is None else last_tier - len(out))
    return [r["item"] for r in out]


@pytest.mark.parametrize("n,held,consolidate,last_tier", [(10, None, 0.15, None), (12, 0.3, 0.35, None), (8, 1.0, 0.15, 5), (5, 0.3, 0.15, 0)])
def test_day_plan(spark, n, held, consolidate, last_tier):
    rng = random.Random(n)
    maybe = lambda m: None if rng.random() < 0.2 else rng.randrange(m)
    rows = []
    for learner in range(12):
        for item in range(rng.randrange(1, 40)):
            word, tier = rng.random() < 0.5, rng.choices(range(5), [2, 4, 3, 2, 2])[0]
            rows.append((learner, item, tier, word, word and rng.random() < 0.4, not word and tier == 2 and rng.random() < 0.6, maybe(9), rng.randrange(5), rng.randrange(4), maybe(9), rng.randrange(4), float(rng.randrange(3)), rng.random() < 0.3))
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    got = {}
    for r in P.day_plan(spark.createDataFrame(rows, COLUMNS), n, held, consolidate, last_tier).orderBy("learner", "place").collect():
        got.setdefault(r["learner"], []).append((r["place"], r["item"]))
    for learner in range(12):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == learner]
        assert got.get(learner, []) == list(enumerate(day(own, n, held, consolidate, last_tier), 1))


def pairs(rows, n=8):
    low = sorted((r for r in rows if r[3] < 3), key=lambda r: (r[3], r[2] != "type", r[4], r[1], r[2]))
    high = sorted((r for r in rows if r[3] >= 3), key=lambda r: (r[4], r[1], r[2]))
    out, used = [], set()
    for some, until in ((low, n - min(math.ceil(P.REFRESH_SHARE * n), len({r[1] for r in high}))), (high, n), (low, n)):
        for r in some:
            if len(out) < until and r[1] not in used:
                used.add(r[1])
                out.append((r[1], r[2]))
    return out


def test_pair_plan(spark):
    rng = random.Random(6)
    rows = [(learner, item, kind, rng.choice([0, 1, 2, 3, 4] if learner % 2 else [3, 4, 0]), rng.randrange(5)) for learner in range(20) for item in range(rng.randrange(1, 14)) for kind in rng.sample(["type", "recall", "hear", "read"], rng.randrange(1, 4))]
    got = {}
    for r in P.pair_plan(spark.createDataFrame(rows, "learner long, item int, kind string, s int, session int")).orderBy("learner", "place").collect():
        got.setdefault(r["learner"], []).append((r["item"], r["kind"]))
    assert got == {learner: pairs([r for r in rows if r[0] == learner]) for learner in range(20)}


@pytest.mark.parametrize("production", [0.0, 0.3, 0.5, 1.0])
def test_kinds_of_a_plan(spark, production):
    rng = random.Random(4)
    sizes = {k: rng.randrange(1, 14) for k in range(12)}
    rows = [(k, place, 10 * place) for k, n in sizes.items() for place in range(1, n + 1)]
    missed = {(k, item): rng.sample(["type", "recall", "hear", "read"], rng.randrange(1, 4)) for k, _, item in rows if rng.random() < 0.6}
    plan = S.mixed_kinds(spark.createDataFrame(rows, "learner int, place int, item int"), production)
    out = S.swapped_kinds(plan, spark.createDataFrame([(*k, v) for k, v in missed.items()], "learner int, item int, missed array<string>"))
    got = {(r["learner"], r["place"]): r["kind"] for r in out.collect()}
    for k, n in sizes.items():
        kinds = S.kind_mix(n, production)
        want = S.missed_kinds([(10 * p, kind) for p, kind in enumerate(kinds, 1)], {i: v for (learner, i), v in missed.items() if learner == k})
        assert [got[k, p] for p in range(1, n + 1)] == [kind for _, kind in want]
