"""Row numbers and carried values over whole tables against plain Python."""

import random

from pyspark.sql import functions as F

from glosswork.operators.settle import carried, numbered


def rows(n):
    rng = random.Random(4)
    return [(k, rng.choice(["a", "a", "b", None]), rng.randrange(n), rng.choice([None, None, "x", "y"])) for k in range(n)]


def test_numbers(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "id long, g string, n long, v string").repartition(7)
    for by in (["g"], []):
        got = {r["id"]: r["rank"] for r in numbered(df, by, [F.desc("n"), F.col("id")]).collect()}
        want = {}
        for group in {r[1] for r in data} if by else {0}:
            some = sorted((r for r in data if not by or r[1] == group), key=lambda r: (-r[2], r[0]))
            want |= {r[0]: k for k, r in enumerate(some, 1)}
        assert got == want


def test_carried_values(spark):
    data = rows(500)
    df = spark.createDataFrame(data, "id long, g string, n long, v string").repartition(7)
    got = {r["id"]: r["last"] for r in carried(df, ["g"], [F.col("n"), F.col("id")], "v", "last").collect()}
    want = {}
    for group in {r[1] for r in data}:
        last = None
        for r in sorted((r for r in data if r[1] == group), key=lambda r: (r[2], r[0])):
            last = r[3] if r[3] is not None else last
            want[r[0]] = last
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, g string, n long, v string")
    assert numbered(df, ["g"], [F.col("n")]).count() == 0 == carried(df, ["g"], [F.col("n")], "v", "last").count()
