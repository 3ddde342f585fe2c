"""The answer fold as a stream: per-item state kept for each learner, updated by micro-batches.

Events carry their own order (ts, event_id). A micro-batch is sorted by it and
folded on; an event that is older than what its learner's state has seen is
dropped and counted, as the fold depends on order. The state of a learner is
one row: (last event, day, session, items) with an entry for each item met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswork.sources.tables import KINDS

RESULT = "learner long, item int, r long, w long, s long, k string, t date, u int, late long"
_STATE = "ts long, event_id long, day string, session int, late long, items string"


def step(record: dict, ok: bool, kind: str, day: str, session: int) -> dict:
    """The record of an item after one more answer."""
    out = record | {"t": day, "u": session}
    if ok:
        return out | {"r": out["r"] + 1, "s": out["s"] + 1, "k": None if out["k"] == kind else out["k"]}
    return out | {"w": out["w"] + 1, "s": 0, "k": kind}


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ts, event_id, day, session, late, items = state.get if state.exists else (-1, -1, "", 0, 0, "{}")
    book, touched = json.loads(items), set()
    for row in pd.concat(list(batches)).sort_values(["at", "event_id"]).itertuples(index=False):
        if (row.at, row.event_id) <= (ts, event_id):
            late += 1
            continue
        ts, event_id = row.at, row.event_id
        if row.day != day:
            day, session = row.day, session + 1
        name = str(row.item)
        book[name] = step(book.get(name, {"r": 0, "w": 0, "s": 0, "k": None}), bool(row.ok), row.kind, day, session)
        touched.add(name)
    state.update((int(ts), int(event_id), day, session, late, json.dumps(book)))
    rows = [(key[0], int(n), *(book[n][c] for c in "rwsk"), pd.Timestamp(book[n]["t"]).date(), book[n]["u"], late) for n in sorted(touched)]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def answer_stream(events: DataFrame) -> DataFrame:
    """RESULT rows of the items that each micro-batch of events has touched (update mode)."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    a = events.select(
        F.col("user_id").alias("learner"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("item"),
        (F.col("event_type") != "error").alias("ok"),
        kind[F.col("event_type")].alias("kind"),
        F.to_date("ts").cast("string").alias("day"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
    )
    return a.groupBy("learner").applyInPandasWithState(_fold, RESULT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, path: str, schema, where: str, files_per_trigger: int = 1000) -> DataFrame:
    """Folds all events under path as a stream, writes the updates of each micro-batch under `where`, and returns each item's last row."""
    # A pattern that only path fits: of a plain path the source expects a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")
    out = f"{where}/updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = answer_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("learner", "item").agg(F.max_by(F.struct("r", "w", "s", "k", "t", "u"), "batch").alias("x"))
    return last.select("learner", "item", "x.*")
