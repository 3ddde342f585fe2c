"""Queries over the answer log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import progress as P
from glosswork.operators import state as S
from glosswork.sources import tables as T
from glosswork.sources.tables import ANSWERS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_JITTER = "(CAST('0x' || substr(md5(concat_ws(':', '7', {keys})), 1, 8) AS BIGINT) / 4294967296.0 - 0.5)"

_STATE = ANSWERS + """,
lm AS (SELECT learner, item, max(struct_pack(ts := ts, event_id := event_id, kind := kind)) FILTER (NOT ok) AS miss, count(*) FILTER (ok) AS r,
  count(*) FILTER (NOT ok) AS w, max(day) AS t, max(session) AS u FROM answers GROUP BY learner, item),
af AS (SELECT a.learner, a.item, count(*) AS s, coalesce(bool_or(a.kind = l.miss.kind), false) AS settled FROM answers a JOIN lm l USING (learner, item)
  WHERE a.ok AND (l.miss IS NULL OR (a.ts, a.event_id) > (l.miss.ts, l.miss.event_id)) GROUP BY a.learner, a.item),
state AS (SELECT l.learner, l.item, r, w, coalesce(s, 0) AS s, CASE WHEN NOT coalesce(settled, false) THEN miss.kind END AS k, t, u FROM lm l LEFT JOIN af USING (learner, item))"""

_ORDERED = ANSWERS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) AS i FROM answers)"""

#: Sequential folds as recursion over the places of a group's answers.
_FOLD = "WITH RECURSIVE " + _ORDERED.format(by="learner, item") + """,
f AS (SELECT learner, item, i, CAST(ok AS INT) AS r, CAST(NOT ok AS INT) AS w, CAST(ok AS INT) AS s,
    CASE WHEN NOT ok THEN kind END AS k, day AS t, session AS u FROM o WHERE i = 1
  UNION ALL SELECT o.learner, o.item, o.i, r + CAST(ok AS INT), w + CAST(NOT ok AS INT), CASE WHEN ok THEN s + 1 ELSE 0 END,
    CASE WHEN NOT ok THEN kind WHEN k = kind THEN NULL ELSE k END, o.day, o.session
  FROM f JOIN o ON o.learner = f.learner AND o.item = f.item AND o.i = f.i + 1)"""


def state(spark: SparkSession, d: str) -> DataFrame:
    return S.answer_fold(T.answers(spark, d))


@query("q01_answer_fold", _FOLD + " SELECT learner, item, r, w, s, k, t, u FROM f QUALIFY row_number() OVER (PARTITION BY learner, item ORDER BY i DESC) = 1")
def q01(spark, d):
    return state(spark, d)


@query("q02_streak_islands", "WITH " + ANSWERS + """,
x AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY learner, item ORDER BY ts, event_id) AS island FROM answers),
g AS (SELECT learner, item, island, count(*) AS n FROM x WHERE ok GROUP BY ALL)
SELECT learner, item, max(n) AS longest, count(*) AS runs FROM g GROUP BY ALL""")
def q02(spark, d):
    return S.streak_islands(T.answers(spark, d))


@query("q03_typed_hold_fold", "WITH RECURSIVE " + _ORDERED.format(by="learner, item") + """,
f AS (SELECT learner, item, i, CAST(ok AS INT) AS r, CAST(NOT ok AS INT) AS w, CAST(ok AS INT) AS s FROM o WHERE i = 1
  UNION ALL SELECT o.learner, o.item, o.i, r + CAST(ok AS INT), w + CAST(NOT ok AS INT),
    CASE WHEN s < 2 THEN CASE WHEN ok THEN s + 1 ELSE 0 END WHEN NOT ok THEN s - 1 WHEN kind = 'type' THEN s + 1 ELSE s END
  FROM f JOIN o ON o.learner = f.learner AND o.item = f.item AND o.i = f.i + 1)
SELECT learner, item, r, w, s FROM f QUALIFY row_number() OVER (PARTITION BY learner, item ORDER BY i DESC) = 1""")
def q03(spark, d):
    return S.typed_hold_fold(T.answers(spark, d))


_PAIRS = _ORDERED.format(by="learner, item, kind") + """,
f AS (SELECT learner, item, kind, i, CAST(ok AS INT) AS s, session FROM o WHERE i = 1
  UNION ALL SELECT o.learner, o.item, o.kind, o.i,
    CASE WHEN NOT ok THEN 0 WHEN o.session <> f.session AND (o.kind IN ('type', 'recall') OR s < 2) THEN s + 1 ELSE s END, o.session
  FROM f JOIN o ON o.learner = f.learner AND o.item = f.item AND o.kind = f.kind AND o.i = f.i + 1),
pairs AS (SELECT learner, item, kind, s, session FROM f QUALIFY row_number() OVER (PARTITION BY learner, item, kind ORDER BY i DESC) = 1)"""


@query("q04_pair_state", "WITH RECURSIVE " + _PAIRS + " SELECT * FROM pairs")
def q04(spark, d):
    return S.pair_state(T.answers(spark, d))


@query("q05_weak_first_topk", "WITH " + _STATE + f""",
x AS (SELECT *, round(3 * w - s + {_JITTER.format(keys="learner, item")}, 9) AS score FROM state),
y AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY score DESC, item) AS place FROM x)
SELECT learner, place, item, r, w, s, score FROM y WHERE place <= 5""")
def q05(spark, d):
    return S.weak_first(state(spark, d))


@query("q06_day_tiers", "WITH " + _STATE + """,
n AS (SELECT learner, max(session) AS sn, max(day) AS today FROM answers GROUP BY learner),
m AS (SELECT learner, item, max(session) AS missed FROM answers WHERE NOT ok GROUP BY ALL),
q AS (SELECT learner, item, count(DISTINCT kind) AS asked, bool_or(ok) AS gone FROM answers JOIN n USING (learner) WHERE day = today GROUP BY ALL)
SELECT learner, item, CASE WHEN k IS NOT NULL AND sn - missed < 6 THEN 0
  WHEN NOT (coalesce(gone, false) OR u >= sn - 2) THEN CASE WHEN s >= 3 THEN 2 ELSE 1 END
  WHEN coalesce(asked, 0) < 4 THEN 3 ELSE 4 END AS tier
FROM state JOIN n USING (learner) LEFT JOIN m USING (learner, item) LEFT JOIN q USING (learner, item)""")
def q06(spark, d):
    a = T.answers(spark, d)
    return S.day_tiers(S.answer_fold(a), a)


@query("q07_pair_candidates_ranked", "WITH RECURSIVE " + _PAIRS + f""",
x AS (SELECT *, CASE WHEN s < 3 THEN 'low' ELSE 'high' END AS list, {_JITTER.format(keys="learner, item, kind")} AS j FROM pairs)
SELECT learner, list, row_number() OVER (PARTITION BY learner, list ORDER BY CASE WHEN s < 3 THEN s ELSE 0 END,
  CASE WHEN s < 3 THEN CASE WHEN kind = 'type' THEN 0 ELSE 1 END ELSE 0 END, session, j, item, kind) AS place, item, kind, s, session FROM x""")
def q07(spark, d):
    return S.pair_candidates(S.pair_state(T.answers(spark, d)))


@query("q08_recent_misses", "WITH " + ANSWERS + """,
n AS (SELECT learner, max(session) AS sn FROM answers GROUP BY learner),
m AS (SELECT learner, item, max(session) AS a, count(*) AS misses FROM answers WHERE NOT ok GROUP BY ALL)
SELECT learner, row_number() OVER (PARTITION BY learner ORDER BY a DESC, item) AS place, item, a, misses FROM m JOIN n USING (learner) WHERE a >= sn - 6""")
def q08(spark, d):
    return S.recent_misses(T.answers(spark, d))


@query("q09_session_ordinals", "WITH " + ANSWERS + " SELECT learner, session, day, count(*) AS answers, round(avg(CAST(ok AS INT)), 9) AS right_share FROM answers GROUP BY ALL")
def q09(spark, d):
    return S.session_ordinals(T.answers(spark, d))


_POSITION = """,
kn AS (SELECT learner, count(*) FILTER (s >= 3) / 10 AS known FROM state GROUP BY learner),
pr AS (SELECT learner, count(*) FILTER (kind = 'recall' AND s >= 2) / 10 AS units_ok, count(*) FILTER (kind = 'hear' AND s >= 1) / 10 AS listened FROM pairs GROUP BY learner)
SELECT learner, round(known, 9) AS known, round(units_ok, 9) AS units_ok, round(listened, 9) AS listened,
  round(greatest(0.0, least(1.0, 0.6 * known + 0.2 * units_ok + 0.2 * listened)), 9) AS position FROM kn JOIN pr USING (learner)"""


@query("q10_progress_position", "WITH RECURSIVE " + _PAIRS + _STATE.replace(ANSWERS, "") + _POSITION)
def q10(spark, d):
    a = T.answers(spark, d)
    return P.progress_position(S.answer_fold(a), S.pair_state(a))


@query("q180_map_position", "WITH RECURSIVE " + _PAIRS + _STATE.replace(ANSWERS, "") + _POSITION.replace("0.6 * known + 0.2 * units_ok + 0.2 * listened", "0.5 * known + 0.25 * units_ok + 0.25 * listened"))
def q180(spark, d):
    """The position on the whole map."""
    a = T.answers(spark, d)
    return P.progress_position(S.answer_fold(a), S.pair_state(a), weights=P.MAP_WEIGHTS)


_LEVELS = {0: 4, 1: 4, 2: 2, 3: 0}


@query("q11_level_gate", "WITH " + _STATE + """,
lv AS (SELECT * FROM (VALUES (0, 4), (1, 4), (2, 2), (3, 0)) v(level, size)),
kn AS (SELECT learner, CAST(floor(item / 4) AS INT) AS level, count(*) AS n FROM state WHERE s >= 3 GROUP BY ALL),
sh AS (SELECT learner, level, round(CASE WHEN size = 0 THEN 1.0 ELSE coalesce(n, 0) / size END, 9) AS share
  FROM (SELECT DISTINCT learner FROM state) CROSS JOIN lv LEFT JOIN kn USING (learner, level)),
b AS (SELECT *, lag(share) OVER (PARTITION BY learner ORDER BY level) AS before FROM sh)
SELECT learner, level, share, coalesce(before + 1e-9 < 0.7, false) AS held FROM b WHERE share + 1e-9 < 0.9
QUALIFY row_number() OVER (PARTITION BY learner ORDER BY level) = 1""")
def q11(spark, d):
    return P.level_gate(P.level_shares(state(spark, d), _LEVELS))


_POSITIONS = ANSWERS + """,
sec AS (SELECT learner, session, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY learner, item ORDER BY ts, event_id) AS i FROM answers WHERE ok) WHERE i = 2 GROUP BY ALL),
pos AS (SELECT learner, session, round(sum(coalesce(n, 0)) OVER (PARTITION BY learner ORDER BY session) / 10, 9) AS x
  FROM (SELECT DISTINCT learner, session FROM answers) LEFT JOIN sec USING (learner, session))"""


@query("q12_pace_eta", "WITH " + _POSITIONS + """,
l AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY session DESC) AS i FROM pos),
g AS (SELECT learner, count(*) AS n, arg_min(x, session) AS xa, arg_max(x, session) AS xb, min(session) AS sa, max(session) AS sb FROM l WHERE i <= 14 GROUP BY learner),
p AS (SELECT *, CASE WHEN n = 14 THEN (xb - xa) / nullif(sb - sa, 0) END AS pace FROM g)
SELECT learner, xb AS x, round(pace, 9) AS pace, CAST(CASE WHEN xb >= 0.9 THEN 0 WHEN pace > 0 THEN ceil((0.9 - xb) / pace - 1e-9) END AS DOUBLE) AS sessions_to_go FROM p""")
def q12(spark, d):
    return P.pace_eta(P.session_positions(T.answers(spark, d)))


@query("q13_eta_curve_lookup", "WITH " + _POSITIONS + """,
c AS (SELECT * FROM (VALUES (0.1::DOUBLE, 40.0::DOUBLE, 0.3::DOUBLE, 28.0::DOUBLE), (0.3, 28.0, 0.5, 17.0), (0.5, 17.0, 0.7, 8.0), (0.7, 8.0, 0.85, 2.0)) v(x0, y0, x1, y1)),
j AS (SELECT learner, session, x, CASE WHEN x < 0.1 THEN 40.0 ELSE coalesce((SELECT y0 + (x - x0) * ((y1 - y0) / (x1 - x0)) FROM c WHERE x BETWEEN x0 AND x1 ORDER BY x0 LIMIT 1), 0) END AS y FROM pos)
SELECT learner, session, x, CAST(CASE WHEN x >= 0.9 THEN 0 ELSE greatest(1, ceil(y - 1e-9)) END AS BIGINT) AS sessions_left FROM j""")
def q13(spark, d):
    return P.eta_lookup(P.session_positions(T.answers(spark, d)))


@query("q14_goal_crossing", "WITH " + _POSITIONS + """,
y AS (SELECT *, min(x) OVER (PARTITION BY learner ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM pos)
SELECT learner, min(session) AS session FROM y WHERE x >= 0.9 AND ahead >= 0.88 GROUP BY learner""")
def q14(spark, d):
    return P.goal_crossing(P.session_positions(T.answers(spark, d)), P.GOAL)


@query("q15_holds", "WITH " + ANSWERS + """,
r AS (SELECT learner, session, round(avg(CAST(ok AS INT)), 9) AS right_share FROM answers GROUP BY ALL),
x AS (SELECT *, right_share < 0.7 AS shut FROM r),
c AS (SELECT *, CASE WHEN shut <> coalesce(lag(shut) OVER (PARTITION BY learner ORDER BY session), NOT shut) THEN 1 ELSE 0 END AS change FROM x),
i AS (SELECT *, sum(change) OVER (PARTITION BY learner ORDER BY session) AS island FROM c)
SELECT learner, min(session) AS start, max(session) AS stop, count(*) AS n FROM i WHERE shut GROUP BY learner, island HAVING count(*) >= 2""")
def q15(spark, d):
    return P.holds(S.session_ordinals(T.answers(spark, d)), P.GATE)


@query("q16_reading_stats", "WITH " + ANSWERS + """
SELECT item % 3 AS level, count(*) AS total, count(*) FILTER (value >= 5) AS done, round(avg(CASE WHEN value >= 5 THEN 100.0 * least(value / 50, 1.0) END), 6) AS mean_pct
FROM answers WHERE kind = 'read' GROUP BY ALL""")
def q16(spark, d):
    a = T.answers(spark, d).filter("kind = 'read'")
    return P.reading_stats(a.select((F.col("item") % 3).alias("level"), (F.col("value") >= 5).alias("done"), F.least(F.col("value") / 50, F.lit(1.0)).alias("score")))


@query("q17_reading_speed", "WITH " + ANSWERS + """
SELECT learner, count(*) AS n, CAST(CASE WHEN count(*) >= 3 THEN greatest(1.0, round(median(60 / (value + 1)))) END AS BIGINT) AS speed FROM answers WHERE kind = 'read' GROUP BY learner""")
def q17(spark, d):
    a = T.answers(spark, d).filter("kind = 'read'")
    return P.reading_speed(a.select("learner", (60 / (F.col("value") + 1)).alias("speed")))


@query("q57_critical_words", "WITH " + ANSWERS + """,
l AS (SELECT learner, item, arg_max(ok, (ts, event_id)) AS ok, arg_max(session, (ts, event_id)) AS added FROM answers WHERE kind = 'type' GROUP BY ALL)
SELECT learner, item, added, place FROM (SELECT learner, item, added, row_number() OVER (PARTITION BY learner ORDER BY added, item) AS place FROM l WHERE NOT ok) WHERE place <= 3""")
def q57(spark, d):
    return S.critical_events(T.answers(spark, d))
