"""Queries over gates, unit bookkeeping, validation and further statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators import progress as P
from glosswork.operators import relations as R
from glosswork.operators import rules as U
from glosswork.operators import state as S
from glosswork.plans.learner import _FOLD, _PAIRS, _POSITIONS
from glosswork.sources import tables as T
from glosswork.sources.tables import ANSWERS, TOKENS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _grid(spark, d):
    """Each learner with the ten items, in levels of four, ord the item."""
    learners = T.read(spark, d, "events").select(F.col("user_id").alias("learner")).distinct()
    items = learners.select("learner", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("item"))
    return items.select("learner", "item", F.floor(F.col("item") / 4).cast("int").alias("level"), F.col("item").alias("ord"))


_GRID = "grid AS (SELECT learner, CAST(item AS INT) AS item, CAST(item // 4 AS INT) AS level FROM (SELECT DISTINCT user_id AS learner FROM events), (SELECT unnest(range(10)) AS item))"


@query("q65_learned_words", "WITH " + ANSWERS + ", " + _GRID + """,
m AS (SELECT DISTINCT learner, item FROM answers WHERE kind = 'hear'),
i AS (SELECT *, row_number() OVER (PARTITION BY learner, level ORDER BY item) AS i FROM grid)
SELECT i.learner, i.item, i.level, i.item AS ord, m.item IS NOT NULL OR i.i <= (CASE WHEN i.level = 0 THEN i.learner % 3 ELSE 0 END) * 2 AS learned FROM i LEFT JOIN m ON m.learner = i.learner AND m.item = i.item""")
def q65(spark, d):
    met = T.answers(spark, d).filter("kind = 'hear'").select("learner", "item").distinct()
    g = _grid(spark, d)
    sets = g.select("learner").distinct().select("learner", F.lit(0).alias("level"), (F.col("learner") % 3).alias("sets"))
    return U.learned(g, met, 2, sets)


@query("q66_known_words", "WITH RECURSIVE " + _PAIRS + """
SELECT learner, item, count(*) >= 3 AND bool_and(s >= CASE WHEN item >= 7 THEN 2 ELSE 3 END) AS known FROM pairs GROUP BY learner, item""")
def q66(spark, d):
    return U.known(S.pair_state(T.answers(spark, d)), F.col("item") >= 7, 3)


@query("q67_available_sentences", "WITH " + TOKENS + """,
w AS (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 5)
SELECT DISTINCT doc_id * 100000 + sent AS id FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM tokens u WHERE u.doc_id = t.doc_id AND u.sent = t.sent AND u.token NOT IN (SELECT token FROM w))""")
def q67(spark, d):
    t = T.tokens(spark, d)
    words = t.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n")).filter("n >= 5")
    return U.available(t.select((F.col("doc_id") * 100000 + F.col("sent")).alias("id"), F.col("token").alias("word")), words)


@query("q68_typed_ambiguity", "SELECT p_partkey AS id, p_name FROM part WHERE p_name || p_size IN (SELECT p_name || p_size FROM part GROUP BY 1 HAVING count(*) > 1)")
def q68(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.concat("p_name", F.col("p_size").cast("string")).alias("key"))
    return U.ambiguous(p, "key").select("id", "p_name")


@query("q69_next_set", "WITH " + ANSWERS + ", " + _GRID + """,
m AS (SELECT DISTINCT learner, item FROM answers WHERE kind = 'hear' AND session <= 3),
i AS (SELECT *, row_number() OVER (PARTITION BY learner, level ORDER BY item) - 1 AS i FROM grid),
l AS (SELECT *, row_number() OVER (PARTITION BY learner, level ORDER BY item) AS k, min(i) OVER (PARTITION BY learner, level) AS f FROM i ANTI JOIN m ON m.learner = i.learner AND m.item = i.item)
SELECT learner, level, CAST(f // 2 + 1 AS BIGINT) AS set, item FROM l WHERE k <= 2""")
def q69(spark, d):
    met = T.answers(spark, d).filter("kind = 'hear' AND session <= 3").select("learner", "item").distinct()
    return U.next_set(_grid(spark, d), met, 2)


@query("q70_character_ramp", """
WITH s AS (SELECT o_custkey % 5 AS level, CAST(o_custkey // 5 % 8 AS INT) AS chunk, count(*) AS size FROM orders GROUP BY ALL),
r AS (SELECT *, sum(size) OVER (PARTITION BY level ORDER BY chunk) AS stop FROM s),
t AS (SELECT c_custkey AS learner, c_custkey % 5 AS level, c_custkey % 1000 AS taught FROM customer)
SELECT learner, level, chunk FROM t JOIN r USING (level) WHERE taught >= stop - size AND taught < stop""")
def q70(spark, d):
    o, k = T.read(spark, d, "orders"), F.col("o_custkey")
    sizes = o.groupBy((k % 5).alias("level"), (F.floor(k / 5) % 8).cast("int").alias("chunk")).agg(F.count("*").alias("size"))
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("learner"), (F.col("c_custkey") % 5).alias("level"), (F.col("c_custkey") % 1000).alias("taught"))
    return U.chunk_at(U.ramp(sizes), c)


@query("q71_majority_reading", """
WITH c AS (SELECT p_name AS lemma, CASE WHEN p_size % 7 = 0 THEN '?' ELSE p_type END AS pos, count(*) AS n FROM part GROUP BY ALL),
b AS (SELECT lemma, arg_min(pos, (-n, pos)) AS best FROM c WHERE pos <> '?' GROUP BY lemma)
SELECT lemma, CASE WHEN pos = '?' THEN coalesce(best, '?') ELSE pos END AS pos, CAST(sum(n) AS BIGINT) AS n FROM c LEFT JOIN b USING (lemma) GROUP BY ALL""")
def q71(spark, d):
    p = T.read(spark, d, "part")
    c = p.groupBy(F.col("p_name").alias("lemma"), F.when(F.col("p_size") % 7 == 0, "?").otherwise(F.col("p_type")).alias("pos")).agg(F.count("*").alias("n"))
    return U.majority_reading(c)


@query("q72_accent_excess", "WITH " + TOKENS + """,
c AS (SELECT lang || ':' || token AS token, count(*) AS n FROM tokens GROUP BY 1),
p AS (SELECT b.token AS bare, a.token AS accented, b.n AS nb, a.n AS na FROM c a JOIN c b ON b.token = replace(a.token, 'é', 'e') WHERE a.token <> b.token),
m AS (SELECT *, CAST(floor(greatest(0.0::DOUBLE, nb - 0.25::DOUBLE * (nb + na))) AS BIGINT) AS moved FROM p),
d AS (SELECT token, sum(d) AS d FROM (SELECT bare AS token, -moved AS d FROM m UNION ALL SELECT accented, moved FROM m) GROUP BY token)
SELECT token, CAST(n + coalesce(d, 0) AS BIGINT) AS n FROM c LEFT JOIN d USING (token)""")
def q72(spark, d):
    c = T.tokens(spark, d).groupBy(F.concat_ws(":", "lang", "token").alias("token")).agg(F.count("*").alias("n"))
    bare = c.select(F.replace("token", F.lit("é"), F.lit("e")).alias("bare"), F.col("token").alias("accented")).filter("bare <> accented")
    return U.accent_excess(c, bare.join(c.select(F.col("token").alias("bare")), "bare").withColumn("share", F.lit(0.25)))


@query("q73_passage_weak_words", "WITH " + ANSWERS + """,
x AS (SELECT session AS passage, item, 1 AS weight, 'tapped' AS why FROM answers WHERE kind = 'hear' UNION ALL SELECT session, item, 2, 'wrong' FROM answers WHERE NOT ok)
SELECT passage, item, max(weight) AS weight, CASE WHEN count(DISTINCT why) = 2 THEN 'tapped+wrong' ELSE min(why) END AS why FROM x GROUP BY ALL""")
def q73(spark, d):
    a = T.answers(spark, d).withColumnRenamed("session", "passage")
    return U.weak_words(a.filter("kind = 'hear'"), a.filter("NOT ok"))


_TRACES = _POSITIONS + ", go AS (SELECT learner AS run, min(session) AS goal FROM pos WHERE x >= 0.9 GROUP BY learner)"
_CURVE = """,
g AS (SELECT run, goal, round(k * 0.05::DOUBLE, 9) AS g FROM go, (SELECT unnest(range(21)) AS k)),
f AS (SELECT run, g, goal, min(session) AS first FROM g JOIN pos ON learner = run WHERE x >= g - 1e-9 GROUP BY ALL),
curve AS (SELECT g AS x, count(*) AS runs, round(avg(goal - first), 9) AS "left" FROM f WHERE first <= goal GROUP BY g HAVING count(*) >= 2)"""


def _traces(spark, d):
    pos = P.session_positions(T.answers(spark, d))
    goals = pos.filter("x >= 0.9").groupBy(F.col("learner").alias("run")).agg(F.min("session").alias("session"))
    return pos.withColumnRenamed("learner", "run"), goals


@query("q74_goal_curve", "WITH " + _TRACES + _CURVE + " SELECT * FROM curve")
def q74(spark, d):
    return U.goal_curve(*_traces(spark, d))


@query("q75_eta_gate", "WITH " + _TRACES + _CURVE + """,
a AS (SELECT g AS x, goal - first AS actual FROM f WHERE first <= goal AND run % 3 = 0)
SELECT x, count(*) AS n, count(*) FILTER (abs(actual - "left") <= 0.3 * greatest("left", 1.0)) AS within, 3 * within >= 2 * n AS ok FROM a JOIN curve USING (x) GROUP BY x""")
def q75(spark, d):
    pos, goals = _traces(spark, d)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.round(k * 0.05, 9)))
    g = goals.filter("run % 3 = 0").select("run", F.col("session").alias("goal"), grid.alias("g"))
    first = pos.join(g, "run").filter(F.col("x") >= F.col("g") - 1e-9).groupBy("run", "g", "goal").agg(F.min("session").alias("first")).filter("first <= goal")
    return U.eta_gate(U.goal_curve(pos, goals), first.select(F.col("g").alias("x"), (F.col("goal") - F.col("first")).alias("actual")))


@query("q76_last_snapshots", "WITH " + _POSITIONS + " SELECT learner, session, x FROM pos QUALIFY row_number() OVER (PARTITION BY learner ORDER BY session DESC) <= 14")
def q76(spark, d):
    return U.last_snapshots(P.session_positions(T.answers(spark, d)).withColumn("at", F.col("session")))


@query("q77_passage_upserts", "WITH " + ANSWERS + """
SELECT learner, item AS passage, arg_max(value, (ts, event_id)) AS score, max(session) AS session, bool_or(value > 30) AS listened, count(*) AS times FROM answers WHERE kind = 'read' GROUP BY ALL""")
def q77(spark, d):
    a = T.answers(spark, d).filter("kind = 'read'")
    return U.upsert_passages(a.select("learner", F.col("item").alias("passage"), F.col("value").alias("score"), "session", (F.col("value") > 30).alias("listened"), "ts", "event_id"))


@query("q78_span_rules", """
WITH s AS (SELECT l_orderkey AS id, list({'a': l_quantity::INT, 'b': (l_quantity + l_linenumber * 2 - 2)::INT} ORDER BY l_quantity::INT, l_linenumber, l_partkey) AS s FROM lineitem GROUP BY l_orderkey),
x AS (SELECT id, CASE WHEN len(list_filter(s, lambda v: v.a < 0 OR v.b > 55)) > 0 THEN 'range' WHEN len(list_filter(s, lambda v: v.b <= v.a)) > 0 THEN 'empty'
  WHEN len(list_filter(range(1, len(s)), lambda i: s[i + 1].a < s[i].b)) > 0 THEN 'overlap' END AS fault FROM s)
SELECT id, fault FROM x WHERE fault IS NOT NULL""")
def q78(spark, d):
    q = F.col("l_quantity").cast("int")
    stop = (F.col("l_quantity") + F.col("l_linenumber") * 2 - 2).cast("int")
    x = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(q.alias("start"), "l_linenumber", "l_partkey", stop.alias("stop")).alias("s"))
    g = x.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(s["start"], s["stop"])).alias("spans"), F.lit(55).alias("length"))
    return U.spans_faulty(g)


@query("q79_manifest_diff", """
WITH a AS (SELECT o_orderkey AS key, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 9 <> 1), b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 8 = 2 THEN 'old' ELSE md5(o_orderstatus) END AS h FROM orders WHERE o_orderkey % 9 <> 2)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'orphan' ELSE 'stale' END AS status FROM a FULL JOIN b ON a.key = b.key WHERE a.h IS DISTINCT FROM b.h""")
def q79(spark, d):
    k, h = F.col("o_orderkey"), F.md5("o_orderstatus")
    o = T.read(spark, d, "orders")
    return U.manifest_diff(o.filter(k % 9 != 1).select(k.alias("key"), h.alias("hash")), o.filter(k % 9 != 2).select(k.alias("key"), F.when(k % 8 == 2, "old").otherwise(h).alias("hash")))


@query("q80_overrides", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 'fixed' ELSE p_name END AS p_name, false AS unused FROM part
UNION ALL SELECT p_partkey + 1000000, 'fixed', true FROM part WHERE p_partkey % 400 = 0""")
def q80(spark, d):
    # The planted overrides are of another list, so that they fit no part however many there are.
    key = lambda k, other: F.struct(k.alias("k"), F.lit(other).alias("other")).alias("id")
    k = F.col("p_partkey")
    p = T.read(spark, d, "part")
    table = p.filter(k % 40 == 0).select(key(k, False)).unionByName(p.filter(k % 400 == 0).select(key(k + 1000000, True))).withColumn("value", F.lit("fixed"))
    rows, unused = U.overrides(p.select(key(k, False), "p_name"), table, "p_name")
    return rows.select("id.k", "p_name", F.lit(False).alias("unused")).unionByName(unused.select("id.k", F.col("value").alias("p_name"), F.lit(True).alias("unused"))).withColumnRenamed("k", "id")


@query("q81_pattern_picks", "WITH RECURSIVE " + _PAIRS + """
SELECT learner, item AS pattern, s, session, row_number() OVER (PARTITION BY learner ORDER BY s, session, item) AS place FROM pairs WHERE kind = 'recall' QUALIFY place <= 4""")
def q81(spark, d):
    p = S.pair_state(T.answers(spark, d)).filter("kind = 'recall'")
    return U.pattern_picks(p.select("learner", F.col("item").alias("pattern"), "s", "session"), 4)


@query("q82_unified_review", _FOLD + """,
st AS (SELECT learner, item, r, w, s FROM f QUALIFY row_number() OVER (PARTITION BY learner, item ORDER BY i DESC) = 1),
u AS (SELECT learner, 'word' AS what, item, 3 * w - s AS score FROM st WHERE item < 5 UNION ALL SELECT learner, 'unit', item, 2 * w - s FROM st WHERE item >= 5)
SELECT learner, what, item, score, row_number() OVER (PARTITION BY learner ORDER BY score DESC, what, item) AS place FROM u QUALIFY place <= 6""")
def q82(spark, d):
    st = S.answer_fold(T.answers(spark, d))
    part = lambda cond, what, k: st.filter(cond).select("learner", F.lit(what).alias("what"), "item", (k * F.col("w") - F.col("s")).alias("score"))
    u = part("item < 5", "word", 3).unionByName(part("item >= 5", "unit", 2))
    return u.withColumn("place", F.row_number().over(W.partitionBy("learner").orderBy(F.col("score").desc(), "what", "item"))).filter("place <= 6")


@query("q83_duplicates", "WITH " + TOKENS + " SELECT token, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM tokens GROUP BY token HAVING count(DISTINCT lang) > 1")
def q83(spark, d):
    return T.tokens(spark, d).groupBy("token").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources")).filter("langs > 1")


@query("q84_allowed_and_retired_sets", "WITH " + TOKENS + """,
c AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM conversations)
SELECT 'allowed' AS set, count(*) AS n FROM (SELECT token FROM c WHERE n >= 20 UNION SELECT token FROM s)
UNION ALL SELECT 'common', count(*) FROM (SELECT token FROM c INTERSECT SELECT token FROM s) UNION ALL SELECT 'unused', count(*) FROM (SELECT token FROM s EXCEPT SELECT token FROM c)""")
def q84(spark, d):
    c = T.tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    s = T.read(spark, d, "conversations").select(F.explode(T.words_of(F.lower("text"))).alias("token")).distinct()
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("set"), "n")
    t = c.select("token")
    return size(c.filter("n >= 20").select("token").union(s).distinct(), "allowed").unionByName(size(t.intersect(s), "common")).unionByName(size(s.exceptAll(t), "unused"))


@query("q85_flag_drift", """
WITH a AS (SELECT n_nationkey AS k, n_regionkey % 2 AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, n_nationkey % 2 AS v FROM nation WHERE n_nationkey > 3)
SELECT coalesce(a.k, b.k) AS n_nationkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE 'flag' END AS fields
FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def q85(spark, d):
    n = T.read(spark, d, "nation")
    a = n.filter("n_nationkey < 20").select("n_nationkey", (F.col("n_regionkey") % 2).alias("flag"))
    return R.version_diff(a, n.filter("n_nationkey > 3").select("n_nationkey", (F.col("n_nationkey") % 2).alias("flag")), "n_nationkey", ["flag"])
