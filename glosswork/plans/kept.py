"""Queries over units, goals and the settling of records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.operators import planners
from glosswork.operators import state as S
from glosswork.operators import units as N
from glosswork.plans.learner import _PAIRS, _STATE
from glosswork.sources import tables as T
from glosswork.sources.html import twin_candidates
from glosswork.sources.tables import TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q112_noun_display", """
SELECT p_partkey AS id, CASE g WHEN '' THEN '' ELSE g || CASE WHEN p_size % 2 = 0 THEN 'p' ELSE '' END END AS code,
  CASE WHEN p_size > 45 OR a = '' THEN p_name WHEN a LIKE '%''' THEN a || p_name ELSE a || ' ' || p_name END AS shown
FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'f' WHEN 2 THEN 'n' ELSE '' END AS g, CASE p_size % 3 WHEN 0 THEN 'l''' WHEN 1 THEN 'la' ELSE '' END AS a FROM part)""")
def q112(spark, d):
    p, k = T.read(spark, d, "part"), F.col("p_size")
    g = F.when(k % 4 == 0, "Masculine").when(k % 4 == 1, "feminine").when(k % 4 == 2, "n").otherwise("")
    a = F.when(k % 3 == 0, "l'").when(k % 3 == 1, "la").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), N.gender_code(g, k % 2 == 0).alias("code"), N.noun_display(F.col("p_name"), a, k > 45).alias("shown"))


@query("q113_unit_tiers", """
SELECT l_orderkey AS unit, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS first_word, min(p_size % 3) AS tier FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def q113(spark, d):
    x = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("w"))
    units = x.select("unit", F.transform("w", lambda v: v["l_partkey"]).alias("words"))
    return N.unit_tiers(units, T.read(spark, d, "part").select(F.col("p_partkey").alias("word"), (F.col("p_size") % 3).alias("ft")))


@query("q114_usable_entries", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber % 2 = 1 GROUP BY 1")
def q114(spark, d):
    gloss = F.when(F.col("l_linenumber") % 2 == 1, "g").otherwise("")
    tags = F.array(F.when(F.col("l_returnflag") == "A", "form-of").otherwise("noun"))
    e = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(gloss.alias("gloss"), tags.alias("tags"))).alias("senses"))
    return N.usable_entries(e).select("id")


@query("q115_stage_gates", "WITH " + _STATE + """
SELECT learner, count(*) < 10 AS new, count(*) > 0 AS review, count(*) FILTER (s >= 3) >= 5 AS listen, count(*) FILTER (item >= 8) > 0 AS script FROM state GROUP BY learner""")
def q115(spark, d):
    st = S.answer_fold(T.answers(spark, d)).groupBy("learner").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 3).alias("k"), F.count_if(F.col("item") >= 8).alias("x"))
    gates = N.stage_gates(F.col("n"), F.col("n") < 10, F.col("k"), F.col("x"))
    return st.select("learner", *[c.alias(n) for n, c in gates.items()])


@query("q116_stable_order", """
SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, p_size % 7 = 0, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END, p_partkey) AS ord FROM part""")
def q116(spark, d):
    k = F.col("p_size")
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("lang"), (k % 4).alias("lv_index"), F.when(k % 7 != 0, k).alias("rank"), F.col("p_partkey").alias("at"))
    return N.stable_order(p).select("id", "ord")


@query("q117_set_counters", "WITH " + _STATE + """
SELECT learner, CAST(greatest(least(learner % 7, 5), floor(count(*) FILTER (s >= 3) / 2)) AS BIGINT) AS sets FROM state GROUP BY learner""")
def q117(spark, d):
    g = S.answer_fold(T.answers(spark, d)).groupBy("learner").agg(F.count_if(F.col("s") >= 3).alias("known"))
    return g.select("learner", N.settled_counter(F.col("learner") % 7, F.col("known"), F.lit(10), 2).alias("sets"))


@query("q118_current_goal", "WITH " + _STATE + """,
p AS (SELECT learner, item // 4 AS goal, count(*) FILTER (s >= 2) / 4 AS x FROM state GROUP BY ALL)
SELECT learner, coalesce(min(goal) FILTER (x + 1e-9 < 0.9), -1) AS goal FROM p GROUP BY learner""")
def q118(spark, d):
    p = S.answer_fold(T.answers(spark, d)).groupBy("learner", F.floor(F.col("item") / 4).alias("goal")).agg((F.count_if(F.col("s") >= 2) / 4).alias("x"))
    return N.current_goal(p)


@query("q119_primary_sense", "SELECT p_name AS lemma, arg_min(p_partkey, (p_size, p_partkey)) AS id FROM part GROUP BY p_name")
def q119(spark, d):
    return N.primary_sense(T.read(spark, d, "part").select(F.col("p_name").alias("lemma"), F.col("p_size").alias("sense"), F.col("p_partkey").alias("id")))


@query("q120_placement_seeds", "WITH " + _STATE + """,
p AS (SELECT user_id AS learner, CAST(i AS INT) AS item FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(12)) AS i) WHERE i < user_id % 13)
SELECT learner, item, r, w, s FROM state UNION ALL SELECT learner, item, 0, 0, 3 FROM p WHERE (learner, item) NOT IN (SELECT (learner, item) FROM state)""")
def q120(spark, d):
    a = T.answers(spark, d)
    p = a.select("learner").distinct().select("learner", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("item")).filter("item < learner % 13")
    return N.seed_records(S.answer_fold(a), p)


@query("q121_weak_charges", "WITH " + _STATE + """,
k AS (SELECT learner, item, CAST(sum(2) AS BIGINT) AS weight FROM answers WHERE kind = 'read' AND value < 3 GROUP BY ALL)
SELECT learner, item, r, CAST(w + coalesce(weight, 0) AS BIGINT) AS w, CASE WHEN weight IS NULL THEN s ELSE 0 END AS s FROM state LEFT JOIN k USING (learner, item)""")
def q121(spark, d):
    a = T.answers(spark, d)
    weak = a.filter("kind = 'read' AND value < 3").select("learner", "item", F.lit(2).alias("weight"))
    return N.charge(S.answer_fold(a), weak)


@query("q122_stale_sessions", """
SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-15 12:00:00') > 43200 OR event_id % 5 = 0 AS stale FROM events""")
def q122(spark, d):
    e = T.read(spark, d, "events").select("event_id", F.date_trunc("second", "ts").alias("saved"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("p1").alias("fingerprint"), F.lit("p1").alias("pack"))
    return N.stale_sessions(e, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id", "stale")


@query("q123_gender_conflicts", """
WITH t AS (SELECT p_name AS lemma, CASE WHEN length(p_name) % 2 = 0 THEN 'm' ELSE 'f' END AS g FROM part GROUP BY 1, 2)
SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'filled' ELSE 'conflict' END AS status FROM part JOIN t ON lemma = p_name WHERE p_size % 5 = 0 OR g <> CASE WHEN p_size % 2 = 0 THEN 'm' ELSE 'f' END""")
def q123(spark, d):
    p, k = T.read(spark, d, "part"), F.col("p_size")
    w = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("lemma"), F.when(k % 5 != 0, F.when(k % 2 == 0, "m").otherwise("f")).alias("gender"))
    table = p.select(F.col("p_name").alias("lemma")).distinct().withColumn("gender", F.when(F.length("lemma") % 2 == 0, "m").otherwise("f"))
    return N.gender_conflicts(w, table)


@query("q124_excerpts", "SELECT doc_id AS story, i AS page FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE contains(t, ' the of')")
def q124(spark, d):
    pages = T.read(spark, d, "documents").select(F.col("doc_id").alias("story"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return N.excerpts(pages, " the of")


@query("q125_reserved_bare", "WITH RECURSIVE " + _PAIRS + """,
x AS (SELECT learner, item, kind = 'type' AS bare, s, session, row_number() OVER (PARTITION BY learner ORDER BY CASE WHEN kind = 'type' THEN 0 ELSE 1 END, s, session, item) AS i FROM pairs WHERE kind IN ('type', 'read'))
SELECT learner, item, bare, s, session, bare AND i <= 3 AS reserved FROM x""")
def q125(spark, d):
    p = S.pair_state(T.answers(spark, d)).filter("kind IN ('type', 'read')")
    return N.bare_first(p.select("learner", "item", (F.col("kind") == "type").alias("bare"), "s", "session"))


@query("q126_day_slices", "WITH " + _STATE + """,
n AS (SELECT learner, max(session) AS sn, max(day) AS today FROM answers GROUP BY learner),
m AS (SELECT learner, item, max(session) AS missed FROM answers WHERE NOT ok GROUP BY ALL),
q AS (SELECT learner, item, count(DISTINCT kind) AS asked, bool_or(ok) AS gone FROM answers JOIN n USING (learner) WHERE day = today GROUP BY ALL),
t AS (SELECT learner, item, CASE WHEN k IS NOT NULL AND sn - missed < 6 THEN 0 WHEN NOT (coalesce(gone, false) OR u >= sn - 2) THEN CASE WHEN s >= 3 THEN 2 ELSE 1 END WHEN coalesce(asked, 0) < 4 THEN 3 ELSE 4 END AS tier
  FROM state JOIN n USING (learner) LEFT JOIN m USING (learner, item) LEFT JOIN q USING (learner, item)),
i AS (SELECT *, row_number() OVER (PARTITION BY learner, tier ORDER BY item) AS i FROM t),
z AS (SELECT *, CASE WHEN tier = 0 AND i <= 3 THEN 0 WHEN tier = 2 AND i <= 1 THEN 1 WHEN tier = 1 THEN 2 ELSE 3 END AS slice FROM i)
SELECT learner, item, tier, row_number() OVER (PARTITION BY learner ORDER BY slice, tier, item) AS place FROM z QUALIFY place <= 5""")
def q126(spark, d):
    a = T.answers(spark, d)
    return N.day_slices(S.day_tiers(S.answer_fold(a), a), 5)


@query("q127_story_twins", """
WITH k AS (SELECT p_partkey AS id, regexp_replace(regexp_replace(lower('The ' || p_name || ' ' || p_type || ' ' || p_brand), '^(the|a|an)\\s+', ''), '[^\\p{L}\\p{N}]', '', 'g') AS k, p_size FROM part)
SELECT a.id, b.id AS twin FROM k a JOIN k b USING (k) WHERE a.p_size % 2 = 0 AND b.p_size % 2 = 1""")
def q127(spark, d):
    p = T.read(spark, d, "part").withColumn("title", F.concat_ws(" ", F.lit("The"), "p_name", "p_type", "p_brand"))
    rows = p.select(F.col("p_partkey").alias("id"), "title", F.upper("title").alias("original"), "p_size")
    return twin_candidates(rows.filter("p_size % 2 = 0"), rows.filter("p_size % 2 = 1"))


@query("q128_script_examples", "WITH " + WORDS + """,
w AS (SELECT token AS word, min(rank) AS rank FROM words WHERE length(token) > 2 GROUP BY token),
l AS (SELECT DISTINCT word, rank, unnest(string_split(word, '')) AS unit FROM w),
t AS (SELECT unit, row_number() OVER (ORDER BY count(*) DESC, unit) AS ord FROM l GROUP BY unit),
x AS (SELECT a.unit, a.word, a.rank, count(*) FILTER (tb.ord > ta.ord) AS unknown FROM l a JOIN t ta ON ta.unit = a.unit JOIN l b ON b.word = a.word JOIN t tb ON tb.unit = b.unit GROUP BY ALL),
y AS (SELECT *, min(unknown) OVER (PARTITION BY unit) AS best FROM x WHERE unknown <= 2)
SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY rank, word) AS place, word, CAST(unknown AS INT) AS unknown FROM y WHERE unknown = best QUALIFY place <= 3""")
def q128(spark, d):
    w = T.words(spark, d).filter("length(token) > 2").groupBy("token").agg(F.min("rank").alias("rank"))
    uses = w.select(F.col("token").alias("word"), "rank", F.explode(F.array_distinct(F.split("token", ""))).alias("unit")).filter("unit <> ''")
    order = T.ranked(uses.groupBy("unit").agg(F.count("*").alias("n")).withColumn("_", F.lit(0)), ["_"], key="unit", name="ord")
    return N.script_examples(uses, order.select("unit", "ord"))


@query("q129_restored_links", "WITH " + TOKENS + """,
l AS (SELECT DISTINCT lang || ':' || token AS word, doc_id * 100000 + sent AS sentence FROM tokens WHERE length(token) > 5),
k AS (SELECT * FROM l WHERE sentence % 3 <> 0), h AS (SELECT word, count(*) AS have FROM k GROUP BY word)
SELECT d.word, d.sentence FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sentence) AS i FROM l WHERE sentence % 3 = 0) d LEFT JOIN h USING (word) WHERE i <= 4 - coalesce(have, 0)""")
def q129(spark, d):
    t = T.tokens(spark, d).filter("length(token) > 5")
    links = t.select(F.concat_ws(":", "lang", "token").alias("word"), (F.col("doc_id") * 100000 + F.col("sent")).alias("sentence")).distinct()
    return N.restored_links(links.filter("sentence % 3 <> 0"), links.filter("sentence % 3 = 0"), 4)


@query("q130_bound_levels")
def q130(spark, d):
    w = T.words(spark, d).filter("rank <= 2000")
    k = F.pmod(F.xxhash64("token"), F.lit(50))
    bounds = w.select("lang", "token", F.when(k == 0, 2).when(k == 1, 1).alias("floor"), F.when(k == 2, 0).alias("ceiling")).filter("floor IS NOT NULL OR ceiling IS NOT NULL")
    return planners.bound_levels(w, bounds, (("A1", 600), ("A2", 700), ("B1", 700)))
