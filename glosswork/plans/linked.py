"""Queries over linking, senses, migration and the choices that follow, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators import corpus as C
from glosswork.operators import linking as L
from glosswork.operators import state as S
from glosswork.plans.learner import _PAIRS, _STATE
from glosswork.sources import tables as T
from glosswork.sources.tables import ANSWERS, TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SID = "(doc_id * 100000 + sent)"


def _sid():
    return (F.col("doc_id") * 100000 + F.col("sent")).alias("sentence")


@query("q86_truecase_apply", "WITH " + TOKENS + """,
tc AS (SELECT lang, token, count(*) FILTER (substr(surface, 1, 1) = substr(token, 1, 1)) AS low, count(*) FILTER (substr(surface, 1, 1) <> substr(token, 1, 1)) AS cap FROM tokens WHERE pos > 0 GROUP BY ALL),
s AS (SELECT *, lower(regexp_extract(text, '^(\\p{L}+)', 1)) AS token FROM sentences)
SELECT s.doc_id, s.sent, CASE WHEN coalesce(low, 0) > coalesce(cap, 0) AND s.token <> '' THEN s.token || substr(text, length(s.token) + 1) ELSE text END AS cased FROM s LEFT JOIN tc ON tc.lang = s.lang AND tc.token = s.token""")
def q86(spark, d):
    counts = C.truecase_counts(T.tokens(spark, d))
    return L.truecase(T.sentences(spark, d), counts).select("doc_id", "sent", "cased")


@query("q87_token_resolution", "WITH " + WORDS + """,
e AS (SELECT token AS lemma, n FROM words WHERE lang = 'en' AND n >= 3), s AS (SELECT token AS surface FROM words WHERE lang = 'en'),
g AS (SELECT surface, substr(surface, 1, length(surface) - 2) AS lemma FROM s WHERE surface LIKE '%ed' UNION ALL SELECT surface, substr(surface, 1, length(surface) - 1) FROM s WHERE surface LIKE '%t'),
c AS (SELECT surface, lemma, n, 0 AS p FROM s JOIN e ON lemma = surface UNION ALL SELECT surface, lemma, n, 1 FROM g JOIN e USING (lemma))
SELECT surface, lemma, CASE p WHEN 0 THEN 'entry' ELSE 'form' END AS how FROM c QUALIFY row_number() OVER (PARTITION BY surface ORDER BY p, n DESC, lemma) = 1""")
def q87(spark, d):
    w = T.words(spark, d).filter("lang = 'en'")
    s = w.select(F.col("token").alias("surface"))
    cut = lambda end, k: s.filter(F.col("surface").endswith(end)).select("surface", F.substring("surface", F.lit(1), F.length("surface") - k).alias("lemma"))
    return L.resolve(s, w.filter("n >= 3").select(F.col("token").alias("lemma"), "n"), cut("ed", 2).unionByName(cut("t", 1)))


@query("q88_sentence_links", "WITH " + WORDS + f""",
k AS (SELECT lang, token, rank FROM words)
SELECT {_SID} AS sentence, count(DISTINCT t.token) FILTER (k.rank <= 300) AS links, coalesce(bool_or(length(t.token) > 3 AND (k.rank IS NULL OR k.rank > 2000)), false) AS outside
FROM tokens t LEFT JOIN k ON k.lang = t.lang AND k.token = t.token GROUP BY 1""")
def q88(spark, d):
    w = T.words(spark, d)
    t = T.tokens(spark, d).select("lang", _sid(), "pos", "token")
    return L.sentence_links(t, w.filter("rank <= 300"), w.filter("rank > 300 AND rank <= 2000"), F.length("token") > 3, ("lang", "token"))


@query("q89_homograph_cues", """
WITH w AS (SELECT p_partkey AS id, p_name || p_brand AS form, list_sort(list_distinct([p_type, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END])) AS cues FROM part)
SELECT x.form, x.id AS a, y.id AS b, len(list_intersect(x.cues, y.cues)) > 0 AS shared FROM w x JOIN w y ON x.form = y.form AND x.id < y.id""")
def q89(spark, d):
    p = T.read(spark, d, "part")
    cues = F.array("p_type", F.when(F.col("p_size") > 25, "big").otherwise("small"))
    return L.homographs(p.select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand").alias("form"), cues.alias("cues")))


@query("q90_level_budget", "WITH " + WORDS + """,
l AS (SELECT lang, token, CASE WHEN rank <= 600 THEN 0 WHEN rank <= 1300 THEN 1 ELSE 2 END AS wl FROM words)
SELECT t.doc_id AS passage, count(DISTINCT t.token) FILTER (wl > t.doc_id % 3) AS above, count(DISTINCT t.token) FILTER (wl > t.doc_id % 3) > 40 AS over FROM tokens t JOIN l ON l.lang = t.lang AND l.token = t.token GROUP BY 1""")
def q90(spark, d):
    r = F.col("rank")
    w = T.words(spark, d).select("lang", F.col("token").alias("word"), F.when(r <= 600, 0).when(r <= 1300, 1).otherwise(2).alias("lv"))
    t = T.tokens(spark, d).select("lang", F.col("doc_id").alias("passage"), (F.col("doc_id") % 3).alias("lv"), F.col("token").alias("word"))
    return L.level_budget(t, w, 40, ("lang", "word"))


@query("q91_legacy_migration", """
WITH r AS (SELECT p_name || '|' || p_type AS key, sum(p_size) AS n FROM part GROUP BY 1), m AS (SELECT DISTINCT p_name || '|' || p_type AS key, CAST(length(p_name) + length(p_type) * 3 AS BIGINT) AS id FROM part WHERE p_type <> 'ECONOMY'),
x AS (SELECT r.key, n, id FROM r LEFT JOIN m USING (key))
SELECT coalesce(id, -1) AS id, key, CASE WHEN id IS NULL THEN 'unmapped' WHEN row_number() OVER (PARTITION BY id ORDER BY n DESC, key) = 1 THEN 'moved' ELSE 'duplicate' END AS status FROM x""")
def q91(spark, d):
    p = T.read(spark, d, "part").withColumn("key", F.concat("p_name", F.lit("|"), "p_type"))
    keymap = p.filter("p_type <> 'ECONOMY'").select("key", (F.length("p_name") + F.length("p_type") * 3).cast("long").alias("id")).distinct()
    return L.migrate(p.groupBy("key").agg(F.sum("p_size").alias("n")), keymap)


@query("q92_page_shift", """
WITH a AS (SELECT doc_id % 50 AS story, doc_id // 50 AS n, n_chars AS la FROM documents),
b AS (SELECT story, n + CASE story % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 1 ELSE 0 END AS m, la + story AS lb FROM a WHERE story % 4 <> 2 OR n > 0),
ca AS (SELECT story, count(*) AS na, min(n) AS ma FROM a GROUP BY story), cb AS (SELECT story, count(*) AS nb, min(m) AS mb FROM b GROUP BY story),
me AS (SELECT a.story, count(*) AS met FROM a JOIN ca USING (story) JOIN cb USING (story) JOIN b ON b.story = a.story AND m = n + mb - ma GROUP BY 1),
na AS (SELECT story, CASE WHEN na = nb AND met = na THEN mb - ma ELSE 0 END AS usual FROM ca LEFT JOIN cb USING (story) LEFT JOIN me USING (story)),
sh AS (SELECT story, usual, usual AS shift FROM na UNION SELECT story, usual, unnest(range(-3, 4)) FROM na),
g AS (SELECT a.story, usual, shift, count(*) AS pages, round(stddev_pop(ln((la + 12) / (lb + 12))), 9) AS misfit FROM sh JOIN a USING (story) JOIN b ON b.story = a.story AND m = n + shift GROUP BY ALL HAVING count(*) >= 3),
be AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY story ORDER BY misfit, shift <> usual, abs(shift), shift) = 1),
x AS (SELECT na.story, na.usual, be.shift AS bs, be.pages AS bp, be.misfit AS bm, o.pages AS op, o.misfit AS om, coalesce(be.misfit < 0.6::DOUBLE * o.misfit AND o.misfit > 0.2::DOUBLE, false) AS wins
  FROM na LEFT JOIN be USING (story) LEFT JOIN g o ON o.story = na.story AND o.shift = na.usual)
SELECT story, CASE WHEN wins THEN bs ELSE usual END AS shift, usual, coalesce(CASE WHEN wins THEN bp ELSE op END, 0) AS pages, coalesce(CASE WHEN wins THEN bm ELSE om END, -1.0::DOUBLE) AS misfit FROM x""")
def q92(spark, d):
    a = T.read(spark, d, "documents").select((F.col("doc_id") % 50).alias("story"), F.floor(F.col("doc_id") / 50).alias("n"), F.col("n_chars").alias("len"))
    k = F.col("story") % 4
    b = a.filter((k != 2) | (F.col("n") > 0)).select("story", (F.col("n") + F.when(k == 0, 2).when(k == 1, 7).when(k == 2, 1).otherwise(0)).alias("n"), (F.col("len") + F.col("story")).alias("len"))
    return L.page_shift(a, b)


@query("q93_nearest_placed_curve", """
WITH c AS (SELECT c_nationkey % 5 AS g, CAST(floor(c_acctbal) AS BIGINT) * 40 AS since, max(c_name) AS curve FROM customer GROUP BY ALL),
o AS (SELECT o_orderkey AS id, o_custkey % 5 AS grp, CAST(floor(o_totalprice) AS BIGINT) AS "at" FROM orders)
SELECT id, grp, "at", coalesce(curve, '') AS curve FROM o ASOF LEFT JOIN c ON g = grp AND "at" >= since""")
def q93(spark, d):
    c = T.read(spark, d, "customer")
    curves = c.groupBy((F.col("c_nationkey") % 5).cast("long").alias("grp"), (F.floor("c_acctbal") * 40).alias("since")).agg(F.max("c_name").alias("curve"))
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("grp"), F.floor("o_totalprice").alias("at"))
    return L.as_of(o, curves)


_SENSES = """se AS (SELECT l_orderkey AS id, p_type || ' ' || p_name AS sense, max(l_quantity) AS score, list_sort(list_distinct([p_type, p_name])) AS stems FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_type, p_name)"""


@query("q94_compose_gloss", "WITH " + _SENSES + """,
i AS (SELECT *, row_number() OVER w AS i, first_value(sense) OVER w AS ts, first_value(score) OVER w AS tc, first_value(stems) OVER w AS tt FROM se WINDOW w AS (PARTITION BY id ORDER BY score DESC, sense)),
b AS (SELECT id, ts, tt, min(CASE WHEN i > 1 AND score >= 0.5 * tc THEN i END) AS k FROM i GROUP BY ALL)
SELECT b.id, CASE WHEN k IS NOT NULL AND len(list_intersect(b.tt, x.stems)) = 0 AND length(b.ts || '; ' || x.sense) <= 30 THEN b.ts || '; ' || x.sense ELSE b.ts END AS gloss FROM b LEFT JOIN i x ON x.id = b.id AND x.i = b.k""")
def q94(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    x = T.read(spark, d, "lineitem").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("id"), "p_type", "p_name").agg(F.max("l_quantity").alias("score"))
    return L.compose_gloss(x.select("id", F.concat_ws(" ", "p_type", "p_name").alias("sense"), "score", F.array("p_type", "p_name").alias("stems")), 30)


@query("q95_phrase_share", "WITH " + TOKENS + f""",
bi AS (SELECT a.lang, a.token AS head, a.token || ' ' || b.token AS phrase FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.sent = b.sent AND b.pos = a.pos + 1 GROUP BY 1, 2, 3 HAVING count(*) >= 40),
s AS (SELECT {_SID} AS sentence, lower(text) AS text FROM sentences), k AS (SELECT DISTINCT lang, {_SID} AS sentence, token FROM tokens)
SELECT lang, phrase, count(*) AS n, count(*) FILTER (contains(' ' || text || ' ', ' ' || phrase || ' ')) AS bound, round(count(*) FILTER (contains(' ' || text || ' ', ' ' || phrase || ' ')) / count(*), 6) AS share
FROM bi JOIN k USING (lang) JOIN s USING (sentence) WHERE k.token = head GROUP BY lang, phrase""")
def q95(spark, d):
    t = T.following(spark, d, 2).filter("n1 IS NOT NULL")
    bi = t.groupBy("lang", F.col("token").alias("head"), F.concat_ws(" ", "token", "n1").alias("phrase")).agg(F.count("*").alias("n")).filter("n >= 40")
    return L.phrase_share(T.bagged(spark, d).select("lang", F.lower("text").alias("text"), "toks"), bi, ("lang",))


@query("q96_flat_placement", "WITH " + ANSWERS + """,
b AS (SELECT learner, item // 4 AS bucket, count(*) FILTER (ok) AS r, count(*) AS n FROM answers GROUP BY ALL), p AS (SELECT *, 100.0::DOUBLE * r / n AS pct FROM b)
SELECT learner, max(pct) - min(pct) <= 15 AS flat, CASE WHEN max(pct) - min(pct) <= 15 THEN round(100.0::DOUBLE * sum(r) / sum(n), 6) ELSE -1.0 END AS pct FROM p GROUP BY learner""")
def q96(spark, d):
    b = T.answers(spark, d).groupBy("learner", F.floor(F.col("item") / 4).alias("bucket")).agg(F.count_if("ok").alias("right"), F.count("*").alias("asked"))
    return L.flat_profile(b.withColumn("pct", 100.0 * F.col("right") / F.col("asked")))


@query("q97_story_drop_reasons", "WITH " + TOKENS + """,
nm AS (SELECT doc_id, list(DISTINCT surface) AS names FROM tokens WHERE pos > 0 AND regexp_full_match(surface, '[A-Z][a-z]+') GROUP BY doc_id),
n AS (SELECT doc_id, sent, text || '.' AS target, lead(text || '.') OVER (PARTITION BY doc_id ORDER BY sent) AS english FROM sentences),
w AS (SELECT n.*, names, regexp_extract_all(lower(target), '\\p{L}+') AS t, regexp_extract_all(english, '[A-Za-z'']+') AS e, regexp_extract_all(lower(english), '[a-z'']+') AS el FROM n LEFT JOIN nm USING (doc_id) WHERE english IS NOT NULL),
r AS (SELECT doc_id, sent, target, CASE WHEN (length(target) + 6) / (length(english) + 6) NOT BETWEEN 0.7 AND 1.4 THEN 'pair_alignment' WHEN NOT regexp_matches(target, '[.!?]$') THEN 'not_terminated' WHEN regexp_matches(target, '[|#$%&*<>]') THEN 'foreign_chars'
  WHEN len(list_filter(t, lambda x: length(x) > 20)) > 0 THEN 'glued_words' WHEN len(t) NOT BETWEEN 3 AND 14 OR len(string_split(english, ' ')) > 42 THEN 'token_count'
  WHEN (len(t) >= 2 AND len(list_distinct(t)) <= greatest(1, len(t) // 3)) OR (len(e) >= 3 AND len(list_distinct(el)) = 1) THEN 'onomatopoeia' WHEN t[1] IN ('and', 'und', 'et', 'y') THEN 'opener'
  WHEN len(t) > 10 AND list_has_any(t, ['that', 'die', 'que', 'qui']) THEN 'complex_clause'
  WHEN len(regexp_extract_all(target, '"')) % 2 = 1 OR len(regexp_extract_all(english, '"')) % 2 = 1 OR len(regexp_extract_all(target, '\\(')) <> len(regexp_extract_all(target, '\\)')) OR len(regexp_extract_all(english, '\\(')) <> len(regexp_extract_all(english, '\\)')) THEN 'quotation_fragment'
  WHEN regexp_full_match(english, '[A-Z][a-z]+[.!?]') THEN 'names_only' WHEN coalesce(list_has_any(e, names), false) THEN 'story_name' WHEN regexp_matches(english, '(?i)the end|once upon') THEN 'meta_line' ELSE '' END AS reason FROM w),
d AS (SELECT CASE WHEN reason = '' AND row_number() OVER (PARTITION BY reason, regexp_replace(lower(target), '\\s+', ' ', 'g') ORDER BY doc_id, sent) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r)
SELECT reason, count(*) AS n FROM d GROUP BY reason""")
def q97(spark, d):
    s = T.sentences(spark, d)
    names = T.tokens(spark, d).filter((F.col("pos") > 0) & F.col("surface").rlike("^[A-Z][a-z]+$")).groupBy("doc_id").agg(F.collect_set("surface").alias("names"))
    x = s.select("doc_id", "sent", F.concat("text", F.lit(".")).alias("target"), F.lead(F.concat("text", F.lit("."))).over(W.partitionBy("doc_id").orderBy("sent")).alias("english"))
    x = x.filter("english IS NOT NULL").join(names, "doc_id", "left")
    got = L.story_drops(x, ["doc_id", "sent"], openers=("and", "und", "et", "y"), relative=("that", "die", "que", "qui"), meta="(?i)the end|once upon")
    return got.groupBy("reason").agg(F.count("*").alias("n"))


@query("q98_cloze_candidates", "WITH " + WORDS + f""",
t AS (SELECT lang, {_SID} AS sentence, token, pos FROM tokens), c AS (SELECT sentence, count(*) AS n FROM t GROUP BY sentence)
SELECT sentence, token, min(pos) AS pos FROM t JOIN c USING (sentence) ANTI JOIN (SELECT lang, token FROM words WHERE rank <= 50) f ON f.lang = t.lang AND f.token = t.token WHERE n > 1 GROUP BY sentence, token HAVING count(*) = 1""")
def q98(spark, d):
    return L.cloze(T.bagged(spark, d).select("lang", _sid(), "toks"), T.words(spark, d).filter("rank <= 50"), ("lang",))


@query("q99_surface_occurrences", "WITH " + TOKENS + f"""
SELECT {_SID} AS id, token AS surface, count(*) AS n FROM tokens GROUP BY 1, 2""")
def q99(spark, d):
    x = T.bagged(spark, d).select(_sid().alias("id"), F.lower("text").alias("text"), "toks")
    return L.occurrences(x).select("id", "surface", F.col("n").cast("long").alias("n"))


@query("q100_word_pool", "WITH " + WORDS + """,
f AS (SELECT token AS lemma, min(rank) AS first FROM words GROUP BY token ORDER BY first, lemma LIMIT 500) SELECT w.token AS lemma, w.lang AS pos, w.rank FROM words w SEMI JOIN f ON f.lemma = w.token""")
def q100(spark, d):
    return L.pool(T.words(spark, d).select(F.col("token").alias("lemma"), F.col("lang").alias("pos"), "rank"), 500)


@query("q101_keep_live", """
WITH p AS (SELECT p_partkey AS id, p_name || p_type AS text FROM part WHERE p_partkey % 3 = 0), l AS (SELECT p_partkey AS id, p_name || p_type AS text FROM part WHERE p_partkey % 3 = 1)
SELECT id, text FROM p UNION ALL SELECT min(id), text FROM l WHERE text NOT IN (SELECT text FROM p) GROUP BY text""")
def q101(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_type").alias("text"))
    return L.keep_live(p.filter("id % 3 = 0"), p.filter("id % 3 = 1"))


@query("q102_next_stage", "WITH " + ANSWERS + """,
st AS (SELECT k AS step, t AS track, CASE t WHEN 'words' THEN 0 ELSE 1 END AS ord FROM (SELECT unnest(range(6)) AS k), (SELECT unnest(['words', 'signs']) AS t)),
dn AS (SELECT DISTINCT learner, CASE WHEN item % 2 = 0 THEN 'words' ELSE 'signs' END AS track, item // 2 AS step FROM answers WHERE ok AND session <= 4)
SELECT learner, track, CAST(step AS INT) AS step FROM (SELECT DISTINCT learner FROM dn) q CROSS JOIN st WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.learner = q.learner AND dn.track = st.track AND dn.step = st.step)
QUALIFY row_number() OVER (PARTITION BY learner ORDER BY step, ord) = 1""")
def q102(spark, d):
    rows = [(k, t, o) for k in range(6) for o, t in enumerate(("words", "signs"))]
    stages = spark.createDataFrame(rows, "step int, track string, ord int")
    item = F.col("item")
    done = T.answers(spark, d).filter("ok AND session <= 4").select("learner", F.when(item % 2 == 0, "words").otherwise("signs").alias("track"), F.floor(item / 2).cast("int").alias("step")).distinct()
    return L.interleaved(stages, done)


@query("q103_exam_misses", "WITH " + _STATE + """,
x AS (SELECT a.learner, a.session % 3 AS exam, a.session AS sentence, a.item, coalesce(s.s, 0) AS s FROM (SELECT DISTINCT learner, session, item FROM answers WHERE NOT ok) a LEFT JOIN state s ON s.learner = a.learner AND s.item = a.item),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY learner, exam, sentence ORDER BY s, item) <= 2),
z AS (SELECT learner, exam, item, min(s) AS s FROM y GROUP BY ALL)
SELECT learner, exam, item FROM z QUALIFY row_number() OVER (PARTITION BY learner, exam ORDER BY s, item) <= 6""")
def q103(spark, d):
    a = T.answers(spark, d)
    missed = a.filter("NOT ok").select("learner", (F.col("session") % 3).alias("exam"), F.col("session").alias("sentence"), "item").distinct()
    return L.exam_misses(missed, S.answer_fold(a))


@query("q104_next_passage", "WITH " + ANSWERS + """,
p AS (SELECT learner, item AS passage, count(*) AS times FROM answers WHERE kind = 'read' GROUP BY ALL)
SELECT learner, passage FROM p QUALIFY row_number() OVER (PARTITION BY learner ORDER BY times, md5(concat_ws(':', 'n1', learner, passage))) = 1""")
def q104(spark, d):
    p = T.answers(spark, d).filter("kind = 'read'").groupBy("learner", F.col("item").alias("passage")).agg(F.count("*").alias("times"))
    return L.next_passage(p, "n1")


@query("q105_provisional_reserve", "WITH RECURSIVE " + _PAIRS + """
SELECT learner, item, kind FROM pairs WHERE s = 1 QUALIFY row_number() OVER (PARTITION BY learner ORDER BY md5(concat_ws(':', 'p1', learner, item, kind))) <= 5""")
def q105(spark, d):
    h = F.md5(F.concat_ws(":", F.lit("p1"), F.col("learner").cast("string"), F.col("item").cast("string"), "kind"))
    x = S.pair_state(T.answers(spark, d)).filter("s = 1").withColumn("i", F.row_number().over(W.partitionBy("learner").orderBy(h)))
    return x.filter("i <= 5").select("learner", "item", "kind")


@query("q106_totals_and_deltas", "WITH " + ANSWERS + """,
g AS (SELECT learner, session, count(*) AS n, count(*) FILTER (ok) AS r FROM answers GROUP BY ALL),
t AS (SELECT learner, session, sum(n) OVER w AS answered, sum(r) OVER w AS correct FROM g WINDOW w AS (PARTITION BY learner ORDER BY session))
SELECT learner, session, CAST(answered AS BIGINT) AS answered, CAST(correct AS BIGINT) AS correct, CAST(answered - coalesce(lag(answered) OVER w, 0) AS BIGINT) AS more_answered, CAST(correct - coalesce(lag(correct) OVER w, 0) AS BIGINT) AS more_correct FROM t WINDOW w AS (PARTITION BY learner ORDER BY session)""")
def q106(spark, d):
    g = T.answers(spark, d).groupBy("learner", "session").agg(F.count("*").alias("n"), F.count_if("ok").alias("r"))
    w = W.partitionBy("learner").orderBy("session")
    t = g.withColumns({"answered": F.sum("n").over(w), "correct": F.sum("r").over(w)})
    more = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(f"more_{c}")
    return t.select("learner", "session", "answered", "correct", more("answered"), more("correct"))
