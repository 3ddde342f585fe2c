"""Queries whose operators work row by row or group by group outside SQL; those that SQL can say have it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.functions import folding as D
from glosswork.functions import spans
from glosswork.functions import text as X
from glosswork.operators import alignment, corpus, planners, sessions, state
from glosswork.operators import relations as R
from glosswork.operators.settle import numbered, settled
from glosswork.plans.learner import _PAIRS
from glosswork.sources import tables as T
from glosswork.sources.tables import WORDS
from glosswork.sources.html import html_text
from glosswork.streaming import answers as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q48_html_text")
def q48(spark, d):
    return html_text(T.read(spark, d, "pages"))


@query("q49_sentence_align")
def q49(spark, d):
    """Each document's lines against those of the next document of its source, as a page and its translation."""
    docs = T.read(spark, d, "documents")
    ranks = numbered(docs.select("source", "doc_id"), ["source"], [F.col("doc_id")])
    # Texts meet by their ids; no order is made of them.
    after = ranks.select("source", (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("next"))
    lines = docs.select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("us"))
    pairs = ranks.join(after, ["source", "rank"]).select("source", "doc_id", "next")
    pages = pairs.join(lines, "doc_id").join(lines.select(F.col("doc_id").alias("next"), F.col("us").alias("es")), "next").drop("next")
    spark.udtf.register("aligned_sentences", alignment.Aligned)
    return spark.sql("SELECT p.doc_id, a.* FROM {pages} p, LATERAL aligned_sentences(p.us, p.es) a", pages=pages)


@query("q50_accent_fold", "SELECT DISTINCT token, lower(strip_accents(token)) AS fold FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents)")
def q50(spark, d):
    t = T.tokens(spark, d).select("token").distinct()
    return t.select("token", D.column(lambda s: D.normalize_typed(s, accents=True))(F.col("token")).alias("fold"))


#: Words of a pack of each language, the list that gets examples.
LISTED = 6500


@query("q51_example_selection_exact")
def q51(spark, d):
    words = T.words(spark, d)
    # Sentences are written with their words, as the choice reads the candidates three times.
    return planners.examples_exact(corpus.candidates(settled(corpus.fitting(words, T.bagged(spark, d))), words.filter(F.col("rank") <= LISTED)))


@query("q52_pair_plan_exact", "WITH RECURSIVE " + _PAIRS + """,
px AS (SELECT learner, item, min(CASE WHEN s < 3 THEN (s, CASE WHEN kind = 'type' THEN 0 ELSE 1 END, session, item, kind) END) AS low, min(CASE WHEN s >= 3 THEN (session, item, kind) END) AS high FROM pairs GROUP BY ALL),
pn AS (SELECT learner, count(low) AS nl, least(1, count(high)) AS kept FROM px GROUP BY learner),
pa AS (SELECT px.*, least(nl, 8 - kept) AS first, row_number() OVER (PARTITION BY learner, low IS NULL ORDER BY low) AS i FROM px JOIN pn USING (learner)),
pb AS (SELECT *, low IS NOT NULL AND i <= first AS one FROM pa), pc AS (SELECT *, row_number() OVER (PARTITION BY learner, NOT one AND high IS NOT NULL ORDER BY high) AS j FROM pb),
pe AS (SELECT *, NOT one AND high IS NOT NULL AND j <= 8 - first AS two FROM pc), pf AS (SELECT *, count(*) FILTER (two) OVER (PARTITION BY learner) AS second, row_number() OVER (PARTITION BY learner, one OR two OR low IS NULL ORDER BY low) AS k FROM pe),
pg AS (SELECT learner, item, CASE WHEN one THEN i WHEN two THEN first + j WHEN low IS NOT NULL THEN first + second + k END AS place, CASE WHEN two THEN high[3] ELSE low[5] END AS kind FROM pf)
SELECT learner, CAST(place AS INT) AS place, CAST(item AS INT) AS item, kind FROM pg WHERE place <= 8""")
def q52(spark, d):
    return planners.pair_plan(state.pair_state(T.answers(spark, d)))


@query("q53_gloss_collision", """
WITH RECURSIVE o AS (SELECT p_type AS pos, p_partkey AS id, p_name || ' ' || split_part(p_type, ' ', 1) AS a, p_name || ' ' || p_brand AS b, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part),
f AS (SELECT pos, i, id, a AS gloss, false AS promoted, [a] AS taken FROM o WHERE i = 1
  UNION ALL SELECT pos, i, id, g, g <> a, list_append(taken, g) FROM (SELECT o.*, taken, CASE WHEN NOT list_contains(taken, a) THEN a WHEN NOT list_contains(taken, b) THEN b ELSE a END AS g FROM f JOIN o ON o.pos = f.pos AND o.i = f.i + 1))
SELECT pos, id, gloss, promoted FROM f""")
def q53(spark, d):
    p = T.read(spark, d, "part")
    gloss = [F.struct(F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1)).alias("gloss"), F.lit(1.0).alias("support")), F.struct(F.concat_ws(" ", "p_name", "p_brand").alias("gloss"), F.lit(0.8).alias("support"))]
    senses = p.select(F.col("p_type").alias("pos"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("rank"), F.explode(F.array(*gloss)).alias("g")).select("pos", "id", "rank", "g.*")
    return planners.gloss_collision(senses)


@query("q61_utf16_and_units", """
SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INT) AS units, CAST(len(regexp_extract_all(text, '\\p{L}+')) AS INT) AS words,
  CAST(len(regexp_extract_all(text, '\\p{L}')) AS INT) AS letters FROM documents""")
def q61(spark, d):
    t = T.read(spark, d, "documents")
    return t.select("doc_id", X.utf16_length(F.col("text")).alias("units"), X.passage_units(F.col("text")).alias("words"), X.passage_units(F.col("text"), True).alias("letters"))


@query("q62_german_ascii", "SELECT DISTINCT token, replace(replace(replace(replace(token, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS ascii FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents WHERE lang = 'de')")
def q62(spark, d):
    return T.tokens(spark, d).filter("lang = 'de'").select("token").distinct().select("token", X.german_ascii(F.col("token")).alias("ascii"))


@query("q63_gloss_audit", """
WITH g AS (SELECT p_partkey AS id, p_type || '; ' || p_name || ' (' || p_brand || '), ' || CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' and many more of these parts' ELSE p_name END || CASE WHEN p_partkey % 7 = 0 THEN '...' ELSE '' END AS g FROM part)
SELECT id, CASE WHEN regexp_matches(g, '\\.\\.\\.$') THEN 'truncated' WHEN length(g) > 45 THEN 'long' ELSE '' END AS fault,
  trim(regexp_replace(regexp_replace(g, '\\([^()]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM g""")
def q63(spark, d):
    p = T.read(spark, d, "part")
    k = F.col("p_partkey")
    g = F.concat("p_type", F.lit("; "), "p_name", F.lit(" ("), "p_brand", F.lit("), "), F.when(k % 5 == 0, F.concat("p_brand", F.lit(" and many more of these parts"))).otherwise(F.col("p_name")), F.when(k % 7 == 0, "...").otherwise(""))
    x = p.select(k.alias("id"), g.alias("g"))
    return x.select("id", F.coalesce(X.gloss_fault(F.col("g")), F.lit("")).alias("fault"), X.strip_parens(F.col("g")).alias("bare"))


@query("q64_fnv_hash", """
SELECT p_partkey AS id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, u: (xor(h, u) * 16777619) % 4294967296) AS h FROM part""")
def q64(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.fnv1a(F.col("p_name")).alias("h"))


@query("q107_day_log")
def q107(spark, d):
    return sessions.day_log(T.answers(spark, d))


@query("q108_learner_simulation")
def q108(spark, d):
    runs = spark.range(20).select(F.col("id").alias("seed"))
    return sessions.simulate(runs)


@query("q109_feminine_fold", "WITH RECURSIVE " + WORDS + """,
w AS (SELECT list(struct_pack(lemma := token, masculine := CASE WHEN token LIKE '%e' THEN left(token, length(token) - 1) END, rank := rank) ORDER BY rank, token) AS w FROM words WHERE lang = 'fr'),
f AS (SELECT CAST([] AS VARCHAR[]) AS folded, CAST(['-'] AS VARCHAR[]) AS more
  UNION ALL SELECT list_concat(folded, more), more FROM (SELECT folded, list_transform(list_filter(c, lambda x: list_contains(list_transform(c, lambda y: y.lemma), x.masculine)), lambda x: x.lemma) AS more
    FROM (SELECT folded, list_filter(w, lambda x: NOT list_contains(folded, x.lemma))[1:1000] AS c FROM f, w WHERE len(more) > 0))),
g AS (SELECT folded FROM f ORDER BY len(folded) DESC LIMIT 1)
SELECT x.lemma, x.rank FROM (SELECT unnest(list_filter(w, lambda x: NOT list_contains(folded, x.lemma))[1:1000]) AS x FROM g, w)""")
def q109(spark, d):
    w = T.words(spark, d).filter("lang = 'fr'").select(F.col("token").alias("lemma"), "rank")  # a rule of French
    return planners.feminine_fold(w.withColumn("masculine", F.when(F.col("lemma").endswith("e"), F.substring("lemma", F.lit(1), F.length("lemma") - 1))), 1000)


@query("q110_second_readings", """
WITH RECURSIVE e AS (SELECT p_name AS lemma, p_type AS pos, count(*) AS n, list(DISTINCT p_brand) AS w FROM part GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, pos) AS i, max(n) OVER (PARTITION BY lemma) AS top FROM e),
f AS (SELECT lemma, i, pos, true AS kept, [w] AS seen FROM o WHERE i = 1
  UNION ALL SELECT lemma, i, pos, ok, CASE WHEN ok THEN list_append(seen, w) ELSE seen END FROM (SELECT o.*, seen, n >= 0.2 * top AND len(list_filter(seen, lambda g: len(list_intersect(w, g)) > 0.25 * greatest(1, least(len(w), len(g))))) = 0 AS ok FROM f JOIN o ON o.lemma = f.lemma AND o.i = f.i + 1))
SELECT lemma, pos, i = 1 AS main FROM f WHERE kept""")
def q110(spark, d):
    p = T.read(spark, d, "part")
    e = p.groupBy(F.col("p_name").alias("lemma"), F.col("p_type").alias("pos")).agg(F.count("*").alias("n"), F.collect_set("p_brand").alias("gloss"))
    return planners.second_readings(e)


@query("q111_token_spans")
def q111(spark, d):
    s = T.sentences(spark, d).select("doc_id", "sent", "text", T.words_of(F.col("text")).alias("toks"))
    return s.select("doc_id", "sent", spans.token_places()("text", "toks").alias("spans"))


@query("s01_stream_answer_fold", None)
def s01(spark, d):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    events = T.read(spark, d, "events")
    return stream.run_available(spark, f"{d}/events.parquet", events.schema, f"{shared}/stream-{uuid.uuid4().hex}")
