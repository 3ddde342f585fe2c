"""Queries over glosses, folds, corpus lines, gates and placements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosswork.functions import folding as D
from glosswork.functions import glosses as G
from glosswork.operators import corpus as C
from glosswork.operators import planners as P
from glosswork.operators import rules as U
from glosswork.operators import sessions as S
from glosswork.operators.settle import settled
from glosswork.plans.build import word_rules
from glosswork.sources import readers
from glosswork.sources import tables as T
from glosswork.sources.tables import ANSWERS, SENTENCES, TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q133_attested_stems", "WITH " + WORDS + """,
w AS (SELECT token AS word, length(token) AS k FROM words WHERE lang = 'en'), v AS (SELECT token FROM words WHERE lang = 'en' AND n >= 3),
b AS (SELECT word, CASE WHEN regexp_full_match(word, '.{2,}ies') THEN 1 WHEN regexp_full_match(word, '.{2,}es') THEN 2 WHEN regexp_full_match(word, '.{2,}[^s]s') THEN 3
  WHEN regexp_full_match(word, '.{3,}ing') THEN 4 WHEN regexp_full_match(word, '.{3,}ed') THEN 5 ELSE 0 END AS rule, k FROM w),
c AS (SELECT word, rule, CASE rule WHEN 1 THEN left(word, k - 3) WHEN 2 THEN left(word, k - 2) WHEN 3 THEN left(word, k - 1) WHEN 4 THEN left(word, k - 3) ELSE left(word, k - 2) END AS s FROM b WHERE rule > 0),
f AS (SELECT word, CASE rule WHEN 1 THEN [s || 'y'] WHEN 2 THEN [s, s || 'e'] WHEN 3 THEN [s]
  ELSE [s || 'e', s, CASE WHEN length(s) > 2 AND right(s, 1) = substr(s, length(s) - 1, 1) THEN left(s, length(s) - 1) END, CASE WHEN rule = 5 AND s LIKE '%i' THEN left(s, length(s) - 1) || 'y' END] END AS l FROM c),
t AS (SELECT word, unnest(l) AS base, unnest(range(len(l))) AS i FROM f), h AS (SELECT word, arg_min(base, i) AS base FROM t JOIN v ON v.token = base GROUP BY word)
SELECT w.word, coalesce(base, w.word) AS stem FROM w LEFT JOIN h USING (word)""")
def q133(spark, d):
    """A rule of English."""
    w = T.words(spark, d).filter("lang = 'en'").select(F.col("token").alias("word"), "n")
    return G.stems(w, w.filter("n >= 3"))


_GLOSS = """g AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'to be ' || lower(split_part(p_name, ' ', 1)) WHEN 1 THEN 'to feel ' || CASE WHEN p_size % 2 = 0 THEN 'about' ELSE lower(p_brand) END
  WHEN 2 THEN p_name || ' (x or y) or ' || p_type WHEN 3 THEN '(' || p_name || ' or b) c or ' || split_part(p_type, ' ', 1) || ' (d e)' ELSE p_type END AS g FROM part)"""


def _gloss(spark, d):
    k, first = F.col("p_partkey"), lambda c: F.substring_index(c, " ", 1)
    g = (
        F.when(k % 5 == 0, F.concat(F.lit("to be "), F.lower(first("p_name"))))
        .when(k % 5 == 1, F.concat(F.lit("to feel "), F.when(F.col("p_size") % 2 == 0, "about").otherwise(F.lower("p_brand"))))
        .when(k % 5 == 2, F.concat("p_name", F.lit(" (x or y) or "), "p_type"))
        .when(k % 5 == 3, F.concat(F.lit("("), "p_name", F.lit(" or b) c or "), first("p_type"), F.lit(" (d e)")))
        .otherwise(F.col("p_type"))
    )
    return T.read(spark, d, "part").select(k.alias("id"), g.alias("g"))


@query("q134_gloss_sides", "WITH " + _GLOSS + """,
q AS (SELECT id, g, regexp_extract_all(lower(g), '[a-z''-]+') AS w, string_split(g, ' or ') AS c FROM g),
k AS (SELECT *, list_filter(range(1, len(c)), lambda k: len(regexp_extract_all(array_to_string(c[1:k], ' or '), '[(\\[]')) = len(regexp_extract_all(array_to_string(c[1:k], ' or '), '[)\\]]')))[1] AS k FROM q),
r AS (SELECT *, trim(regexp_replace(array_to_string(c[k + 1:], ' or '), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g')) AS rest FROM k)
SELECT id, CASE WHEN len(w) = 3 AND w[1] = 'to' AND w[2] IN ('be', 'feel') AND w[3] NOT IN ('about') THEN w[3] ELSE '' END AS quality,
  CASE WHEN k IS NOT NULL AND rest <> '' AND NOT regexp_matches(rest, '\\s') THEN array_to_string(c[1:k], ' or ') ELSE '' END AS before FROM r""")
def q134(spark, d):
    g = F.col("g")
    return _gloss(spark, d).select("id", G.quality_of(g).alias("quality"), G.before_or(g).alias("before"))


@query("q135_english_sentences", """
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]{0,40}>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, regexp_replace(t, '(^|[ "''(])(Mr|Mrs|Ms|Dr|St|etc|e\\.g|i\\.e)\\.', '\\1\\2' || chr(1), 'g') AS t FROM t),
s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]["'']{0,3}) (["'']?[A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS l FROM h),
x AS (SELECT doc_id, list_filter(list_transform(l, lambda v: trim(replace(v, chr(1), '.'))), lambda v: v <> '') AS l FROM s)
SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS sentence FROM x""")
def q135(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.posexplode(G.sentences_of(F.col("text"))).alias("k", "sentence"))


@query("q136_affix_alternatives", """
WITH e AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '-' || p_name || '/' || p_type || '(' || p_brand || ')' WHEN 1 THEN p_name || '(' || p_brand || ')-' ELSE p_name END AS e FROM part),
b AS (SELECT id, e, regexp_replace(regexp_replace(e, '^-+', ''), '-+$', '') AS b FROM e),
s AS (SELECT id, e, b, CASE WHEN contains(b, '/') THEN [b, split_part(b, '/', 1), split_part(b, '/', 2)] ELSE [b] END AS s FROM b)
SELECT id, CASE WHEN b = e THEN '' ELSE array_to_string(s || flatten(list_transform(s, lambda x: CASE WHEN regexp_full_match(x, '.*\\([^()]*\\).*')
  THEN [regexp_replace(x, '^(.*)\\(([^()]*)\\)(.*)$', '\\1\\2\\3'), regexp_replace(x, '^(.*)\\(([^()]*)\\)(.*)$', '\\1\\3')] ELSE [] END)), '|') END AS ways FROM s""")
def q136(spark, d):
    k = F.col("p_partkey")
    tail = F.concat(F.lit("("), "p_brand", F.lit(")"))
    e = F.when(k % 3 == 0, F.concat(F.lit("-"), "p_name", F.lit("/"), "p_type", tail)).when(k % 3 == 1, F.concat("p_name", tail, F.lit("-"))).otherwise(F.col("p_name"))
    return T.read(spark, d, "part").select(k.alias("id"), F.array_join(G.affix_alternatives(e), "|").alias("ways"))


@query("q137_search_fold", "WITH " + TOKENS + "SELECT DISTINCT token, lower(strip_accents(replace(token, 'ñ', 'nn'))) AS fold FROM tokens")
def q137(spark, d):
    """Doubled by a hyphen, a word folds as it does alone."""
    t = T.tokens(spark, d).select("token").distinct()
    return t.select("token", D.column(D.search_fold)(F.concat_ws("-", "token", "token")).alias("fold"))


@query("q138_letter_folds", "WITH " + TOKENS + "SELECT DISTINCT token, token || ' замок' AS pointed, token || ' ما' AS lenient FROM tokens")
def q138(spark, d):
    t = T.tokens(spark, d).select("token").distinct()
    pointed = D.column(D.pointing_key)(F.concat_ws(" ", "token", F.lit("замо\u0301к")))
    return t.select("token", pointed.alias("pointed"), D.column(D.fold_lenient_letters)(F.concat_ws(" ", "token", F.lit("ماء"))).alias("lenient"))


@query("q139_hearable_kinds", "WITH " + ANSWERS + """
SELECT learner, event_id, CASE WHEN kind = 'hear' AND item % 3 = 0 THEN 'read' ELSE kind END AS kind, kind AS asked FROM answers""")
def q139(spark, d):
    kind, asked = S.hearable(F.col("kind"), F.col("item") % 3 != 0)
    return T.answers(spark, d).select("learner", "event_id", kind.alias("kind"), asked.alias("asked"))


@query("q140_weighted_kinds", "WITH " + ANSWERS + """,
u AS (SELECT learner, event_id, (event_id % 1000) / 1000.0::DOUBLE AS u FROM answers)
SELECT learner, event_id, CASE WHEN u < 0.5::DOUBLE THEN 'type' WHEN u < 0.8::DOUBLE THEN 'recall' WHEN u < 0.95::DOUBLE THEN 'hear' ELSE 'read' END AS kind FROM u""")
def q140(spark, d):
    u = (F.col("event_id") % 1000) / F.lit(1000.0)
    return T.answers(spark, d).select("learner", "event_id", S.weighted_kind(u, {"type": 10, "recall": 6, "hear": 3, "read": 1}).alias("kind"))


@query("q141_placement_probe", "WITH " + ANSWERS + """,
r AS (SELECT learner, item // 2 AS bucket, count(*) FILTER (ok) * 4 >= count(*) * 3 AS passed FROM answers GROUP BY ALL),
l AS (SELECT learner, coalesce(max(bucket) FILTER (passed), -1) AS floor FROM r GROUP BY learner),
h AS (SELECT l.learner, floor, coalesce(min(bucket) FILTER (NOT passed AND bucket > floor), 5) AS high FROM l JOIN r USING (learner) GROUP BY ALL)
SELECT learner, CAST(floor AS INT) AS floor, CASE WHEN high - floor > 1 THEN CAST((high + floor) // 2 AS BIGINT) END AS probe FROM h""")
def q141(spark, d):
    r = T.answers(spark, d).groupBy("learner", F.floor(F.col("item") / 2).cast("int").alias("bucket")).agg((F.count_if("ok") * 4 >= F.count("*") * 3).alias("passed"))
    return P.placements(r, 5)


@query("q142_phrase_spans", "WITH " + TOKENS + """,
t AS (SELECT doc_id * 100000 + sent AS sentence, CAST(pos AS BIGINT) AS pos, token, lead(token, 1) OVER w AS n1, lead(token, 2) OVER w AS n2 FROM tokens WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)),
r AS (SELECT sentence, pos, 2 AS size, token || ' ' || n1 AS phrase FROM t WHERE n1 IS NOT NULL UNION ALL SELECT sentence, pos, 3, token || ' ' || n1 || ' ' || n2 FROM t WHERE n2 IS NOT NULL),
p AS (SELECT phrase FROM r GROUP BY phrase HAVING count(*) >= 20),
c AS (SELECT sentence, list({'m': -size, 'a': pos, 'b': pos + size, 'id': phrase} ORDER BY -size, pos) AS c FROM r SEMI JOIN p USING (phrase) GROUP BY sentence),
x AS (SELECT sentence, list_reduce(list_prepend([c[1]], list_transform(c, lambda y: [y])), lambda got, y: CASE WHEN len(list_filter(got, lambda g: g.a < y[1].b AND y[1].a < g.b)) = 0 THEN got || y ELSE got END) AS c FROM c),
z AS (SELECT sentence, unnest(c) AS c FROM x) SELECT sentence, c.a AS start, c.b AS stop, c.id AS id FROM z""")
def q142(spark, d):
    t = T.following(spark, d, 3).select((F.col("doc_id") * 100000 + F.col("sent")).alias("sentence"), F.col("pos").cast("long").alias("pos"), "token", "n1", "n2")
    r = t.select(F.explode(F.array(F.when(F.col("n1").isNotNull(), F.concat_ws(" ", "token", "n1")), F.when(F.col("n2").isNotNull(), F.concat_ws(" ", "token", "n1", "n2")))).alias("phrase")).filter("phrase IS NOT NULL")
    phrases = r.groupBy("phrase").agg(F.count("*").alias("n")).filter("n >= 20").select("phrase", F.col("phrase").alias("id"))
    return P.phrases_in(t, settled(phrases))


@query("q143_word_exclusions", "WITH " + WORDS + """,
tc AS (SELECT lang, token, count(*) FILTER (substr(surface, 1, 1) = substr(token, 1, 1)) AS low, count(*) FILTER (substr(surface, 1, 1) <> substr(token, 1, 1)) AS cap FROM tokens WHERE pos > 0 GROUP BY ALL),
e AS (SELECT token FROM words WHERE lang = 'en' AND rank <= 200),
x AS (SELECT w.lang, w.token, w.rank, CASE WHEN coalesce(cap, 0) > coalesce(low, 0) THEN 'proper noun' WHEN regexp_matches(w.token, '^(toxic|insult|slur)') THEN 'profanity' WHEN length(w.token) < 2 THEN 'single letter'
  WHEN w.lang <> 'en' AND w.n < 10 AND e.token IS NOT NULL THEN 'English loanword' WHEN w.n < 3 THEN 'few tokens' ELSE '' END AS reason
  FROM words w LEFT JOIN tc ON tc.lang = w.lang AND tc.token = w.token LEFT JOIN e ON e.token = w.token),
i AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY rank, lang, token) AS i FROM x WHERE reason <> '')
SELECT reason, count(*) AS n, string_agg(token, ' ' ORDER BY i) FILTER (i <= 25) AS samples FROM i GROUP BY reason""")
def q143(spark, d):
    words = T.words(spark, d)
    english = words.filter("lang = 'en' AND rank <= 200").select("token", F.lit(True).alias("english"))
    x = words.join(C.truecase_counts(T.tokens(spark, d)), ["lang", "token"], "left").join(english, "token", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    rules = [
        ("proper noun", none("cap") > none("low")),
        ("profanity", F.col("token").rlike("^(toxic|insult|slur)")),
        ("single letter", F.length("token") < 2),
        ("English loanword", (F.col("lang") != "en") & (F.col("n") < 10) & F.col("english")),
        ("few tokens", F.col("n") < 3),
    ]
    return U.exclusions(x, rules, "token", ["rank", "lang", "token"])[1]


@query("q144_gloss_clean", """
WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '(of things) ' ELSE '' END || 'the ' || p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (x (y) z)' ELSE '' END || ', ' || p_type || ' [w], a ' || p_brand || ', ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN '; more' WHEN p_partkey % 5 = 1 THEN ' (open' ELSE ', etc.' END AS g FROM part),
a AS (SELECT id, regexp_replace(g, '^\\([^)]*\\)\\s*', '') AS g FROM g),
b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(a.g, '\\[[^\\[\\]]*\\]', '', 'g'), '\\s*\\([^()]*\\)', '', 'g'), '\\s*\\([^()]*\\)', '', 'g') AS g FROM a),
c AS (SELECT id, trim(regexp_replace(regexp_replace(g, '\\(.*$', ''), '\\s+', ' ', 'g')) AS g FROM b),
e AS (SELECT id, string_split(string_split(regexp_replace(g, ',?\\s*\\betc\\.?$|[.,;:]+$', '', 'g'), ';')[1], ',') AS p FROM c),
f AS (SELECT id, list_filter(list_transform(p, lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z]')) AS p FROM e),
h AS (SELECT id, list_transform(p, lambda x: CASE WHEN len(string_split(x, ' ')) <= 3 THEN regexp_replace(x, '^(a|an|the) ', '') ELSE x END) AS p FROM f),
i AS (SELECT id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:3] AS p FROM h),
j AS (SELECT id, p, list_filter([array_to_string(p[1:1], ', '), array_to_string(p[1:2], ', '), array_to_string(p[1:3], ', ')], lambda x: length(x) <= 45) AS fits FROM i)
SELECT id, CASE WHEN len(fits) > 0 THEN fits[-1] ELSE regexp_replace(left(p[1], 45), ' [^ ]*$', '') END AS gloss FROM j""")
def q144(spark, d):
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, "; more").when(k % 5 == 1, " (open").otherwise(", etc.")
    g = F.concat(F.when(k % 3 == 0, "(of things) ").otherwise(""), F.lit("the "), "p_name", F.when(k % 4 == 0, " (x (y) z)").otherwise(""), F.lit(", "), "p_type", F.lit(" [w], a "), "p_brand", F.lit(", "), "p_name", end)
    return T.read(spark, d, "part").select(k.alias("id"), G.clean(g).alias("gloss"))


@query("q145_fields_removed", "SELECT p_partkey AS id, {'name': p_name, 'senses': [{'gloss': p_type}, {'gloss': p_brand}]}::JSON::VARCHAR AS entry FROM part")
def q145(spark, d):
    sense = lambda c: F.struct(F.col(c).alias("gloss"), F.col("p_size").alias("audio"))
    entry = F.struct(F.col("p_name").alias("name"), F.lit("a.mp3").alias("audio"), F.array(sense("p_type"), sense("p_brand")).alias("senses"))
    x = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), entry.alias("entry"), F.lit(1).alias("audio"))
    return U.without(x, "audio").select("id", F.to_json("entry").alias("entry"))


def _lines(df, *columns):
    return df.select(F.concat_ws("\t", *columns).alias("value"))


@query("q146_sentence_lines", "WITH " + SENTENCES + """
SELECT lang, doc_id * 100000 + sent AS id, text, source AS "user" FROM sentences WHERE doc_id % 10 <> 0 AND NOT contains(text, chr(9))""")
def q146(spark, d):
    """The sentences written as lines, some with a broken id, read back language by language."""
    s = T.sentences(spark, d).filter(~F.contains("text", F.lit("\t")))
    key = F.when(F.col("doc_id") % 10 == 0, F.lit("x")).otherwise((F.col("doc_id") * 100000 + F.col("sent")).cast("string"))
    lines, out = _lines(s, key, "lang", "text", "source"), None
    for lang in ("de", "en", "es", "fr"):
        one = readers.sentences(lines, lang).select(F.lit(lang).alias("lang"), "id", "text", "user")
        out = one if out is None else out.unionByName(one)
    return out


@query("q147_link_lines", "SELECT l_orderkey AS left_id, l_partkey AS right_id FROM lineitem WHERE l_linenumber % 3 <> 0")
def q147(spark, d):
    l = T.read(spark, d, "lineitem")  # noqa: E741
    return readers.links(_lines(l, F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "?").otherwise(F.col("l_partkey").cast("string"))))


@query("q148_audio_lines", """
SELECT o_orderkey AS id, o_custkey AS clip, o_orderstatus AS "user", CASE o_orderkey % 4 WHEN 0 THEN 'CC BY 4.0' WHEN 1 THEN 'CC0 1.0' ELSE 'CC BY-SA 4.0' END AS licence FROM orders WHERE o_orderkey % 4 <> 3 AND o_custkey % 5 <> 0""")
def q148(spark, d):
    o, k = T.read(spark, d, "orders"), F.col("o_orderkey") % 4
    licence = F.when(k == 0, "CC BY 4.0").when(k == 1, "CC0 1.0").when(k == 2, "CC BY-SA 4.0").otherwise("all rights")
    clip = F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 5 == 0, "b").otherwise(""))
    return readers.audio(_lines(o, F.col("o_orderkey").cast("string"), clip, "o_orderstatus", licence))


@query("q149_subtitle_list", "WITH " + TOKENS + "SELECT token, count(*) AS n FROM tokens GROUP BY token")
def q149(spark, d):
    """Lines of surfaces with their counts; capitals fold together."""
    c = T.tokens(spark, d).groupBy("surface").agg(F.count("*").alias("n"))
    return readers.subtitle_list(c.select(F.concat_ws(" ", "surface", F.col("n").cast("string")).alias("value")), most=None)


@query("q150_progress_validation", """
SELECT p_partkey AS learner, CASE p_partkey % 5 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'record' ELSE '' END AS reason, CASE WHEN p_partkey % 5 > 1 THEN 2 ELSE 0 END AS records FROM part""")
def q150(spark, d):
    k = F.col("p_partkey")
    r = F.when(k % 5 == 1, "-3").otherwise("4")
    good = F.concat(F.lit('{"v": 2, "w": {"a": {"r": '), r, F.lit(', "w": 1, "s": 0}, "b": {"r": 1, "w": 0, "s": 1}}}'))
    raw = F.when(k % 5 == 0, F.lit("{not json")).otherwise(good)
    valid, broken = readers.progress(T.read(spark, d, "part").select(k.alias("learner"), raw.alias("raw")))
    return valid.select("learner", F.lit("").alias("reason"), F.size("w").alias("records")).unionByName(broken.select("learner", "reason", F.lit(0).alias("records")))


@query("q151_lexicon_lines", "SELECT p_partkey AS id, p_name AS word, p_type AS gloss FROM part WHERE p_partkey % 3 = 0")
def q151(spark, d):
    p = T.read(spark, d, "part")
    entry = F.struct(F.col("p_name").alias("word"), F.when(F.col("p_partkey") % 3 == 0, "fr").otherwise("de").alias("lang_code"), F.col("p_partkey").cast("string").alias("pos"), F.array(F.struct(F.array("p_type").alias("glosses"))).alias("senses"))
    return readers.lexicon(p.select(F.to_json(entry).alias("value")), "fr").select(F.col("pos").cast("long").alias("id"), "word", F.col("senses")[0]["glosses"][0].alias("gloss"))


@query("q152_zipf_list", "SELECT lower(p_brand) AS token, round(sum(power(10.0::DOUBLE, (p_size % 7) / 2.0::DOUBLE)), 4) AS n FROM part GROUP BY 1")
def q152(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_brand").alias("word"), ((F.col("p_size") % 7) / F.lit(2.0)).alias("zipf"))
    return readers.zipf_list(p).select("token", F.round("n", 4).alias("n"))


@query("q153_word_rules", "WITH " + WORDS + """,
w AS (SELECT lang, CASE WHEN rank % 97 = 5 THEN '' ELSE token END AS token, CASE WHEN lang = 'fr' AND rank > 40 THEN rank + 1 ELSE rank END AS rank, rank AS r,
  CASE WHEN lang = 'es' AND rank = 700 THEN 'A1' WHEN rank = 13 THEN 'Z' WHEN rank <= 600 THEN 'A1' WHEN rank <= 1300 THEN 'A2' ELSE 'B1' END AS lv, CAST(rank % 4 AS INT) AS ft FROM words),
v AS (SELECT lang, list_position(['A1', 'A2', 'B1'], lv) AS k, count(*) AS n, min(rank) AS a, max(rank) AS z FROM w GROUP BY lang, lv),
m AS (SELECT *, lag(z) OVER (PARTITION BY lang ORDER BY coalesce(k, 0)) AS before FROM v),
f AS (SELECT 'keys_filled' AS rule, count(*) FILTER (token = '') AS n FROM w
  UNION ALL SELECT 'keys_unique', count(*) FROM (SELECT lang, token FROM w GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'ranks_without_gap', count(*) FROM (SELECT lang FROM w GROUP BY lang HAVING min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*))
  UNION ALL SELECT 'levels_known', count(*) FROM w WHERE lv NOT IN ('A1', 'A2', 'B1') UNION ALL SELECT 'tiers_known', count(*) FROM w WHERE ft NOT IN (0, 1, 2)
  UNION ALL SELECT 'levels_in_order', count(*) FROM m WHERE before >= a UNION ALL SELECT 'levels_filled', count(*) FROM v WHERE n < 5)
SELECT rule, n = 0 AS ok, n FROM f""")
def q153(spark, d):
    """Word lists with planted faults."""
    r = F.col("rank")
    lv = F.when((F.col("lang") == "es") & (r == 700), "A1").when(r == 13, "Z").when(r <= 600, "A1").when(r <= 1300, "A2").otherwise("B1")
    w = T.words(spark, d).select("lang", F.when(r % 97 == 5, "").otherwise(F.col("token")).alias("token"), F.when((F.col("lang") == "fr") & (r > 40), r + 1).otherwise(r).alias("rank"), lv.alias("lv"), (r % 4).cast("int").alias("ft"))
    return word_rules(w, ("A1", "A2", "B1"), least=5)
