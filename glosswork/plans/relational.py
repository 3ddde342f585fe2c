"""Queries over keyed tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import relations as R
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


@query("q32_argmin_links", """
WITH f AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem SEMI JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(p, -1) AS right_id, coalesce(p_name, '') AS linked FROM orders LEFT JOIN f ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = p""")
def q32(spark, d):
    left = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    links = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"))
    right = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return R.argmin_link(left, links, right, outer=True).select("id", F.coalesce("right_id", F.lit(-1)).alias("right_id"), "linked")


@query("q33_audio_argmin", """
SELECT l_orderkey AS id, min(l_suppkey) AS clip, arg_min(l_returnflag, (l_suppkey, l_linenumber, l_returnflag)) AS licence FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_orderkey""")
def q33(spark, d):
    x = T.read(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "N"))
    return x.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("clip"), F.min_by("l_returnflag", F.struct("l_suppkey", "l_linenumber", "l_returnflag")).alias("licence"))


@query("q34_form_chase", """
WITH RECURSIVE e AS (SELECT c_custkey AS form, (c_custkey * 7 + 3) % 1500 AS target, 0 AS ord FROM customer UNION ALL SELECT c_custkey, (c_custkey * 11 + 5) % 1500, 1 FROM customer),
u AS (SELECT c_custkey AS lemma FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 2000),
w AS (SELECT form, [ord] AS path, target, 1 AS steps, EXISTS (SELECT 1 FROM u WHERE lemma = target) AS ok FROM e
  UNION ALL SELECT w.form, list_append(path, e.ord), e.target, steps + 1, EXISTS (SELECT 1 FROM u WHERE lemma = e.target) FROM w JOIN e ON e.form = w.target WHERE NOT ok AND steps < 3)
SELECT form, target AS lemma, CAST(steps AS INT) AS steps FROM w WHERE ok QUALIFY row_number() OVER (PARTITION BY form ORDER BY steps, path, target) = 1""")
def q34(spark, d):
    c = T.read(spark, d, "customer")
    e = [c.select(F.col("c_custkey").alias("form"), ((F.col("c_custkey") * a + b) % 1500).alias("target"), F.lit(k).alias("ord")) for k, (a, b) in enumerate(((7, 3), (11, 5)))]
    usable = c.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 2000").select(F.col("c_custkey").alias("lemma"))
    return R.form_chase(e[0].unionByName(e[1]), usable)


@query("q35_distractors_antijoin", """
WITH x AS (SELECT p_partkey AS id, p_type, p_brand, p_name, md5(CAST(p_partkey AS VARCHAR)) AS ok FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY ok, id) AS i, count(*) OVER (PARTITION BY p_type) AS size FROM x),
a AS (SELECT *, unnest(range(1, size)) AS j FROM i),
c AS (SELECT a.id, a.j, b.id AS other FROM a JOIN i b ON b.p_type = a.p_type AND b.i = (a.i + a.j - 1) % a.size + 1 WHERE a.p_brand <> b.p_brand AND a.p_name <> b.p_name)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY j) AS place, other FROM c QUALIFY place <= 3""")
def q35(spark, d):
    p = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand", "p_name", F.md5(F.col("p_partkey").cast("string")).alias("order_key"))
    return R.distractors(p, "p_type", ["p_brand", "p_name"])


@query("q36_typed_match_guard", """
WITH w AS (SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey % 50 AS VARCHAR) AS form FROM part),
t AS (SELECT id, CASE id % 4 WHEN 0 THEN form WHEN 1 THEN upper(form) WHEN 2 THEN ' ' || replace(form, ' ', '-') ELSE p_name || ' ' || CAST((p_partkey + 1) % 50 AS VARCHAR) END AS answer FROM w JOIN part ON p_partkey = id),
f AS (SELECT DISTINCT form FROM w)
SELECT t.id, answer, CASE WHEN answer = w.form THEN 'exact' WHEN f.form IS NOT NULL THEN 'other'
  WHEN regexp_replace(lower(trim(answer)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(trim(w.form)), '[^a-z0-9]', '', 'g') THEN 'folded' ELSE 'wrong' END AS verdict
FROM t JOIN w USING (id) LEFT JOIN f ON f.form = answer""")
def q36(spark, d):
    p = T.read(spark, d, "part")
    form = lambda k: F.concat("p_name", F.lit(" "), ((F.col("p_partkey") + k) % 50).cast("string"))
    w = p.select(F.col("p_partkey").alias("id"), form(0).alias("form"), form(1).alias("next"))
    k = F.col("id") % 4
    answer = F.when(k == 0, F.col("form")).when(k == 1, F.upper("form")).when(k == 2, F.concat(F.lit(" "), F.replace("form", F.lit(" "), F.lit("-")))).otherwise(F.col("next"))
    return R.typed_match(w.select("id", answer.alias("answer")), w.select("id", "form"))


_IDS = """
t AS (SELECT p_partkey AS ord, p_name || ' ' || p_type AS text FROM part),
s AS (SELECT p_partkey * 3 AS id, CASE WHEN p_partkey % 5 = 0 THEN 'gone' ELSE p_name || ' ' || p_type END AS text FROM part WHERE p_partkey % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS k FROM t),
l AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS k FROM s),
x AS (SELECT ord, k.text, id FROM k LEFT JOIN l USING (text, k)),
c AS (SELECT ord, text, id, false AS fresh FROM x WHERE id IS NOT NULL
  UNION ALL SELECT ord, text, (SELECT max(id) FROM s) + row_number() OVER (ORDER BY ord), true FROM x WHERE id IS NULL)"""


def _issued(spark, d):
    p = T.read(spark, d, "part")
    text = F.concat("p_name", F.lit(" "), "p_type")
    issued = p.filter("p_partkey % 2 = 0").select((F.col("p_partkey") * 3).alias("id"), F.when(F.col("p_partkey") % 5 == 0, "gone").otherwise(text).alias("text"))
    return p.select(F.col("p_partkey").alias("ord"), text.alias("text")), issued


@query("q37_id_carry_forward", "WITH " + _IDS + " SELECT * FROM c")
def q37(spark, d):
    return R.carry_ids(*_issued(spark, d))


@query("q38_id_verify", "WITH " + _IDS + " SELECT id, text FROM s WHERE id NOT IN (SELECT id FROM c WHERE NOT fresh)")
def q38(spark, d):
    texts, issued = _issued(spark, d)
    return R.retired(issued, R.carry_ids(texts, issued))


@query("q39_version_diff", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS t FROM orders WHERE o_orderkey % 10 <> 4),
x AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
  concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END, CASE WHEN a.t IS DISTINCT FROM b.t THEN 'o_totalprice' END) AS f FROM a FULL JOIN b ON a.k = b.k)
SELECT k AS o_orderkey, change, CASE WHEN change = 'changed' THEN f ELSE '' END AS fields FROM x WHERE change <> 'changed' OR f <> ''""")
def q39(spark, d):
    o = T.read(spark, d, "orders")
    k = F.col("o_orderkey")
    new = o.filter(k % 10 != 4).withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 11 != 0, F.col("o_totalprice"))})
    return R.version_diff(o.filter(k % 10 != 3), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


_CHECKS = (
    ("lineitem_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("order_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("order_without_lines", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("label_document", "labels", "doc_id", "documents", "doc_id"),
    ("document_label", "documents", "doc_id", "labels", "doc_id"),
)


@query("q40_referential_checks", " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n, coalesce(CAST(min({c}) AS BIGINT), -1) AS first FROM {t} ANTI JOIN {p} ON {t}.{c} = {p}.{k}" for r, t, c, p, k in _CHECKS))
def q40(spark, d):
    read = lambda n: T.read(spark, d, n)
    out = None
    for rule, t, c, p, k in _CHECKS:
        one = R.dangling(read(t), c, read(p), k, rule)
        out = one if out is None else out.unionByName(one)
    return out


@query("q41_pack_gate", """
SELECT 'documents_unique' AS rule, count(*) = count(DISTINCT doc_id) AS ok, count(*) AS n FROM documents
UNION ALL SELECT 'texts_not_empty', count(*) FILTER (coalesce(text, '') = '') = 0, count(*) FROM documents
UNION ALL SELECT 'lengths_right', count(*) FILTER (n_chars <> length(text)) = 0, count(*) FROM documents
UNION ALL SELECT 'labels_binary', count(*) FILTER (quality NOT IN (0, 1) OR toxic NOT IN (0, 1)) = 0, count(*) FROM labels
UNION ALL SELECT 'levels_covered', count(DISTINCT lang) >= 4, count(DISTINCT lang) FROM documents""")
def q41(spark, d):
    docs, labels = T.read(spark, d, "documents"), T.read(spark, d, "labels")
    a = docs.agg(
        F.count("*").alias("n"),
        (F.count("*") == F.count_distinct("doc_id")).alias("documents_unique"),
        (F.count_if(F.coalesce("text", F.lit("")) == "") == 0).alias("texts_not_empty"),
        (F.count_if(F.col("n_chars") != F.length("text")) == 0).alias("lengths_right"),
        F.count_distinct("lang").alias("langs"),
    )
    b = labels.agg(F.count("*").alias("n"), (F.count_if(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)) == 0).alias("ok"))
    rules = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("ok"), F.col("n")) for r in ("documents_unique", "texts_not_empty", "lengths_right")]
    rules.append(F.struct(F.lit("levels_covered").alias("rule"), (F.col("langs") >= 4).alias("ok"), F.col("langs").alias("n")))
    return a.select(F.explode(F.array(*rules)).alias("r")).select("r.*").unionByName(b.select(F.lit("labels_binary").alias("rule"), "ok", "n"))


@query("q42_search_ranked", """
WITH x AS (SELECT p_partkey AS id, p_name, p_type, CASE WHEN lower(trim(p_name)) = 'red' THEN 0 WHEN starts_with(lower(trim(p_name)), 'red') THEN 1
  WHEN contains(lower(trim(p_name)), 'red') THEN 2 WHEN contains(lower(p_type), 'red') THEN 3 END AS tier FROM part)
SELECT id, p_name, CAST(tier AS INT) AS tier FROM x WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 20""")
def q42(spark, d):
    p = T.read(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return R.search(p, "p_name", "p_type", "red").select("id", "p_name", "tier")


@query("q43_stratified_sample", """
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', 'qa1', doc_id)), doc_id) AS place FROM documents QUALIFY place <= 12""")
def q43(spark, d):
    return R.stratified(T.read(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 12, "qa1")


@query("q44_attribution", """
WITH g AS (SELECT lang AS licence, source AS "user", count(*) AS n FROM documents GROUP BY lang, source)
SELECT *, row_number() OVER (PARTITION BY licence ORDER BY n DESC, "user") AS place FROM g""")
def q44(spark, d):
    return R.attribution(T.read(spark, d, "documents"), "lang", "source")


@query("q46_confusion_matrix", "WITH " + WORDS + """,
a AS (SELECT lang, token, least(CAST(floor((rank - 1) / 500) AS INT), 3) AS mine FROM words),
s AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS r FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM conversations) GROUP BY token),
b AS (SELECT token, least(CAST(floor((r - 1) / 500) AS INT), 3) AS theirs FROM s)
SELECT lang, mine, theirs, count(*) AS n, mine = theirs AS exact, abs(mine - theirs) <= 1 AS near FROM a JOIN b USING (token) GROUP BY lang, mine, theirs""")
def q46(spark, d):
    level = lambda c: F.least(F.floor((F.col(c) - 1) / 500).cast("int"), F.lit(3))
    a = T.words(spark, d).select("lang", "token", level("rank").alias("mine"))
    said = T.read(spark, d, "conversations").select(F.explode(T.words_of(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    b = T.ranked(said.withColumn("_", F.lit(0)), ["_"]).select("token", level("rank").alias("theirs"))
    return R.confusion(a.join(b, "token"), "mine", "theirs", ("lang",))


@query("q47_exam_quota", "WITH " + ANSWERS + """,
g AS (SELECT learner, kind, item, count(*) FILTER (ok) AS r FROM answers GROUP BY ALL)
SELECT learner, kind, item, r, row_number() OVER (PARTITION BY learner, kind ORDER BY r, item) AS place FROM g
QUALIFY place <= CASE kind WHEN 'type' THEN 4 WHEN 'recall' THEN 3 WHEN 'hear' THEN 2 ELSE 1 END""")
def q47(spark, d):
    g = T.answers(spark, d).groupBy("learner", "kind", "item").agg(F.count_if("ok").alias("r"))
    return R.quota_pick(g, "learner", "kind", ["r", "item"], {"type": 4, "recall": 3, "hear": 2, "read": 1})


_MEANINGS = """m AS (SELECT DISTINCT p_partkey AS id, p_brand || ':' || CAST(p_size AS VARCHAR) AS meaning FROM part
  UNION SELECT p_partkey, p_type || ':' || CAST(p_partkey // 20 AS VARCHAR) FROM part)"""


def _meanings(spark, d):
    p = T.read(spark, d, "part").withColumnRenamed("p_partkey", "id")
    a = p.select("id", F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("meaning"))
    return a.unionByName(p.select("id", F.concat_ws(":", "p_type", F.floor(F.col("id") / 20).cast("string")).alias("meaning"))).distinct()


@query("q54_synonym_pairs", "WITH " + _MEANINGS + """
SELECT meaning, min(id) OVER (PARTITION BY meaning) AS first, id FROM m QUALIFY count(*) OVER (PARTITION BY meaning) > 1""")
def q54(spark, d):
    return R.synonym_links(_meanings(spark, d))


@query("q55_division_gate", """
WITH h AS (SELECT DISTINCT l_suppkey AS id, p_brand AS value FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT DISTINCT o_custkey AS id, p_brand AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
ho AS (SELECT id, min(id) OVER (PARTITION BY v) AS class FROM (SELECT id, string_agg(value, ',' ORDER BY value) AS v FROM h GROUP BY id)),
nt AS (SELECT id, size, min(id) OVER (PARTITION BY v) AS class FROM (SELECT id, string_agg(value, ',' ORDER BY value) AS v, count(*) AS size FROM n GROUP BY id)),
x AS (SELECT h.* FROM h SEMI JOIN (SELECT id FROM ho WHERE id = class) k ON k.id = h.id), y AS (SELECT n.*, size FROM n JOIN nt ON nt.id = n.id WHERE n.id = class)
SELECT 'pair' AS kind, x.id AS a, y.id AS b FROM x JOIN y USING (value) GROUP BY x.id, y.id, size HAVING count(*) = size
UNION ALL SELECT 'owner', id, class FROM ho UNION ALL SELECT 'target', id, class FROM nt""")
def q55(spark, d):
    read = lambda n: T.read(spark, d, n)
    lp = read("lineitem").join(read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("value")), "l_partkey")
    need = lp.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("target"), "value")
    return R.covers(lp.select(F.col("l_suppkey").alias("owner"), "value"), need)


@query("q59_key_functions", """
SELECT p_partkey AS id, lower(trim(p_name)) AS norm, array_to_string(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), '\\s+')[1:2], ' ') AS two,
  levenshtein(p_name, p_type) AS distance, CAST(date_diff('day', DATE '1970-01-01', DATE '1995-01-01' + CAST(p_partkey % 1000 AS INT)) AS BIGINT) AS day FROM part""")
def q59(spark, d):
    p = T.read(spark, d, "part")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 1000).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), X.norm_key(F.col("p_name")).alias("norm"), X.first_two_words(F.col("p_name")).alias("two"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"), X.iso_day_number(day).cast("long").alias("day"))


@query("q60_token_context", "WITH " + TOKENS + """
SELECT doc_id, sent, pos, token, coalesce(lag(token) OVER w, '') AS before, coalesce(lead(token) OVER w, '') AS after FROM tokens WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)""")
def q60(spark, d):
    w = W.partitionBy("doc_id", "sent").orderBy("pos")
    t = T.tokens(spark, d)
    return t.select("doc_id", "sent", "pos", "token", F.coalesce(F.lag("token").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("token").over(w), F.lit("")).alias("after"))
