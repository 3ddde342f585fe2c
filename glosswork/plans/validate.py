"""Rules that a pack's sentences, synonyms and passages must keep, as counts of what breaks them; each rule is a filter, an aggregate or an anti-join, and no row is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _empty(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def _counted(rows: DataFrame, prefix: str, rules: dict[str, Column], times: Column | None = None) -> DataFrame:
    """(rule, n): rows that meet each condition, in one pass; each counts `times`, once without it."""
    times = F.lit(1) if times is None else times
    one = rows.agg(*[F.coalesce(F.sum(F.when(c, times)), F.lit(0)).cast("long").alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"{prefix}_{k}").alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


def _rows(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def _verdicts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", (F.col("n") == 0).alias("ok"), "n")


def sentence_rules(sentences: DataFrame, words: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(rule, ok, n) of sentences (id, t, en, lv, words: array) against words (id): ids, texts and translations filled, ids once, levels known, words listed and known."""
    listed = F.size(F.coalesce("words", F.array())) > 0
    level = F.coalesce(F.col("lv").isin(*levels), F.lit(False))
    lost = sentences.select("id", F.explode("words").alias("word")).join(words.select(F.col("id").alias("word")).distinct(), "word", "left_anti")
    rules = {"ids_filled": _empty("id"), "texts_filled": _empty("t"), "translations_filled": _empty("en"), "levels_known": ~level, "words_listed": ~listed}
    return _verdicts([_counted(sentences, "sentence", rules), _rows(_repeated(sentences.filter(~_empty("id")), "id"), "sentence_ids_once"), _rows(lost, "sentence_words_known")])


def synonym_rules(links: DataFrame, words: DataFrame) -> DataFrame:
    """(rule, ok, n) of links (id, other, typed) against words (id): known, not to itself, once, symmetric where not typed, and typed only between synonyms."""
    known = words.select(F.col("id").alias("other")).distinct()
    syn, typed = links.filter("NOT typed"), links.filter("typed")
    turned = syn.select(F.col("other").alias("id"), F.col("id").alias("other")).distinct()
    pairs = syn.select("id", "other").distinct()
    return _verdicts([
        _rows(links.join(known, "other", "left_anti"), "synonyms_known"),
        _rows(links.filter("id = other"), "synonyms_of_others"),
        _rows(_repeated(links, "id", "other", "typed"), "synonyms_once"),
        _rows(pairs.join(turned, ["id", "other"], "left_anti"), "synonyms_symmetric"),
        _rows(typed.select("id", "other").distinct().join(pairs, ["id", "other"], "left_anti"), "typed_within_synonyms"),
    ])


#: Lengths of the runs of characters by which lines meet texts.
RUNS = (1, 2, 4, 8, 16)


def _apart(lines: DataFrame, passages: DataFrame) -> DataFrame:
    """(rule, n): pairs of a line (passage, t, _n: passages of its id) that is not blank and a text of its id that does not hold it.

    Where an id has one passage, its lines meet the text. Where it has several,
    only pairs that may hold are made: equal lines and equal texts are one row,
    and a line meets the texts that hold its rarest run of characters, of the
    greatest length in RUNS that fits. All other pairs are counted without being made.
    """
    t = lines.select("passage", "_n", F.trim("t").alias("t")).filter("t <> ''").groupBy("passage", "_n", "t").agg(F.count("*").alias("w"))
    texts = passages.select(F.col("id").alias("passage"), F.coalesce("text", F.lit("")).alias("text"))
    holds = F.contains("text", F.col("t"))
    one = t.filter("_n = 1").join(texts, "passage").filter(holds).select("w")
    many = t.filter("_n > 1")
    ids = passages.groupBy(F.col("id").alias("passage")).count().filter("count > 1").select("passage")
    texts = texts.join(ids, "passage", "left_semi").groupBy("passage", "text").agg(F.count("*").alias("c")).withColumn("k", F.sha2("text", 256))
    size = F.lit(RUNS[0])
    for r in RUNS[1:]:
        size = F.when(F.length("t") >= r, r).otherwise(size)
    runs = F.transform(F.sequence(F.lit(1), F.length("t") - F.col("g") + 1, F.col("g")), lambda i: F.substring("t", i, F.col("g")))
    asked = many.withColumn("g", size).select("passage", "t", "w", F.explode_outer(F.array_distinct(runs)).alias("run"))
    cut = lambda r: F.transform("chars", lambda _, i: F.when(i + r <= F.size("chars"), F.array_join(F.slice("chars", i + 1, r), "")))
    chars = texts.select("passage", "k", F.filter(F.split("text", ""), lambda x: x != "").alias("chars"))
    index = chars.select("passage", "k", F.explode_outer(F.array_distinct(F.concat(*[cut(r) for r in RUNS]))).alias("run")).filter("run IS NOT NULL")
    index = index.join(asked.select("passage", "run").distinct(), ["passage", "run"], "left_semi")
    held = index.groupBy("passage", "run").agg(F.count("*").alias("n"))
    rarest = asked.join(held, ["passage", "run"], "left").groupBy("passage", "t", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("b"))
    met = rarest.filter("b.n > 0").select("passage", "t", "w", "b.run").join(index, ["passage", "run"]).join(texts, ["passage", "k"]).filter(holds)
    sums = t.select((F.col("w") * F.col("_n")).alias("v")).unionByName(one.select((-F.col("w")).alias("v"))).unionByName(met.select((-F.col("w") * F.col("c")).alias("v")))
    return sums.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n")).select(F.lit("passage_lines_in_text").alias("rule"), "n")


def passage_rules(passages: DataFrame, lines: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(rule, ok, n) of passages (id, lv, title, text) and their lines (passage, t, en): filled, ids once, levels known, lines there and in the text."""
    level = F.coalesce(F.col("lv").isin(*levels), F.lit(False))
    # A line counts once for each passage of its id.
    told = lines.join(passages.groupBy(F.col("id").alias("passage")).agg(F.count("*").alias("_n")), "passage")
    rules = {"titles_filled": _empty("title"), "texts_filled": _empty("text"), "levels_known": ~level}
    of_lines = {"lines_filled": _empty("t"), "lines_translated": _empty("en")}
    bare = passages.select(F.col("id").alias("passage")).distinct().join(lines.select("passage").distinct(), "passage", "left_anti")
    return _verdicts([_counted(passages, "passage", rules), _counted(told, "passage", of_lines, F.col("_n")), _apart(told, passages), _rows(_repeated(passages, "id"), "passage_ids_once"), _rows(bare, "passage_has_lines")])


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("q177_sentence_rules", """
WITH s AS (SELECT CASE WHEN o_orderkey % 700 = 3 THEN 5 WHEN o_orderkey % 900 = 8 THEN NULL ELSE o_orderkey END AS id, CASE WHEN o_custkey % 50 = 1 THEN ' ' ELSE o_orderpriority END AS t, CASE WHEN o_custkey % 70 = 2 THEN NULL ELSE o_orderpriority END AS en,
  CASE WHEN o_orderkey % 300 = 7 THEN NULL ELSE o_orderstatus END AS lv, o_orderkey AS k FROM orders),
w AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 60 = 9 THEN l_partkey + 1000000000 ELSE l_partkey END AS word FROM lineitem),
f AS (SELECT 'sentence_ids_filled' AS rule, count(*) FILTER (id IS NULL) AS n FROM s UNION ALL SELECT 'sentence_texts_filled', count(*) FILTER (trim(t) = '') FROM s UNION ALL SELECT 'sentence_translations_filled', count(*) FILTER (en IS NULL) FROM s
  UNION ALL SELECT 'sentence_levels_known', count(*) FILTER (lv IS NULL OR lv NOT IN ('O', 'F')) FROM s UNION ALL SELECT 'sentence_words_listed', count(*) FROM s ANTI JOIN w USING (k)
  UNION ALL SELECT 'sentence_ids_once', count(*) FROM (SELECT id FROM s WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'sentence_words_known', count(*) FROM w JOIN s USING (k) ANTI JOIN part ON p_partkey = word)
SELECT rule, n = 0 AS ok, n FROM f""")
def q177(spark, d):
    """Orders as sentences of their parts, with planted faults."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = F.when(F.col("l_suppkey") % 60 == 9, F.col("l_partkey") + 1000000000).otherwise(F.col("l_partkey"))
    w = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(word).alias("words"))
    o = T.read(spark, d, "orders").join(w, "o_orderkey", "left")
    text = F.col("o_orderpriority")
    s = o.select(
        F.when(k % 700 == 3, 5).when(k % 900 == 8, None).otherwise(k).alias("id"), F.when(c % 50 == 1, " ").otherwise(text).alias("t"), F.when(c % 70 == 2, None).otherwise(text).alias("en"), F.when(k % 300 == 7, None).otherwise(F.col("o_orderstatus")).alias("lv"), "words"
    )
    return sentence_rules(s, T.read(spark, d, "part").select(F.col("p_partkey").alias("id")), ("O", "F"))


@query("q178_synonym_rules", """
WITH l AS (SELECT l_partkey AS id, CASE WHEN l_linenumber % 5 = 0 THEN l_partkey ELSE l_partkey + l_linenumber END AS other, l_suppkey % 3 = 0 AS typed FROM lineitem UNION ALL SELECT l_partkey + l_linenumber, l_partkey, false FROM lineitem WHERE l_suppkey % 2 = 0),
s AS (SELECT DISTINCT id, other FROM l WHERE NOT typed),
f AS (SELECT 'synonyms_known' AS rule, count(*) AS n FROM l ANTI JOIN part ON p_partkey = other UNION ALL SELECT 'synonyms_of_others', count(*) FROM l WHERE id = other
  UNION ALL SELECT 'synonyms_once', count(*) FROM (SELECT 1 FROM l GROUP BY id, other, typed HAVING count(*) > 1)
  UNION ALL SELECT 'synonyms_symmetric', count(*) FROM s ANTI JOIN (SELECT other AS id, id AS other FROM s) t USING (id, other)
  UNION ALL SELECT 'typed_within_synonyms', count(*) FROM (SELECT DISTINCT id, other FROM l WHERE typed) t ANTI JOIN s USING (id, other))
SELECT rule, n = 0 AS ok, n FROM f""")
def q178(spark, d):
    """Links between parts, of which some are one-sided, repeated or to parts that are not there."""
    x, n = T.read(spark, d, "lineitem"), F.col("l_linenumber")
    links = x.select(F.col("l_partkey").alias("id"), F.when(n % 5 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + n).alias("other"), (F.col("l_suppkey") % 3 == 0).alias("typed"))
    back = x.filter("l_suppkey % 2 = 0").select((F.col("l_partkey") + n).alias("id"), F.col("l_partkey").alias("other"), F.lit(False).alias("typed"))
    return synonym_rules(links.unionByName(back), T.read(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query("q179_passage_rules", """
WITH p AS (SELECT CASE WHEN doc_id % 90 = 4 THEN 1 ELSE doc_id END AS id, CASE WHEN doc_id % 40 = 3 THEN 'xx' ELSE lang END AS lv, CASE WHEN doc_id % 30 = 2 THEN '' ELSE source END AS title, text, doc_id FROM documents),
l AS (SELECT id AS passage, unnest(string_split(text, chr(10))) AS t, doc_id FROM p WHERE doc_id % 25 <> 6),
m AS (SELECT passage, CASE WHEN doc_id % 20 = 5 THEN t || '~~' ELSE t END AS t, CASE WHEN doc_id % 15 = 1 THEN NULL ELSE 'x' END AS en FROM l),
j AS (SELECT m.*, text FROM m JOIN p ON p.id = m.passage),
f AS (SELECT 'passage_titles_filled' AS rule, count(*) FILTER (trim(title) = '') AS n FROM p UNION ALL SELECT 'passage_texts_filled', count(*) FILTER (trim(text) = '') FROM p UNION ALL SELECT 'passage_levels_known', count(*) FILTER (lv = 'xx') FROM p
  UNION ALL SELECT 'passage_lines_filled', count(*) FILTER (trim(t) = '') FROM j UNION ALL SELECT 'passage_lines_translated', count(*) FILTER (en IS NULL) FROM j UNION ALL SELECT 'passage_lines_in_text', count(*) FILTER (trim(t) <> '' AND NOT contains(text, trim(t))) FROM j
  UNION ALL SELECT 'passage_ids_once', count(*) FROM (SELECT id FROM p GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'passage_has_lines', count(*) FROM (SELECT DISTINCT id FROM p) ANTI JOIN (SELECT DISTINCT passage AS id FROM m) USING (id))
SELECT rule, n = 0 AS ok, n FROM f""")
def q179(spark, d):
    """Documents as passages of their lines, with planted faults."""
    k = F.col("doc_id")
    docs = T.read(spark, d, "documents")
    p = docs.select(F.when(k % 90 == 4, 1).otherwise(k).alias("id"), F.when(k % 40 == 3, "xx").otherwise(F.col("lang")).alias("lv"), F.when(k % 30 == 2, "").otherwise(F.col("source")).alias("title"), "text", "doc_id")
    t = p.filter(k % 25 != 6).select(F.col("id").alias("passage"), "doc_id", F.explode(F.split("text", "\n")).alias("t"))
    lines = t.select("passage", F.when(k % 20 == 5, F.concat("t", F.lit("~~"))).otherwise(F.col("t")).alias("t"), F.when(k % 15 == 1, None).otherwise(F.lit("x")).alias("en"))
    return passage_rules(p.drop("doc_id"), lines, ("en", "fr", "de", "es"))
