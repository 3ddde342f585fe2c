"""Derived tables that the catalogue's queries read: answers, tokens, sentences and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators.settle import settled


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer log of the learners, from events.

    item is the key in props modulo 10, ok whatever is not an error, kind what
    was asked, day the date, session the learner's day ordinal from 1, and
    (ts, event_id) the total order of a learner's answers. The session ordinal
    comes from the distinct (learner, day) pairs, which stay small however many
    answers a learner gives in a day.
    """
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("learner"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("item"),
        (F.col("event_type") != "error").alias("ok"),
        kind[F.col("event_type")].alias("kind"),
        F.to_date("ts").alias("day"),
        "ts",
        "event_id",
        "value",
    )
    days = e.select("learner", "day").distinct().withColumn("session", F.row_number().over(W.partitionBy("learner").orderBy("day")))
    return e.join(days, ["learner", "day"])


#: What an event asked.
KINDS = {"purchase": "type", "signup": "recall", "click": "hear", "view": "read", "error": "type"}
PRODUCTION = ("type", "recall")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, doc_id, source, sent, text): documents cut at full stops, marks of exclamation or question, and line feeds; sent from 0.

    Outer forms of explode here and below: from the others Spark derives a
    filter on the array's size, for which it makes the array twice.
    """
    d = read(spark, sf_dir, "documents")
    cut = d.select("lang", "doc_id", "source", F.posexplode_outer(F.split("text", "[.!?\n]")).alias("sent", "text"))
    return cut.withColumn("text", F.trim("text")).filter("text <> ''")


def words_of(text: Column) -> Column:
    """The runs of letters of a text."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, doc_id, source, sent, pos, surface, token): the letter runs of each sentence, pos from 0; token in lower case."""
    s = sentences(spark, sf_dir)
    t = s.select("lang", "doc_id", "source", "sent", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "surface")).filter("pos IS NOT NULL")
    return t.withColumn("token", F.lower("surface"))


def following(spark: SparkSession, sf_dir: str, longest: int) -> DataFrame:
    """The tokens with n1, n2, …: the longest - 1 tokens after each in its sentence, null past the end. They are read from the sentence's own array, no window."""
    s = sentences(spark, sf_dir).withColumn("_w", words_of(F.col("text")))
    t = s.select("lang", "doc_id", "source", "sent", "_w", F.posexplode_outer("_w").alias("pos", "surface")).filter("pos IS NOT NULL")
    after = [F.lower(F.get("_w", F.col("pos") + k)).alias(f"n{k}") for k in range(1, longest)]
    return t.select("lang", "doc_id", "source", "sent", "pos", "surface", F.lower("surface").alias("token"), *after)


def bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences with toks, their tokens in order."""
    return sentences(spark, sf_dir).withColumn("toks", F.transform(words_of(F.col("text")), lambda w: F.lower(w)))


def ranked(counts: DataFrame, by: list[str], n: str = "n", key: str = "token", name: str = "rank") -> DataFrame:
    """Adds the row number by (-n, key) within `by`, without sorting a whole group in one task.

    First the sizes of the classes of equal n (few rows) give each class its
    offset; then rows are numbered within (by, n, first characters of key),
    again over small offsets. The shuffles are by those finer keys.
    """
    part = F.substring(key, 1, 2)
    t = counts.withColumn("_p", part)
    sizes = t.groupBy(*by, n, "_p").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by).orderBy(F.col(n).desc(), "_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inner = t.withColumn("_i", F.row_number().over(W.partitionBy(*by, n, "_p").orderBy(key)))
    return inner.join(offsets, [*by, n, "_p"]).withColumn(name, (F.col("_o") + F.col("_i")).cast("long")).drop("_o", "_i", "_p")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, token, n): how often each token stands in the texts of a language. A run of letters goes over no end of a sentence, so texts are read whole."""
    t = read(spark, sf_dir, "documents").select("lang", F.explode_outer(words_of(F.col("text"))).alias("surface")).filter("surface IS NOT NULL")
    return t.groupBy("lang", F.lower("surface").alias("token")).agg(F.count("*").alias("n"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, token, n, rank): the tokens of each language by falling count, then by token.

    Both steps are written: a plan with an explode in it that is joined with
    itself shares no exchange, so each use would read and cut all texts again.
    """
    return settled(ranked(settled(counted(spark, sf_dir)), ["lang"]))


#: The same tables in SQL, as common table expressions.
ANSWERS = """e AS (SELECT user_id AS learner, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS item, event_type <> 'error' AS ok,
  CASE event_type WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'recall' WHEN 'click' THEN 'hear' WHEN 'view' THEN 'read' WHEN 'error' THEN 'type' END AS kind,
  CAST(ts AS DATE) AS day, ts, event_id, value FROM events),
answers AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY learner ORDER BY day) AS INT) AS session FROM e)"""

SENTENCES = """sentences AS (SELECT lang, doc_id, source, sent, trim(text) AS text FROM (
  SELECT lang, doc_id, source, unnest(range(len(a))) AS sent, unnest(a) AS text FROM (
    SELECT lang, doc_id, source, regexp_split_to_array(text, '[.!?\\n]') AS a FROM documents)) WHERE trim(text) <> '')"""

TOKENS = SENTENCES + """,
tokens AS (SELECT lang, doc_id, source, sent, pos, surface, lower(surface) AS token FROM (
  SELECT lang, doc_id, source, sent, unnest(range(len(a))) AS pos, unnest(a) AS surface FROM (
    SELECT *, regexp_extract_all(text, '\\p{L}+') AS a FROM sentences)))"""

WORDS = TOKENS + """,
words AS (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM (
  SELECT lang, token, count(*) AS n FROM tokens GROUP BY lang, token))"""
