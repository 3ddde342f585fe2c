"""Readers of public corpora and of packs: tab-separated sentences and links, lexicon lines, frequency lists, JSON tables and stored progress.

All of them are declared with Spark's readers, so that compressed files are
split where the codec allows it, filters come before parsing, and faulty lines
don't end the job: the readers leave them out, `rejected` tells which and why,
and `progress` gives them beside the good ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences under which recordings may be used.
PERMISSIVE_AUDIO = ("CC BY 4.0", "CC BY-SA 4.0", "CC BY 2.0 FR", "CC0 1.0", "Public domain")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block) of each line of text files, with its file and where in it the part begins that was read with it; compressed ones by their names."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def rejected(lines: DataFrame, columns: int, numbers: tuple[int, ...] = (), filled: tuple[int, ...] = ()) -> DataFrame:
    """(value, reason) of tab-separated lines that are no row: too few fields, a field that must be a number is none, or one that must be filled is empty."""
    parts = F.split("value", "\t")
    number = F.lit(False)
    for k in numbers:
        number = number | ~F.coalesce(F.get(parts, F.lit(k)).rlike("^[0-9]+$"), F.lit(False))
    empty = F.lit(False)
    for k in filled:
        empty = empty | (F.coalesce(F.get(parts, F.lit(k)), F.lit("")) == "")
    reason = F.when(F.size(parts) < columns, "fields").when(number, "number").when(empty, "empty")
    return lines.select("value", reason.alias("reason")).filter("reason IS NOT NULL")


def _tsv(lines: DataFrame, *columns: str) -> DataFrame:
    """Fields between tabs, as they stand (no quoting); missing ones are null."""
    parts = F.split("value", "\t")
    return lines.select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def sentences(lines: DataFrame, lang: str) -> DataFrame:
    """(id, text, user) of one language from lines id, language, text, user; those without a number, a text or the language go."""
    t = _tsv(lines, "id", "lang", "text", "user")
    t = t.filter((F.col("lang") == lang) & (F.col("text") != ""))
    return t.select(F.expr("try_cast(id AS bigint)").alias("id"), "text", "user").filter("id IS NOT NULL")


def links(lines: DataFrame) -> DataFrame:
    """(left_id, right_id) from lines of two ids; other lines are left out."""
    t = _tsv(lines, "a", "b")
    return t.select(F.expr("try_cast(a AS bigint)").alias("left_id"), F.expr("try_cast(b AS bigint)").alias("right_id")).dropna()


def audio(lines: DataFrame, licences: tuple[str, ...] = PERMISSIVE_AUDIO) -> DataFrame:
    """(id, clip, user, licence): recordings with number ids and a permissive licence."""
    t = _tsv(lines, "id", "clip", "user", "licence")
    return t.filter(F.col("id").rlike("^[0-9]+$") & F.col("clip").rlike("^[0-9]+$") & F.col("licence").isin(*licences)).withColumns({c: F.col(c).cast("long") for c in ("id", "clip")})


LEXICON = "word string, lang_code string, pos string, senses array<struct<glosses: array<string>, tags: array<string>, form_of: array<struct<word: string>>>>"


def lexicon(lines: DataFrame, lang: str) -> DataFrame:
    """Entries of one language from JSON lines. Lines without the language's code are dropped before any is parsed."""
    some = lines.filter(F.col("value").contains(f'"{lang}"'))
    return some.select(F.from_json("value", LEXICON).alias("e")).select("e.*").filter(F.col("lang_code") == lang)


def subtitle_list(lines: DataFrame, fold=F.lower, pattern: str = r"^\p{L}+$", most: int | None = 100_000) -> DataFrame:
    """(token, n) from lines `surface count`: the first `most` distinct surfaces in the order of the file (None: all), counts of equal folds added up.

    Only what stands up to the line of the last new surface counts. The order is
    that of the files' names and of the bytes in them, where lines carry these
    (see lines), however Spark deals the files to tasks; no task sorts the whole list.
    """
    place = [F.col(c) for c in ("file", "block") if c in lines.columns]
    t = lines.withColumn("at", F.struct(*place, F.monotonically_increasing_id().alias("line")))
    parts = F.split("value", " ")
    t = t.select("at", fold(parts[0]).alias("token"), F.expr("try_cast(split(value, ' ')[1] AS bigint)").alias("n"), parts[0].rlike(pattern).alias("ok")).filter("ok AND n IS NOT NULL")
    if most is None:
        return t.groupBy("token").agg(F.sum("n").alias("n"))
    first = t.groupBy("token").agg(F.min("at").alias("at"))
    last = first.orderBy("at").limit(most).agg(F.max("at").alias("last"))
    return t.crossJoin(F.broadcast(last)).filter(F.col("at") <= F.col("last")).groupBy("token").agg(F.sum("n").alias("n"))  # one row


def zipf_list(words: DataFrame, fold=F.lower) -> DataFrame:
    """(token, n) from (word, zipf): ten to the zipf value, equal folds added up."""
    return words.groupBy(fold(F.col("word")).alias("token")).agg(F.sum(F.pow(F.lit(10.0), "zipf")).alias("n"))


def table_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that holds one array of rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def js_constant(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of `const <name> = [ … ];` in a script."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    return whole.select(F.inline(F.from_json(body, f"array<struct<{schema}>>")))


PROGRESS = "v int, w map<string, struct<r: int, w: int, s: int, k: string, t: string, u: int>>, sets map<string, int>, theme string"


def progress(documents: DataFrame, schema: str = PROGRESS) -> tuple[DataFrame, DataFrame]:
    """(valid progress documents, quarantined ones with their raw text and the reason) from (learner, raw)."""
    p = documents.withColumn("p", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    records: Column = F.map_values(F.coalesce(F.col("p.w"), F.create_map().cast("map<string,struct<r:int,w:int,s:int,k:string,t:string,u:int>>")))
    broken = F.exists(records, lambda r: (r["r"] < 0) | (r["w"] < 0) | (r["s"] < 0) | r["r"].isNull() | r["w"].isNull() | r["s"].isNull())
    reason = F.when(F.col("p").isNull() | F.col("p.v").isNull(), "unreadable").when(broken, "record")
    p = p.withColumn("reason", reason)
    return p.filter("reason IS NULL").select("learner", "p.*"), p.filter("reason IS NOT NULL").select("learner", "raw", "reason")
