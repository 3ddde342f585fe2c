r"""Chat formatting by event-sourced reconstruction.

A log of events is dealt to tasks by conversation, sorted by sequence number
and folded into final messages, which a template renders. DataFrame code only;
one exchange of the log serves the fold, the spans and the rendering.

Events: (conv_id, seq, msg, kind, role, text). msg says which message of the
conversation an event belongs to; messages stand in the order of msg. Kinds:
`message` and `edit` set the message's text (and role, if not null),
`regenerate` drops the text so far, and `delta` appends a streamed piece.

Template: `### <role>: <text></turn>\n` for each turn. In texts and roles `\`
becomes `\b`, `#` becomes `\h` and `<` becomes `\l` (in roles also `:` becomes
`\c`), so that neither marker can occur inside one and the escape is undone
exactly.

Defined results: null texts, roles and kinds count as empty text, empty role
and `message`; null conv_ids form one conversation; a null turn sorts first;
repeated rows are separate turns, ties of turn going by role, then text. An
empty table gives an empty result. A conversation is one row of the result and
so is bounded by what one row may hold (2 GB). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import let, table

END = "</turn>\n"
_PAIRS = (("#", "\\h"), ("<", "\\l"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for raw, safe in (*_PAIRS, *([(":", "\\c")] if role else [])):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    """Each `\\` starts a pair, so the pairs can be replaced one kind after another, the backslash last."""
    for raw, safe in (*_PAIRS, *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """One row (conv_id, msg, role, text) for each message of the log, after all its events."""
    e = events.select(
        "conv_id", "msg", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).repartition("conv_id")
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))

    def final(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when(x["kind"] != "delta", i)), lambda i: i.isNotNull())
        first = F.coalesce(F.element_at(starts, -1), F.lit(0))
        return let(first, lambda f: F.array_join(F.transform(F.filter(a, lambda x, i: (i >= f) & (x["kind"] != "regenerate")), lambda x: x["text"]), ""))

    roles = lambda a: F.filter(F.transform(a, lambda x: x["role"]), lambda x: x.isNotNull())
    made = e.groupBy("conv_id", "msg").agg(log.alias("log"))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(""))
    return made.select("conv_id", "msg", let(roles(F.col("log")), last).alias("role"), let(F.col("log"), final).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row (conv_id, formatted, loss_spans) for each conversation.

    loss_spans: array of (start, length) in code points of formatted, the
    escaped text of each assistant turn.
    """
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    m = messages.select("conv_id", "msg", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("n", F.length("head") + F.length("body") + len(END))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("msg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("start", before + F.length("head"))
    turns = F.sort_array(F.collect_list(F.struct("msg", "role", "start", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("body").cast("long").alias("length"))))
    return m.groupBy("conv_id").agg(turns.alias("t")).select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, ": ")
        return F.struct(unescape(p.substr(F.lit(5), cut - 5), True).alias("role"), unescape(p.substr(cut + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def events_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log that folds back into them.

    A hash of the turn says how it came about: streamed in two deltas;
    streamed wrongly, regenerated and streamed again; or written as a draft
    that an edit replaces by the first half, to which a delta adds the rest.
    """
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = r.withColumn("msg", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))
    half = F.ceil(F.length("text") / 2).cast("int")
    one, two, wrong = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text")), F.reverse("text")
    none = F.lit(None).cast("string")

    def log(*events: tuple) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("kind"), ro.alias("role"), t.alias("text")) for k, ro, t in events])

    opened, streamed = ("message", F.col("role"), F.lit("")), (("delta", none, one), ("delta", none, two))
    again = log(opened, ("delta", none, wrong), ("delta", none, F.lit(" ...")), ("regenerate", none, none), *streamed)
    edited = log(("message", F.lit("draft"), wrong), ("edit", F.col("role"), one), streamed[1])
    how = F.pmod(F.xxhash64("conv_id", "msg", "role"), F.lit(3))
    steps = F.when(how == 0, log(opened, *streamed)).when(how == 1, again).otherwise(edited)
    return r.select("conv_id", "msg", F.posexplode(steps).alias("i", "e")).select("conv_id", "msg", (F.col("msg") * 8 + F.col("i")).alias("seq"), "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = render(fold(events_of(rows)))
    out = out.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  length(regexp_replace(text, '[\\#<]', '..', 'g')) AS body, length(regexp_replace(role, '[\\#<:]', '..', 'g')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""
