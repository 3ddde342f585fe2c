"""Queries over inflected forms, meaning keys and synonyms, readings, spans and archives, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.functions import combinations as K
from glosswork.functions import glosses as G
from glosswork.functions import meanings as M
from glosswork.functions import paradigms, spans
from glosswork.functions import readings as D
from glosswork.functions.language import LANGUAGES
from glosswork.operators import linking as L
from glosswork.operators import meanings as N
from glosswork.operators import glyphs, names, planners, sessions
from glosswork.operators import relations as R
from glosswork.operators import segments as Y
from glosswork.operators import state as S
from glosswork.operators import units as U
from glosswork.operators.settle import dealt, settled
from glosswork.sources import archives as A
from glosswork.sources import tables as T
from glosswork.sources.tables import ANSWERS, SENTENCES, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules() -> str:
    """The paradigms of the corpus's languages as rows (lang, pos, slot, prio, rx, cut, before, twice, after)."""
    out = []
    for lang, spec in LANGUAGES.items():
        for prio, r in enumerate(spec.paradigm):
            for e in r.endings:
                before, _, after = e.rpartition("+")
                twice = after.startswith("=")
                out.append(f"({_text(lang)}, {_text(r.pos)}, {_text(r.slot)}, {prio}, {_text(r.when)}, {r.cut}, {_text(before)}, {str(twice).lower()}, {_text('' if after == '-' else after.removeprefix('='))})")
    return ", ".join(out)


_IRREGULAR = ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)}, {_text(s)}, {_text(f)})" for a, b, c, s, some in paradigms.IRREGULAR for f in some.split())
#: Words of the pack, whose forms link text.
PACK = 2000
_FORMS = f"""{WORDS},
lemmas AS (SELECT lang, token AS lemma, n FROM words WHERE rank <= {PACK}),
rules(lang, pos, slot, prio, rx, cut, before, twice, after) AS (VALUES {_rules()}),
own(lang, lemma, pos, slot, form) AS (VALUES {_IRREGULAR}),
regular AS (SELECT * FROM (SELECT l.lang, lemma, pos, slot, prio, before || left(lemma, length(lemma) - cut) || CASE WHEN twice THEN right(left(lemma, length(lemma) - cut), 1) ELSE '' END || after AS form
  FROM lemmas l JOIN rules r ON r.lang = l.lang AND regexp_matches(lemma, rx) AND length(lemma) > cut) QUALIFY prio = min(prio) OVER (PARTITION BY lang, lemma, pos, slot)),
forms AS (SELECT lang, lemma, pos, slot, form FROM regular ANTI JOIN own USING (lang, lemma, pos, slot) UNION SELECT own.* FROM own JOIN lemmas USING (lang, lemma))"""


def _forms(spark, d):
    """(words, pack, forms): the tokens' counts, the pack's words and all their forms."""
    words = T.words(spark, d)
    pack = words.filter(F.col("rank") <= PACK).select("lang", F.col("token").alias("lemma"), "n")
    named = pack.withColumn("pos", F.lit(None).cast("string"))
    return words, pack, paradigms.forms(named, {k: s.paradigm for k, s in LANGUAGES.items()}, paradigms.irregular(spark))


@query("q154_inflected_forms", "WITH " + _FORMS + """
SELECT f.lang, lemma, pos, slot, form, w.n FROM forms f JOIN words w ON w.lang = f.lang AND w.token = form""")
def q154(spark, d):
    """The forms of the pack's words that stand in the corpus, with their counts."""
    words, _, made = _forms(spark, d)
    return made.join(words.select("lang", F.col("token").alias("form"), "n"), ["lang", "form"]).select("lang", "lemma", "pos", "slot", "form", "n")


_RESOLVED = _FORMS + """,
c AS (SELECT w.lang, token AS surface, lemma, l.n, 0 AS p FROM words w JOIN lemmas l ON l.lang = w.lang AND lemma = token
  UNION SELECT f.lang, form, lemma, l.n, 1 FROM forms f JOIN lemmas l USING (lang, lemma) JOIN words w ON w.lang = f.lang AND w.token = form WHERE form <> lemma),
resolved AS (SELECT lang, surface, lemma, CASE p WHEN 0 THEN 'entry' ELSE 'form' END AS how FROM c QUALIFY row_number() OVER (PARTITION BY lang, surface ORDER BY p, n DESC, lemma) = 1)"""


def _resolved(spark, d):
    words, pack, made = _forms(spark, d)
    return words, L.resolve(words.select("lang", F.col("token").alias("surface")), pack, paradigms.edges(made), ("lang",))


@query("q155_form_resolution", "WITH " + _RESOLVED + " SELECT * FROM resolved")
def q155(spark, d):
    """Each surface of the corpus that is a word of the pack or a form of one."""
    return _resolved(spark, d)[1]


@query("q156_form_links", "WITH " + _RESOLVED + """
SELECT doc_id * 100000 + sent AS sentence, count(DISTINCT lemma) AS links, coalesce(bool_or(length(token) > 3 AND lemma IS NULL), false) AS outside
FROM tokens t LEFT JOIN resolved r ON r.lang = t.lang AND r.surface = t.token GROUP BY 1""")
def q156(spark, d):
    """Links of each sentence to words of the pack, inflected ones too; it cannot ship if a long token is neither."""
    _, r = _resolved(spark, d)
    # Sentences are dealt as texts; their tokens stay where they are and look up the pack's forms, a list of bounded length.
    s = T.sentences(spark, d).select("lang", (F.col("doc_id") * 100000 + F.col("sent")).alias("sentence"), "text").repartition("sentence")
    t = s.select("lang", "sentence", F.explode_outer(T.words_of(F.col("text"))).alias("surface")).filter("surface IS NOT NULL").withColumn("surface", F.lower("surface"))
    x = t.join(F.broadcast(r.select("lang", "surface", "lemma")), ["lang", "surface"], "left")
    outside = (F.length("surface") > 3) & F.col("lemma").isNull()
    x = x.groupBy("sentence", "lemma").agg(F.coalesce(F.bool_or(outside), F.lit(False)).alias("outside"))
    return x.groupBy("sentence").agg(F.count("lemma").alias("links"), F.bool_or("outside").alias("outside"))


@query("q157_form_gain", "WITH " + _RESOLVED + """
SELECT t.lang, count(*) AS tokens, count(*) FILTER (how = 'entry') AS by_word, count(*) FILTER (how = 'form') AS by_form FROM tokens t LEFT JOIN resolved r ON r.lang = t.lang AND r.surface = t.token GROUP BY 1""")
def q157(spark, d):
    """What forms add to the tokens that are linked, by language."""
    words, r = _resolved(spark, d)
    x = words.join(r.withColumnRenamed("surface", "token"), ["lang", "token"], "left")
    some = lambda how: F.coalesce(F.sum(F.when(F.col("how") == how, F.col("n"))), F.lit(0))
    return x.groupBy("lang").agg(F.sum("n").alias("tokens"), some("entry").alias("by_word"), some("form").alias("by_form"))


# Glosses of parts: alternatives, nested and open groups, reading notes, sides of "or", a copula, more groups than are tried.
_GLOSSES = """glosses AS (SELECT p_partkey AS id, CASE p_partkey % 7
  WHEN 0 THEN 'to ' || p_name || ' (' || p_type || ' (' || p_brand || ')); the ' || split_part(p_name, ' ', 2) || '(s) of age'
  WHEN 1 THEN p_name || ' or ' || lower(p_type) || '; ' || p_type || ' (also pr. [x, y])'
  WHEN 2 THEN '(' || lower(p_type) || ') ' || p_name || ', [' || p_brand || '], a ' || split_part(p_name, ' ', 2)
  WHEN 3 THEN 'to be ' || lower(p_type) || ', to…; (formal) size ' || CAST(p_size AS VARCHAR)
  WHEN 4 THEN p_name || ' (open ' || p_brand
  WHEN 5 THEN replace(p_name, ' ', '') || '; café ' || lower(p_type) || ' (b; c) (d) (e) (f) (g' || CAST(p_size % 3 AS VARCHAR) || ')'
  ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ', ' || lower(p_type) END AS gloss FROM part)"""


def _glosses(spark, d):
    p = T.read(spark, d, "part")
    k, low, size = F.col("p_partkey"), F.lower("p_type"), F.col("p_size")
    one, two = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    join = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    g = (
        F.when(k % 7 == 0, join("to ", name, " (", kind, " (", brand, ")); the ", two, "(s) of age"))
        .when(k % 7 == 1, join(name, " or ", low, "; ", kind, " (also pr. [x, y])"))
        .when(k % 7 == 2, join("(", low, ") ", name, ", [", brand, "], a ", two))
        .when(k % 7 == 3, join("to be ", low, ", to…; (formal) size ", size.cast("string")))
        .when(k % 7 == 4, join(name, " (open ", brand))
        .when(k % 7 == 5, join(F.replace(name, F.lit(" "), F.lit("")), "; café ", low, " (b; c) (d) (e) (f) (g", (size % 3).cast("string"), ")"))
        .otherwise(join(one, " ", two, ", ", low))
    )
    return p.select(k.alias("id"), g.alias("gloss"))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _sql_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents({x})), '[.''‘’ʼ`]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _key_steps(name: str, source: str, cols: str) -> str:
    """CTEs that add the key k of the column v of a table."""
    return f"""{name}_w AS (SELECT {cols}, v, {_sql_words('v')} AS w FROM {source}),
{name}_d AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_list(M.DROPPED)}, x)) AS dw FROM {name}_w),
{name}_k AS (SELECT *, CASE WHEN len(dw) > 0 THEN dw ELSE w END AS kw FROM {name}_d),
{name} AS (SELECT {cols}, v, array_to_string(CASE WHEN len(kw) > 1 AND kw[1] = 'to' THEN kw[2:] ELSE kw END, chr(1)) AS k FROM {name}_k)"""


def _depth(by: str) -> str:
    """Brackets' depth at each character: the running sum, less its least value so far where that is below zero."""
    return f"s - least(0, min(s) OVER (PARTITION BY {by} ORDER BY i ROWS UNBOUNDED PRECEDING))"


def _keys_sql(source: str, out: str, most: int | None = M.MOST_GROUPS) -> str:
    r"""CTEs to (id, key) of a table (id, gloss): characters as rows, depths as running sums, masks of groups as rows; most: as in M.variants."""
    p, tried = out + "_", "groups" if most is None else f"least(groups, {most})"
    up = lambda o, c: f"sum(CASE WHEN c IN ({o}) THEN 1 WHEN c IN ({c}) THEN -1 ELSE 0 END)"
    note = lambda x: f"regexp_matches(trim({x}), {_text(M.READING_NOTE)})"
    return rf"""{p}c AS (SELECT id, unnest(string_split(gloss, '')) AS c, unnest(range(length(gloss))) AS i FROM {source}),
{p}s AS (SELECT *, {up("'(', '['", "')', ']'")} OVER (PARTITION BY id ORDER BY i) AS s FROM {p}c),
{p}e AS (SELECT *, {_depth('id')} AS depth FROM {p}s),
{p}f AS (SELECT *, depth = 0 AND c IN (';', ',') AS sep, sum(CASE WHEN depth = 0 AND c IN (';', ',') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS a FROM {p}e),
{p}raw AS (SELECT id, a, string_agg(c, '' ORDER BY i) AS raw FROM {p}f WHERE NOT sep GROUP BY id, a),
{p}h AS (SELECT id, a, c, i, {up("'('", "')'")} OVER (PARTITION BY id, a ORDER BY i) AS s FROM {p}f SEMI JOIN (SELECT id, a FROM {p}raw WHERE NOT {note('raw')} AND trim(raw) <> '') USING (id, a) WHERE NOT sep),
{p}j AS (SELECT *, {_depth('id, a')} AS depth FROM {p}h),
{p}l AS (SELECT *, depth > 0 OR (c = ')' AND lag(depth, 1, 0) OVER w > 0) AS g, max(CASE WHEN depth = 0 THEN i END) OVER (PARTITION BY id, a) AS last, depth = 1 AND c = '(' AND lag(depth, 1, 0) OVER w = 0 AS opens FROM {p}j WINDOW w AS (PARTITION BY id, a ORDER BY i)),
{p}m AS (SELECT *, sum(CASE WHEN opens THEN 2 ELSE 0 END) OVER (PARTITION BY id, a ORDER BY i) + CASE WHEN g THEN 0 ELSE 1 END AS n FROM {p}l),
{p}p AS (SELECT id, a, n, string_agg(c, '' ORDER BY i) AS t, bool_and(g AND i <= coalesce(last, -1)) AS g FROM {p}m GROUP BY id, a, n),
{p}q AS (SELECT * FROM {p}p WHERE NOT (g AND {note('t')})),
{p}alt AS (SELECT id, a, string_agg(t, '' ORDER BY n) AS alt, coalesce(string_agg(t, '' ORDER BY n) FILTER (NOT g), '') AS rest FROM {p}q GROUP BY id, a),
{p}ok AS (SELECT * FROM {p}alt WHERE NOT (regexp_matches(alt, '(…|\.\.\.)\s*$') AND len(list_filter({_sql_words('rest')}, lambda x: NOT list_contains({_list(M.FUNCTION_WORDS)}, x))) = 0)),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY id, a, g ORDER BY n) - 1 AS gi, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY id, a) AS groups, NOT regexp_matches(coalesce(lag(t) OVER (PARTITION BY id, a ORDER BY n), ' '), '\s$') AS glued FROM {p}q SEMI JOIN {p}ok USING (id, a)),
{p}t AS (SELECT *, unnest(range(1 << CAST({tried} AS INT))) AS mask FROM {p}r),
{p}v AS (SELECT id, a, string_agg(CASE WHEN NOT g THEN t WHEN gi >= {tried} OR (mask >> CAST(gi AS INT)) & 1 = 1 THEN CASE WHEN glued THEN '' ELSE ' ' END || t[2:-2] || ' ' ELSE ' ' END, '' ORDER BY n) AS v FROM {p}t GROUP BY id, a, mask),
{p}o AS (SELECT id, string_split(alt, ' or ') AS x FROM {p}ok WHERE contains(alt, ' or ')),
{p}all AS (SELECT id, v FROM {p}v UNION SELECT id, x[1] FROM {p}o WHERE len({_sql_words('x[2]')}) = 1 AND len(x) = 2),
{_key_steps(p + 'keyed', p + 'all', 'id')},
{out} AS (SELECT DISTINCT id, k AS key FROM {p}keyed WHERE k <> '' AND NOT (regexp_full_match(k, '\p{{L}}') AND lower(trim(v)) <> k))"""


@query("q158_meaning_keys", "WITH " + _GLOSSES + ",\n" + _keys_sql("glosses", "keys") + " SELECT id, key FROM keys")
def q158(spark, d):
    """The keys of every gloss; the left sides of "or" hold no group here."""
    return N.keyed(_glosses(spark, d))


_TYPED = """answers AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS answer, l_partkey AS id, CASE l_linenumber % 4 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN upper(p_type) || '; the ' || p_name
  WHEN 2 THEN p_name || ' ' || lower(p_type) ELSE 'size ' || CAST(p_size AS VARCHAR) END AS typed FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("q159_typed_meanings", "WITH " + _GLOSSES + ",\n" + _keys_sql("glosses", "keys") + ",\n" + _TYPED + f""",
one AS (SELECT replace(key, chr(1), '') AS one, any_value(key) AS key FROM (SELECT DISTINCT key FROM keys) GROUP BY 1 HAVING count(*) = 1),
tp AS (SELECT answer, id, typed AS v, true AS whole FROM answers UNION ALL SELECT answer, id, unnest(string_split(replace(typed, ',', ';'), ';')), false FROM answers),
{_key_steps('tk', 'tp', 'answer, id, whole')},
gw AS (SELECT id, gloss AS v FROM glosses),
{_key_steps('gk', 'gw', 'id')},
h AS (SELECT t.answer, t.id, t.whole, t.k, keys.key IS NOT NULL AS own, keys.key IS NOT NULL OR n.key IS NOT NULL AS near, t.k <> '' AND t.k = gk.k AS full
  FROM tk t LEFT JOIN keys ON keys.id = t.id AND keys.key = t.k LEFT JOIN one ON one.one = replace(t.k, chr(1), '') LEFT JOIN keys n ON n.id = t.id AND n.key = one.key LEFT JOIN gk ON gk.id = t.id)
SELECT a.answer, a.id, a.typed, coalesce(bool_or(h.whole AND (own OR h.full)) OR (count(*) FILTER (NOT h.whole AND k <> '') > 0 AND bool_and(near) FILTER (NOT h.whole AND k <> '')), false) AS right
FROM answers a JOIN h USING (answer, id) GROUP BY ALL""")
def q159(spark, d):
    """Typed answers, one a line item, against the glosses of their words."""
    x = T.read(spark, d, "lineitem").join(dealt(T.read(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")), "l_partkey")
    n = F.col("l_linenumber") % 4
    typed = F.when(n == 0, F.replace("p_name", F.lit(" "), F.lit(""))).when(n == 1, F.concat(F.upper("p_type"), F.lit("; the "), "p_name")).when(n == 2, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string")))
    answers = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer"), F.col("l_partkey").alias("id"), typed.alias("typed")).distinct()
    return N.typed_right(answers, _glosses(spark, d))


def _directions_sql(most: int | None) -> str:
    return "WITH " + _GLOSSES + ",\n" + _keys_sql("glosses", "keys", most) + f""",
bare AS (SELECT id, regexp_replace(gloss, {_text(N.REGISTER)}, ' ', 'g') AS gloss FROM glosses),
""" + _keys_sql("bare", "answers", most) + """,
firsts AS (SELECT id, arg_min(raw, a) AS gloss FROM (SELECT id, a, raw FROM keys_raw SEMI JOIN keys_alt USING (id, a)) GROUP BY id),
""" + _keys_sql("firsts", "asks", most) + """,
groups AS (SELECT p_partkey AS id, 'group ' || CAST(p_partkey // 50 AS VARCHAR) AS meaning FROM part WHERE p_partkey % 50 IN (3, 17)),
blocked AS (SELECT DISTINCT p_partkey AS id, p_partkey + 7 AS other FROM part WHERE p_partkey % 11 = 0),
x AS (SELECT 'asks' AS kind, key AS meaning, id FROM asks UNION SELECT 'answers', key, id FROM answers UNION SELECT 'asks', meaning, id FROM groups UNION SELECT 'answers', meaning, id FROM groups),
met AS (SELECT meaning FROM (SELECT meaning, count(DISTINCT id) FILTER (kind = 'asks') AS a, count(DISTINCT id) FILTER (kind = 'answers') AS c, count(DISTINCT id) AS n FROM x GROUP BY meaning) WHERE a > 0 AND c > 0 AND n > 1),
links AS (SELECT kind, meaning, id, CAST(NULL AS BIGINT) AS other FROM x SEMI JOIN met USING (meaning)
UNION ALL SELECT 'syn', key, id, NULL FROM keys SEMI JOIN (SELECT key FROM keys GROUP BY key HAVING count(*) > 1) USING (key)
UNION ALL SELECT 'blocked', '', id, other FROM blocked)"""


def _links(spark, d, most):
    k = F.col("id")
    ids = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    blocked = ids.filter(k % 11 == 0).select("id", (k + 7).alias("other"))
    reviewed = ids.filter((k % 50).isin(3, 17)).select(F.floor(k / 50).alias("grp"), "id")
    return N.directions(_glosses(spark, d), blocked, reviewed, most)


@query("q160_synonym_directions", _directions_sql(None) + " SELECT * FROM links")
def q160(spark, d):
    """Which words may be typed for which, as memberships in meanings, with reviewed groups and blocked pairs."""
    return _links(spark, d, None)


@query("q161_accepted_synonyms", _directions_sql(M.MOST_GROUPS) + """,
pairs AS (SELECT DISTINCT l_partkey AS t, l_partkey + 7 * l_linenumber AS x FROM lineitem),
d AS (SELECT DISTINCT a.id AS t, b.id AS x FROM (SELECT * FROM links WHERE kind = 'asks') a JOIN (SELECT * FROM links WHERE kind = 'answers') b USING (meaning) WHERE a.id <> b.id EXCEPT SELECT id, other FROM links WHERE kind = 'blocked'),
s AS (SELECT DISTINCT a.id AS t, b.id AS x FROM (SELECT * FROM links WHERE kind = 'syn') a JOIN (SELECT * FROM links WHERE kind = 'syn') b USING (meaning) WHERE a.id <> b.id UNION SELECT t, x FROM d UNION SELECT x, t FROM d)
SELECT p.t, p.x, d.t IS NOT NULL AS typed, s.t IS NOT NULL AS syn FROM pairs p LEFT JOIN d ON d.t = p.t AND d.x = p.x LEFT JOIN s ON s.t = p.t AND s.x = p.x""")
def q161(spark, d):
    """Words typed for others, one pair a line item, looked up in the directions."""
    pairs = T.read(spark, d, "lineitem").select(F.col("l_partkey").alias("t"), (F.col("l_partkey") + 7 * F.col("l_linenumber")).alias("x")).distinct()
    return N.accepted(pairs, _links(spark, d, M.MOST_GROUPS))


@query("q162_gloss_clean_rules", """
WITH b AS (SELECT p_partkey AS id, p_name AS n, lower(p_type) AS t, p_brand AS b FROM part)
SELECT id, CASE id % 8
  WHEN 0 THEN 'transitive, to ' || n || '. more ' || t WHEN 1 THEN 'relating to ' || t || ': ' || n WHEN 2 THEN 'here ' || n || '! there!' WHEN 3 THEN n || ', female equivalent of ' || t
  WHEN 4 THEN 'the need for a ' || t WHEN 5 THEN 'figuratively, (of ' || t || ') colloquial, the ' || n || ' (' || b || ')' WHEN 6 THEN 'home; ' || n ELSE 'an ' || n || ', see ' || t || ', the ' || t || ' etc.' END AS raw,
  CASE id % 8
  WHEN 0 THEN 'more ' || t WHEN 1 THEN n WHEN 2 THEN 'here ' || n || '!, there!' WHEN 3 THEN n
  WHEN 4 THEN t WHEN 5 THEN n WHEN 6 THEN 'home' ELSE n || ', ' || t END AS gloss FROM b""")
def q162(spark, d):
    """Labels, sentences, definitions, marks, notes and senses of glosses; the SQL states the results."""
    k, n, t = F.col("p_partkey"), F.col("p_name"), F.lower("p_type")
    join = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    raw = F.when(k % 8 == 0, join("transitive, to ", n, ". more ", t)).when(k % 8 == 1, join("relating to ", t, ": ", n)).when(k % 8 == 2, join("here ", n, "! there!")).when(k % 8 == 3, join(n, ", female equivalent of ", t))
    raw = raw.when(k % 8 == 4, join("the need for a ", t)).when(k % 8 == 5, join("figuratively, (of ", t, ") colloquial, the ", n, " (", F.col("p_brand"), ")")).when(k % 8 == 6, join("home; ", n)).otherwise(join("an ", n, ", see ", t, ", the ", t, " etc."))
    x = T.read(spark, d, "part").select(k.alias("id"), raw.alias("raw"))
    return x.withColumn("gloss", G.clean(F.col("raw")))


@query("q163_meaning_cover", "WITH " + _GLOSSES + ",\n" + _keys_sql("glosses", "keys") + f""",
alts AS (SELECT id, translate(alt, '()', '  ') AS v FROM keys_alt),
{_key_steps('shown', 'alts', 'id')},
n AS (SELECT DISTINCT id, k AS value FROM shown WHERE k <> ''),
ho AS (SELECT id, min(id) OVER (PARTITION BY v) AS class FROM (SELECT id, string_agg(key, ',' ORDER BY key) AS v FROM keys GROUP BY id)),
nt AS (SELECT id, size, min(id) OVER (PARTITION BY v) AS class FROM (SELECT id, string_agg(value, ',' ORDER BY value) AS v, count(*) AS size FROM n GROUP BY id)),
x AS (SELECT keys.id, key AS value FROM keys SEMI JOIN (SELECT id FROM ho WHERE id = class) k ON k.id = keys.id), y AS (SELECT n.*, size FROM n JOIN nt ON nt.id = n.id WHERE n.id = class)
SELECT 'pair' AS kind, x.id AS a, y.id AS b FROM x JOIN y USING (value) GROUP BY x.id, y.id, size HAVING count(*) = size
UNION ALL SELECT 'owner', id, class FROM ho UNION ALL SELECT 'target', id, class FROM nt""")
def q163(spark, d):
    """Which words have every shown alternative of which others among their keys, by classes."""
    g = _glosses(spark, d)
    have = N.keyed(g).select(F.col("id").alias("owner"), F.col("key").alias("value"))
    need = N.told_once(g, "gloss", shown=M.bare_keys(F.col("gloss"))).select(F.col("id").alias("target"), F.explode_outer("shown").alias("value")).filter("value IS NOT NULL")
    return R.covers(have, need)


@query("q164_distractors_two_passes", """
WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN p_brand ELSE 'all' END AS brand, p_type || CAST(p_size % 10 AS VARCHAR) AS grp, p_name, md5(CAST(p_partkey AS VARCHAR)) AS ok FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ok, id) AS i, count(*) OVER (PARTITION BY grp) AS size FROM x),
a AS (SELECT *, unnest(range(1, size)) AS j FROM i),
c AS (SELECT a.id, a.j, b.id AS other, a.brand <> b.brand AS strict FROM a JOIN i b ON b.grp = a.grp AND b.i = (a.i + a.j - 1) % a.size + 1 WHERE a.p_name <> b.p_name),
e AS (SELECT id, count(*) FILTER (strict) >= 3 AS enough FROM c GROUP BY id)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY j) AS place, other FROM c JOIN e USING (id) WHERE strict OR NOT enough QUALIFY place <= 3""")
def q164(spark, d):
    """Distractors by name and brand, by name alone where fewer than three are left; nearly all parts share one brand."""
    k = F.col("p_partkey")
    p = T.read(spark, d, "part").select(k.alias("id"), F.when(k % 40 == 0, F.col("p_brand")).otherwise("all").alias("brand"), F.concat("p_type", (F.col("p_size") % 10).cast("string")).alias("grp"), "p_name", F.md5(k.cast("string")).alias("order_key"))
    return R.distractors(p, "grp", ["brand", "p_name"], loose=["p_name"])


@query("q165_token_places", "WITH " + SENTENCES + """,
t AS (SELECT doc_id, sent, unnest(range(len(w))) AS pos, unnest(w) AS surface FROM (SELECT *, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM sentences)),
x AS (SELECT *, pos % 7 = 3 AND length(surface) > 1 AND coalesce(lower(lead(surface) OVER (PARTITION BY doc_id, sent ORDER BY pos)), '') <> lower(surface) AS other FROM t),
c AS (SELECT doc_id, sent, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM sentences),
l AS (SELECT *, regexp_full_match(c, '[\\p{L}\\p{N}]') AS g FROM c),
r AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id, sent ORDER BY i), false) AS starts FROM l),
p AS (SELECT doc_id, sent, n - 1 AS pos, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent ORDER BY i) AS n FROM r) WHERE g GROUP BY ALL)
SELECT x.doc_id, x.sent, CAST(x.pos AS INT) AS pos, CAST(CASE WHEN other THEN -1 ELSE a END AS INT) AS a, CAST(CASE WHEN other THEN -1 ELSE b END AS INT) AS b FROM x JOIN p USING (doc_id, sent, pos)""")
def q165(spark, d):
    """Places of tokens in lower case, of which some are written otherwise than the text, so that those after them are found again."""
    s = T.sentences(spark, d).select("doc_id", "sent", "text").withColumn("w", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), 1))
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    other = lambda x, i: (i % 7 == 3) & (F.length(x) > 1) & (low(F.get("w", i + 1)) != F.lower(x))
    said = F.transform("w", lambda x, i: F.when(other(x, i), F.concat(F.lower(x), F.lit("zz"))).otherwise(F.lower(x)))
    placed = s.select("doc_id", "sent", F.posexplode(spans.token_places()("text", said)).alias("pos", "p"))
    return placed.select("doc_id", "sent", "pos", *[F.coalesce(F.col(f"p.{c}"), F.lit(-1)).alias(c) for c in "ab"])


@query("q166_rotating_subsets", """
WITH RECURSIVE m AS (SELECT unnest(range(0, 10)) AS n),
s AS (SELECT n, CAST([] AS INT[]) AS l FROM m UNION ALL SELECT n, list_append(l, CAST(x AS INT)) FROM s, range(0, 10) r(x) WHERE x < n AND x > coalesce(l[-1], -1) AND len(l) < 4),
c AS (SELECT n, len(l) AS k, l, row_number() OVER (PARTITION BY n, len(l) ORDER BY l) - 1 AS number, count(*) OVER (PARTITION BY n, len(l)) AS total FROM s),
v AS (SELECT p_partkey AS id, p_size % 10 AS n, p_partkey % 5 AS k FROM part),
t AS (SELECT DISTINCT n, k, total, CASE WHEN total % 7 <> 0 THEN 7 WHEN total % 11 <> 0 THEN 11 WHEN total % 13 <> 0 THEN 13 WHEN total % 17 <> 0 THEN 17 WHEN total % 5 <> 0 THEN 5 WHEN total % 3 <> 0 THEN 3 ELSE 1 END AS stride FROM c)
SELECT v.id, v.n, v.k, array_to_string(c.l, ',') AS subset FROM v LEFT JOIN t ON t.n = v.n AND t.k = v.k LEFT JOIN c ON c.n = v.n AND c.k = v.k AND c.number = (v.id * stride) % t.total""")
def q166(spark, d):
    """The subset of a visit, for lists and subsets of many sizes; none where the list is too short."""
    k = F.col("p_partkey")
    x = T.read(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 10).alias("n"), (k % 5).alias("k"))
    return x.withColumn("subset", F.array_join(K.rotating(F.col("id"), F.col("n"), F.col("k")).cast("array<string>"), ","))


_INVENTORY = """inventory AS (SELECT lang, syllable FROM (SELECT lang, syllable, sum(n) AS n FROM (SELECT lang, unnest([left(token, 1), left(token, 2), left(token, 3)]) AS syllable, n FROM words WHERE length(token) >= 3) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, syllable) <= 60)"""


@query("q167_syllables", "WITH RECURSIVE " + WORDS + ",\n" + _INVENTORY + """,
w AS (SELECT lang, token AS word FROM words WHERE length(token) <= 9),
f AS (SELECT lang, word, 1 AS p, 0 AS cost, CAST([] AS VARCHAR[]) AS parts, CAST([] AS INT[]) AS lens FROM w
  UNION ALL SELECT f.lang, word, p + CAST(length(syllable) AS INT), cost + 1 + CASE WHEN p > 1 AND regexp_matches(syllable, '^[aoe]') THEN 10 ELSE 0 END, list_append(parts, syllable), list_append(lens, -CAST(length(syllable) AS INT))
    FROM f JOIN inventory i ON i.lang = f.lang AND substr(word, p, length(syllable)) = syllable WHERE p <= length(word)),
b AS (SELECT lang, word, parts FROM f WHERE p = length(word) + 1 QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY cost, lens) = 1)
SELECT w.lang, w.word, coalesce(array_to_string(parts, '-'), '') AS parts FROM w LEFT JOIN b USING (lang, word)""")
def q167(spark, d):
    """Words of up to nine letters as syllables of an inventory: the sixty most frequent beginnings of each language."""
    words = T.words(spark, d)
    some = words.filter(F.length("token") >= 3).select("lang", F.explode(F.array(*[F.substring("token", 1, k) for k in (1, 2, 3)])).alias("syllable"), "n")
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "syllable"))
    inventory = some.groupBy("lang", "syllable").agg(F.sum("n").alias("n")).withColumn("i", first).filter("i <= 60")
    x = words.filter(F.length("token") <= 9).select("lang", F.col("token").alias("word"))
    return Y.syllables(x, inventory, ("lang",)).select("lang", "word", F.coalesce(F.array_join("parts", "-"), F.lit("")).alias("parts"))


_DESCRIBED = """described AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 8 THEN '？' WHEN p_partkey % 4 = 0 THEN '⿰ ' || p_partkey // 2 || ' ⿱ ' || p_partkey // 3 || ' ' || p_partkey // 5
  WHEN p_partkey % 4 = 1 THEN '⿲ ' || p_partkey // 3 || ' ' || p_partkey // 4 || ' ' || p_size WHEN p_partkey % 4 = 2 THEN '⿰ ' || p_partkey // 2 ELSE '⿰ ？ ' || p_size END AS d FROM part)"""


@query("q168_components", "WITH RECURSIVE " + _DESCRIBED + """,
parts AS (SELECT DISTINCT CAST(id AS VARCHAR) AS whole, part FROM (SELECT id, unnest(string_split(d, ' ')) AS part FROM described WHERE id % 4 <> 2) WHERE NOT regexp_matches(part, '[⿰⿱⿲？]') AND part <> CAST(id AS VARCHAR)),
reached AS (SELECT whole, part FROM parts UNION SELECT r.whole, p.part FROM reached r JOIN parts p ON p.whole = r.part)
SELECT whole, part AS leaf FROM reached ANTI JOIN (SELECT DISTINCT whole AS part FROM parts) USING (part)""")
def q168(spark, d):
    """What numbers come to when those that describe them, in prefix notation, are taken apart again; descriptions that lack a part count for nothing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    over = lambda n: F.floor(k / n).cast("string")
    join = lambda *x: F.concat_ws(" ", *[v if not isinstance(v, str) else F.lit(v) for v in x])
    told = F.when(k < 8, "？").when(k % 4 == 0, join("⿰", over(2), "⿱", over(3), over(5))).when(k % 4 == 1, join("⿲", over(3), over(4), size.cast("string"))).when(k % 4 == 2, join("⿰", over(2))).otherwise(join("⿰", "？", size.cast("string")))
    return Y.leaves(Y.components(T.read(spark, d, "part").select(k.cast("string").alias("whole"), told.alias("description")), " "))


@query("q169_archive_lines", """
WITH x AS (SELECT lang || '-' || CAST(doc_id % 8 AS VARCHAR) AS path, 'd' || CAST(doc_id AS VARCHAR) || '.txt' AS member, string_split(text, chr(10)) AS t FROM documents WHERE text <> ''),
l AS (SELECT path, member, unnest(t) AS text, unnest(range(len(t))) AS line, len(t) AS n FROM x)
SELECT path, member, CAST(line AS INT) AS line, regexp_replace(text, '\\r$', '') AS text FROM l WHERE NOT (text = '' AND line = n - 1 AND n > 1)""")
def q169(spark, d):
    """The lines of all documents, packed into archives of a file each and read back as members."""
    docs = T.read(spark, d, "documents").filter("text <> ''")
    named = docs.select(F.concat("lang", F.lit("-"), (F.col("doc_id") % 8).cast("string")).alias("archive"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), "text")
    return A.lines(A.unpacked(A.packed_tar(named, "archive", "member", "text"), "d*.txt")).select("path", "member", "line", "text")


_LEVELS = "levels(lv, least, most, coverage) AS (VALUES (0, 20, 60, 0.5::DOUBLE), (1, 40, 120, 0.8::DOUBLE))"


@query("q170_excerpt_runs", "WITH " + WORDS + ",\n" + _LEVELS + """,
p AS (SELECT t.doc_id AS story, sent AS page, lv, count(*) AS words, count(*) FILTER (w.rank <= CASE lv WHEN 0 THEN 600 ELSE 2000 END) AS known FROM tokens t JOIN words w ON w.lang = t.lang AND w.token = t.token, levels GROUP BY ALL),
s AS (SELECT *, sum(words) OVER u AS upto, sum(known) OVER u AS kn FROM p WINDOW u AS (PARTITION BY story, lv ORDER BY page))
SELECT a.story, a.lv, count(*) AS runs FROM s a JOIN s b ON b.story = a.story AND b.lv = a.lv AND b.page >= a.page JOIN levels l ON l.lv = a.lv
WHERE b.upto - a.upto + a.words BETWEEN least AND most AND b.kn - a.kn + a.known >= coverage * (b.upto - a.upto + a.words) GROUP BY ALL""")
def q170(spark, d):
    """Runs of sentences in a document, its pages, that are long enough and known enough for a level."""
    # The words that a level may know are a list of bounded length, which tokens look up in place.
    rank = T.words(spark, d).filter(F.col("rank") <= 2000).select("lang", "token", "rank")
    x = T.tokens(spark, d).filter("lang IS NOT NULL").select("lang", "doc_id", "sent", "token").join(F.broadcast(rank), ["lang", "token"], "left")
    levels = spark.createDataFrame([(0, 20, 60, 0.5), (1, 40, 120, 0.8)], "lv int, least int, most int, coverage double")
    per = x.groupBy(F.col("doc_id").alias("story"), F.col("sent").alias("page")).agg(F.count("*").alias("words"), F.count_if(F.col("rank") <= 600).alias("k0"), F.count_if(F.col("rank") <= 2000).alias("k1"))
    known = F.array(*[F.struct(F.lit(k).alias("lv"), F.col(f"k{k}").alias("known")) for k in (0, 1)])
    pages = per.select("story", "page", "words", F.explode(known).alias("x")).select("story", "page", "words", "x.lv", "x.known")
    return U.excerpt_runs(pages, levels)


@query("q171_placement_sweep", "WITH " + ANSWERS + """,
r AS (SELECT learner, item // 2 AS bucket, count(*) FILTER (ok) * 4 >= count(*) * 3 AS passed FROM answers WHERE kind <> 'read' AND item % 4 < 2 GROUP BY ALL),
l AS (SELECT learner, max(bucket) AS floor FROM r WHERE passed GROUP BY learner),
b AS (SELECT learner, unnest(range(0, floor + 1)) AS bucket FROM l),
s AS (SELECT learner, item // 2 AS bucket, bool_and(ok) AS right FROM answers WHERE kind = 'read' AND item % 5 = 2 GROUP BY ALL)
SELECT b.learner, CAST(b.bucket AS INT) AS bucket, CASE WHEN r.learner IS NOT NULL THEN 'probed' WHEN s.right THEN 'right' WHEN NOT s.right THEN 'missed' ELSE 'open' END AS how
FROM b LEFT JOIN r ON r.learner = b.learner AND r.bucket = b.bucket LEFT JOIN s ON s.learner = b.learner AND s.bucket = b.bucket""")
def q171(spark, d):
    """Buckets below each learner's floor: probed, confirmed by reading items, missed there, or open."""
    a = T.answers(spark, d)
    bucket = F.floor(F.col("item") / 2).cast("int").alias("bucket")
    r = a.filter("kind <> 'read' AND item % 4 < 2").groupBy("learner", bucket).agg((F.count_if("ok") * 4 >= F.count("*") * 3).alias("passed"))
    swept = a.filter("kind = 'read' AND item % 5 = 2").select("learner", bucket, F.col("ok").alias("right"))
    return planners.placement_sweep(r, 5, swept)


@query("q172_name_likeness")
def q172(spark, d):
    """Names of each document against the other words of it: capitalised ones inside sentences, and those in lower case that share their consonants by six tenths."""
    t = T.tokens(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("story"), "surface", "pos")  # English spellings
    told = lambda df, c: df.select("story", c, names.skeleton(F.col(c)).alias("skeleton"))
    name = settled(t.filter((F.col("pos") > 0) & F.col("surface").rlike("^[A-Z][a-z]+$")).select("story", F.col("surface").alias("name")).distinct())
    # Only documents with names are read for words, each word of a text once; no word goes over an end of a sentence.
    named = T.read(spark, d, "documents").filter("lang = 'en'").withColumn("story", F.col("doc_id")).join(name.select("story").distinct(), "story", "left_semi")
    word = named.select("story", F.explode_outer(F.array_distinct(T.words_of(F.col("text")))).alias("token")).filter(F.col("token").rlike("^[a-z]{4,}$"))
    name, word = told(name, "name"), told(word, "token")
    return names.alike(name, word, ["story"])


_WRITTEN = """written AS (SELECT p_partkey AS id, translate(p_name, 'aeioubcdglnrstwmpv ', 'あえいおう木口田日月水火山川石人手目・') AS writing,
  array_to_string(list_transform(string_split(p_name, ''), lambda c: coalesce(map {'a': 'あ', 'e': 'え', 'i': 'い', 'o': 'お', 'u': 'う', 'b': 'もく', 'c': 'く', 'd': 'た', 'g': 'にい', 'l': 'つき', 'n': 'みず', 'r': 'か', 's': 'さあん', 't': 'せん', 'w': 'いし', 'm': 'じん', 'p': 'て', 'v': 'めえ', ' ': 'ん'}[c], c)), '') AS reading FROM part)"""
_SOUNDS = dict(zip("aeioubcdglnrstwmpv ", "あ え い お う もく く た にい つき みず か さあん せん いし じん て めえ ん".split(" "), strict=True))


@query("q173_reading_parts", "WITH RECURSIVE " + _WRITTEN + """,
w AS (SELECT DISTINCT writing, reading, regexp_extract_all(writing, '[ぁ-ゖ]+|[^ぁ-ゖ]+') AS runs FROM written),
f AS (SELECT writing, reading, runs, 0 AS k, 1 AS p, CAST([] AS VARCHAR[]) AS parts FROM w
  UNION ALL SELECT writing, reading, runs, k + 1, p + CAST(n AS INT), list_append(parts, CASE WHEN regexp_matches(runs[k + 1], '^[ぁ-ゖ]') THEN runs[k + 1] ELSE runs[k + 1] || '=' || substr(reading, p, n) END)
  FROM f, range(1, 60) r(n) WHERE k < len(runs) AND p + n - 1 <= length(reading) AND CASE WHEN regexp_matches(runs[k + 1], '^[ぁ-ゖ]') THEN substr(reading, p, n) = runs[k + 1] AND n = length(runs[k + 1]) ELSE true END),
g AS (SELECT writing, reading, count(*) AS ways, any_value(array_to_string(parts, ' ')) AS parts FROM f WHERE k = len(runs) AND p = length(reading) + 1 GROUP BY ALL)
SELECT id, writing, CASE WHEN ways IS NULL THEN 'none' WHEN ways > 1 THEN 'several' ELSE 'one' END AS status, CASE WHEN ways = 1 THEN parts ELSE '' END AS parts FROM written LEFT JOIN g USING (writing, reading)""")
def q173(spark, d):
    """Names in mixed writing with their readings split over it, where there is one way."""
    p = T.read(spark, d, "part")
    sounds = F.create_map(*[F.lit(x) for pair in _SOUNDS.items() for x in pair])
    reading = F.array_join(F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.coalesce(sounds[c], c)), "")
    x = p.select(F.col("p_partkey").alias("id"), F.translate("p_name", "aeioubcdglnrstwmpv ", "あえいおう木口田日月水火山川石人手目・").alias("writing"), reading.alias("reading"))
    # Dealt to all tasks first: names are a small file for the work that they are.
    got = x.repartition("id").withColumn("r", D.split_reading(F.col("writing"), F.col("reading")))
    told = F.transform("r.parts", lambda q: F.when(q["reading"].isNull(), q["text"]).otherwise(F.concat(q["text"], F.lit("="), q["reading"])))
    return got.select("id", "writing", F.col("r.status").alias("status"), F.array_join(told, " ").alias("parts"))


@query("q174_day_plan")
def q174(spark, d):
    """A day's ten items of each learner by all shares; items from six on are words, every third one is held."""
    a = T.answers(spark, d)
    tiers = S.day_tiers(S.answer_fold(a), a).select("learner", "item", "tier")
    seen = a.groupBy("learner", "item").agg(F.max("session").alias("age"), F.count_if(~F.col("ok")).alias("weak"), F.count_distinct("kind").alias("asked"), F.max(F.when(~F.col("ok"), F.col("session"))).alias("since"))
    state = S.answer_fold(a).select("learner", "item", "s")
    i = F.col("item")
    x = tiers.join(seen, ["learner", "item"]).join(state, ["learner", "item"])
    x = x.select("*", (i >= 6).alias("word"), (i % 3 == 0).alias("held"), ((F.col("tier") == 2) & (i < 4) & (F.col("s") < 5)).alias("consolidating"), (i % 5).cast("double").alias("jitter"), (i == 2).alias("aged"))
    return planners.day_plan(x, 6, 0.3)


@query("q175_glyph_words")
def q175(spark, d):
    """The words of each language that hold one of its twenty most frequent pairs of letters, accents taken apart."""
    words = settled(T.counted(spark, d))  # read twice; ranks are not asked
    places = words.filter(F.length("token") > 1).select("lang", "token", "n", F.explode_outer(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    pairs = places.groupBy("lang", F.expr("substring(token, i, 2)").alias("pair")).agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "pair"))
    units = pairs.withColumn("i", first).filter("i <= 20").select("lang", F.col("pair").alias("unit"), F.col("pair").alias("text"))
    return glyphs.holders(F.broadcast(units), words.select("lang", F.col("token").alias("word"), F.col("token").alias("text")), ("lang",))


@query("q176_option_counts", """
WITH u AS (SELECT p_partkey AS unit, p_size % 6 AS stage, lower(p_name) || CAST(p_partkey % 9 AS VARCHAR) AS roman, lower(p_brand) AS say, lower(p_type) || CAST(p_size AS VARCHAR) AS form, [lower(p_name) || CAST((p_partkey + 1) % 9 AS VARCHAR)] AS alt FROM part),
r AS (SELECT a.unit, count(*) AS n FROM u a JOIN u b ON a.stage = b.stage AND (a.unit = b.unit OR a.form = b.form OR a.say = b.say OR a.roman = b.roman OR (list_contains(a.alt, b.roman) AND list_contains(b.alt, a.roman))) GROUP BY a.unit)
SELECT unit, stage, least(4, 1 + count(*) OVER (PARTITION BY stage) - n) AS options FROM u JOIN r USING (unit)""")
def q176(spark, d):
    """How many options each part has among those of its stage, by form, sound and names."""
    p, k = T.read(spark, d, "part"), F.col("p_partkey")
    name = lambda i: F.concat("p_name", ((k + i) % 9).cast("string"))
    units = p.select(k.alias("unit"), (F.col("p_size") % 6).alias("stage"), F.concat(F.lit("X "), "p_type", F.col("p_size").cast("string")).alias("text"), F.col("p_brand").alias("say"), name(0).alias("roman"), F.array(name(1)).alias("alt"))
    return glyphs.option_counts(units)


@query("q181_mixed_kinds", "WITH " + ANSWERS + """,
i AS (SELECT learner, item, list_sort(list(DISTINCT kind) FILTER (NOT ok)) AS missed, row_number() OVER (PARTITION BY learner ORDER BY item) AS place, count(*) OVER (PARTITION BY learner) AS n FROM answers GROUP BY learner, item),
p AS (SELECT *, CASE WHEN floor(0.4::DOUBLE * n + 0.5) > 0 THEN list_transform(range(0, CAST(floor(0.4::DOUBLE * n + 0.5) AS INT)), lambda j: floor((j + 0.5::DOUBLE) * n / floor(0.4::DOUBLE * n + 0.5))) ELSE [] END AS spots FROM i),
b AS (SELECT *, len(list_filter(spots, lambda x: x < place - 1)) AS before FROM p),
k AS (SELECT *, CASE WHEN list_contains(spots, CAST(place - 1 AS DOUBLE)) THEN ['type', 'recall'][before % 2 + 1] ELSE ['hear', 'read'][(place - 1 - before) % 2 + 1] END AS kind FROM b),
w AS (SELECT *, CASE WHEN kind IN ('type', 'recall') THEN NULL ELSE list_filter(missed, lambda m: m <> kind)[1] END AS want FROM k),
z AS (SELECT *, count(want) OVER (PARTITION BY learner ORDER BY place) AS moved FROM w)
SELECT learner, place, item, CASE WHEN want IS NOT NULL AND 2 * moved <= n THEN want ELSE kind END AS kind FROM z""")
def q181(spark, d):
    """The items of each learner as a plan with two fifths of production, and missed kinds in the place of others."""
    a = T.answers(spark, d)
    plan = a.select("learner", "item").distinct().withColumn("place", F.row_number().over(W.partitionBy("learner").orderBy("item")))
    misses = a.filter(~F.col("ok")).groupBy("learner", "item").agg(F.array_sort(F.collect_set("kind")).alias("missed"))
    return sessions.swapped_kinds(sessions.mixed_kinds(plan.select("learner", "place", "item"), 0.4), misses)
