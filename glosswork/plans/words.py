"""Queries over the texts' words and sentences, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators import corpus as C
from glosswork.operators.settle import settled
from glosswork.sources import tables as T
from glosswork.sources.tables import SENTENCES, TOKENS, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q18_token_frequency", "WITH " + WORDS + " SELECT lang, token, n, rank FROM words")
def q18(spark, d):
    return T.words(spark, d)


_CASE = TOKENS + """,
tc AS (SELECT lang, token, count(*) FILTER (substr(surface, 1, 1) = substr(token, 1, 1)) AS low, count(*) FILTER (substr(surface, 1, 1) <> substr(token, 1, 1)) AS cap
  FROM tokens WHERE pos > 0 GROUP BY ALL)"""


@query("q19_truecase_counts", "WITH " + _CASE + " SELECT * FROM tc")
def q19(spark, d):
    return C.truecase_counts(T.tokens(spark, d))


@query("q56_truecase_proper_share", "WITH " + _CASE + " SELECT * FROM tc WHERE cap >= 3 AND cap > low")
def q56(spark, d):
    return C.proper_share(C.truecase_counts(T.tokens(spark, d)))


@query("q20_rank_blend", "WITH " + TOKENS + """,
sp AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM conversations),
s AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS sr FROM sp GROUP BY token),
w AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS wr FROM tokens GROUP BY token),
x AS (SELECT token, round((ln(sr) + ln(wr)) / 2, 9) AS score FROM s JOIN w USING (token))
SELECT token, score, row_number() OVER (ORDER BY score, token) AS rank FROM x""")
def q20(spark, d):
    said = T.read(spark, d, "conversations").select(F.explode(T.words_of(F.lower("text"))).alias("token"))
    count = lambda t: t.groupBy("token").agg(F.count("*").alias("n"))
    return C.rank_blend(count(said), count(T.tokens(spark, d)))


@query("q21_distribute_surface", "WITH " + TOKENS + """,
r AS (SELECT token AS surface, source AS reading, count(*) AS n FROM tokens GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY surface) AS total, n / sum(n) OVER (PARTITION BY surface) AS share FROM r),
k AS (SELECT *, sum(n) OVER (PARTITION BY surface) AS kept FROM s WHERE total >= 2 AND share >= 0.025)
SELECT surface, reading, round(n / kept, 9) AS share, round(n * total / kept, 6) AS n FROM k
UNION ALL SELECT DISTINCT surface, '?', 1.0, CAST(total AS DOUBLE) FROM s WHERE total < 2""")
def q21(spark, d):
    return C.distribute_surface(T.tokens(spark, d).groupBy(F.col("token").alias("surface"), F.col("source").alias("reading")).agg(F.count("*").alias("n")))


_LEVELS = WORDS + """,
lv AS (SELECT *, CASE WHEN rank <= 600 THEN 'A1' WHEN rank <= 1300 THEN 'A2' ELSE 'B1' END AS lv FROM words)"""


@query("q22_level_bands", "WITH " + _LEVELS + " SELECT lang, token, n, rank, lv FROM lv")
def q22(spark, d):
    return C.level_bands(T.words(spark, d))


def _tiers(rounded: str) -> str:
    return _LEVELS + f""",
z AS (SELECT *, count(*) OVER (PARTITION BY lang, lv) AS size, row_number() OVER (PARTITION BY lang, lv, rank <= 100 ORDER BY rank DESC, token) AS i,
  CASE lv WHEN 'A1' THEN 0.10::DOUBLE WHEN 'A2' THEN 0.25::DOUBLE ELSE 0.40::DOUBLE END AS share FROM lv),
ft AS (SELECT lang, token, n, rank, lv, CASE WHEN rank <= 100 THEN 0 WHEN i <= {rounded} THEN 2 ELSE 1 END AS ft FROM z)"""


@query("q23_freq_tiers", "WITH " + _tiers("floor(share * size + 0.5)") + " SELECT * FROM ft")
def q23(spark, d):
    return C.freq_tiers(C.level_bands(T.words(spark, d)))


@query("q24_freq_tiers_bankers", "WITH " + _tiers("round_even(share * size, 0)") + " SELECT * FROM ft")
def q24(spark, d):
    return C.freq_tiers(C.level_bands(T.words(spark, d)), bankers=True)


@query("q58_tier_counts", "WITH " + _tiers("floor(share * size + 0.5)") + """
SELECT lang, lv, count(*) FILTER (ft = 0) AS ambient, count(*) FILTER (ft = 1) AS core, count(*) FILTER (ft = 2) AS peripheral FROM ft GROUP BY ALL""")
def q58(spark, d):
    return C.tier_counts(C.freq_tiers(C.level_bands(T.words(spark, d))))


@query("q25_strata", "WITH " + _LEVELS + """,
i AS (SELECT *, row_number() OVER (PARTITION BY lang, lv ORDER BY rank) - 1 AS i FROM lv),
s AS (SELECT lang, lv, ceil(count(*) / 50) AS sets FROM lv GROUP BY ALL),
b AS (SELECT lang, lv, bucket, floor(bucket * sets / 6 + 1e-9) AS a, floor((bucket + 1) * sets / 6 + 1e-9) AS z FROM s CROSS JOIN (SELECT unnest(range(6)) AS bucket)),
c AS (SELECT lang, lv, bucket, a * 50 AS a, greatest(a + 1, z) * 50 AS z FROM b)
SELECT lang, lv, CAST(bucket AS INT) AS bucket, count(*) AS n, min(rank) AS first, max(rank) AS last FROM i JOIN c USING (lang, lv) WHERE i.i >= a AND i.i < z GROUP BY ALL""")
def q25(spark, d):
    return C.strata(C.level_bands(T.words(spark, d)), 6, 50)


@query("q26_admission_reasons", "WITH " + SENTENCES + """,
x AS (SELECT lang, CASE WHEN regexp_matches(text, '[#*$%&|<>]') THEN 'symbols' WHEN NOT regexp_matches(text, '^\\p{Lu}') THEN 'start'
  WHEN regexp_full_match(text, '[^\\p{Ll}]*') THEN 'capitals' WHEN regexp_matches(text, '[0-9@]') THEN 'digits'
  WHEN len(regexp_extract_all(text, '\\p{L}+')) < 3 THEN 'short' WHEN len(regexp_extract_all(text, '\\p{L}+')) > 14 THEN 'long' ELSE 'admitted' END AS reason FROM sentences)
SELECT lang, reason, count(*) AS n FROM x GROUP BY ALL""")
def q26(spark, d):
    return C.admission(T.sentences(spark, d)).groupBy("lang", F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


@query("q27_sense_association", "WITH " + TOKENS + """,
b AS (SELECT DISTINCT lang, source AS key, doc_id * 100000 + sent AS sentence, token FROM tokens),
f AS (SELECT DISTINCT lang, key, sentence FROM b),
sz AS (SELECT lang, key, count(*) AS nsent FROM f GROUP BY ALL),
df AS (SELECT lang, key, token, count(*) AS df FROM b JOIN f USING (lang, key, sentence) GROUP BY ALL),
bg AS (SELECT lang, token, count(*) AS bg FROM (SELECT DISTINCT lang, sentence, token FROM b) GROUP BY ALL),
al AS (SELECT lang, count(DISTINCT sentence) AS all_ FROM b GROUP BY lang),
x AS (SELECT lang, key, token, df / nsent AS p, (bg + 1) / all_ AS q FROM df JOIN sz USING (lang, key) JOIN bg USING (lang, token) JOIN al USING (lang))
SELECT lang, key, token, round(CASE WHEN p > q THEN p * log2(p / q) ELSE 0.0 END, 6) AS score FROM x""")
def q27(spark, d):
    s = T.sentences(spark, d).filter(F.col("text").rlike(r"\p{L}")).select("lang", F.col("source").alias("key"), (F.col("doc_id") * 100000 + F.col("sent")).alias("sentence"), "text")
    return C.sense_association(settled(C.bag_counts(s, ("lang",))), ("lang",))


_EXAMPLES = WORDS + """,
sz AS (SELECT doc_id, sent, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) BETWEEN 3 AND 14),
t AS (SELECT DISTINCT lang, doc_id, sent, token, n FROM tokens JOIN sz USING (doc_id, sent)),
ra AS (SELECT doc_id, sent, max(rank) AS rarest FROM t JOIN words USING (lang, token) GROUP BY ALL),
ex AS (SELECT t.lang, t.token, row_number() OVER (PARTITION BY t.lang, t.token ORDER BY abs(t.n - 7), rarest, doc_id, sent) AS place, doc_id, sent, t.n, rarest
  FROM t JOIN ra USING (doc_id, sent) JOIN words w ON w.lang = t.lang AND w.token = t.token QUALIFY place <= 2)"""


@query("q28_example_selection_window", "WITH " + _EXAMPLES + " SELECT * FROM ex")
def q28(spark, d):
    return C.example_selection(T.words(spark, d), T.bagged(spark, d))


@query("q29_coverage_histogram", "WITH " + _EXAMPLES + """,
k AS (SELECT lang, token, count(*) AS k FROM ex GROUP BY ALL),
g AS (SELECT lang, count(*) AS words, count(*) FILTER (k >= 1) AS one, count(*) FILTER (k >= 2) AS two FROM words LEFT JOIN k USING (lang, token) GROUP BY lang)
SELECT *, one >= 0.9 * words AND two >= 0.7 * words AS gate FROM g""")
def q29(spark, d):
    words = T.words(spark, d)
    return C.coverage_histogram(words, C.example_selection(words, T.bagged(spark, d)))


@query("q30_token_coverage", "WITH " + WORDS + """
SELECT doc_id, count(*) AS n, count(w.token) AS known, round(100.0::DOUBLE * count(w.token) / count(*), 1) AS pct
FROM tokens t LEFT JOIN words w ON w.lang = t.lang AND w.token = t.token AND w.rank <= 1000 GROUP BY doc_id""")
def q30(spark, d):
    return C.token_coverage(T.tokens(spark, d), T.words(spark, d).filter("rank <= 1000"))


@query("q31_page_windows", "WITH " + WORDS + """,
pg AS (SELECT t.doc_id AS story, t.sent, count(*) AS n, count(w.token) AS k FROM tokens t LEFT JOIN words w ON w.lang = t.lang AND w.token = t.token AND w.rank <= 500 GROUP BY ALL),
p AS (SELECT story, row_number() OVER (PARTITION BY story ORDER BY sent) - 1 AS page, n, k FROM pg),
c AS (SELECT story, page, n, k, sum(n) OVER (PARTITION BY story ORDER BY page) AS sn, sum(k) OVER (PARTITION BY story ORDER BY page) AS sk FROM p),
r AS (SELECT a.story, a.page AS first, b.page AS last, CAST(b.sn - a.sn + a.n AS BIGINT) AS words, CAST(b.sk - a.sk + a.k AS BIGINT) AS k
  FROM c a JOIN c b ON a.story = b.story AND b.page BETWEEN a.page AND a.page + 19),
v AS (SELECT story, first, last, words, round(k / words, 9) AS coverage FROM r WHERE words BETWEEN 60 AND 90)
SELECT * FROM v WHERE coverage >= 0.6 QUALIFY row_number() OVER (PARTITION BY story ORDER BY coverage DESC, words DESC, first, last) = 1""")
def q31(spark, d):
    known = T.words(spark, d).filter("rank <= 500").select("lang", "token", F.lit(1).alias("known"))
    p = T.tokens(spark, d).join(known, ["lang", "token"], "left").groupBy(F.col("doc_id").alias("story"), "sent").agg(F.count("*").alias("n"), F.count("known").alias("k"))
    return C.page_windows(p.withColumn("page", F.row_number().over(W.partitionBy("story").orderBy("sent")) - 1))


@query("q45_story_dedupe_first_seen", "WITH " + SENTENCES + """
SELECT lang, doc_id, source, sent, text FROM (SELECT *, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS key FROM sentences)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, sent) = 1""")
def q45(spark, d):
    s = T.sentences(spark, d)
    return C.first_seen(s, F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")), "doc_id", "sent")
