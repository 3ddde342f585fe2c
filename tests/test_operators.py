"""Operators on small cases worked by hand."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glosswork.functions import folding, glosses, spans
from glosswork.operators import alignment, corpus, linking, planners, progress, relations, rules, sessions, state, units
from glosswork.plans.catalogue import queries
from glosswork.sources import tables
from glosswork.sources.html import epub_pages, page_text
from glosswork.streaming import answers as stream

DATA = "/root/testdata/sf0.001"


def words(spark, rows):
    return spark.createDataFrame(rows, "lang string, token string, n long, rank long")


def test_tiers_by_hand(spark):
    # Levels of 30, 20 and 20 words; the first 100 ranks would all be ambient, so ambience ends at 10 here.
    w = words(spark, [("x", f"w{k:04d}", 100 - k, k) for k in range(1, 71)])
    w = corpus.level_bands(w, (("A1", 30), ("A2", 20), ("B1", 20)))
    ambient, corpus.AMBIENT = corpus.AMBIENT, 10
    try:
        got = {r["token"]: r["ft"] for r in corpus.freq_tiers(w).collect()}
    finally:
        corpus.AMBIENT = ambient
    assert [k for k in range(1, 71) if got[f"w{k:04d}"] == 0] == list(range(1, 11))
    assert [k for k in range(1, 31) if got[f"w{k:04d}"] == 2] == [28, 29, 30]
    assert sum(got[f"w{k:04d}"] == 2 for k in range(31, 51)) == 5 and sum(got[f"w{k:04d}"] == 2 for k in range(51, 71)) == 8


@pytest.mark.parametrize("bankers, n", [(False, 3), (True, 2)])
def test_halves(spark, bankers, n):
    w = words(spark, [("x", f"w{k}", 1, 100 + k) for k in range(25)]).withColumn("lv", F.lit("A1"))  # a tenth of 25 is 2.5
    assert corpus.freq_tiers(w, bankers=bankers).filter("ft = 2").count() == n


@pytest.mark.parametrize(
    "issued, texts, ids, gone",
    [
        ([(1, "a."), (2, "b."), (3, "c.")], ["c.", "a.", "b."], [3, 1, 2], []),
        ([(1, "a."), (2, "gone."), (3, "c.")], ["a.", "c.", "new."], [1, 3, 4], [2]),
        ([(1, "x."), (2, "x.")], ["x.", "x.", "x."], [1, 2, 3], []),
        ([], ["a."], [1], []),
    ],
)
def test_ids_are_carried(spark, issued, texts, ids, gone):
    old = spark.createDataFrame(issued, "id long, text string")
    got = relations.carry_ids(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"), old)
    assert [r["id"] for r in got.orderBy("ord").collect()] == ids
    assert [r["id"] for r in relations.retired(old, got).collect()] == gone


def test_alignment_by_hand():
    assert alignment.align(["aaaaaaaaaa"], ["b" * 100]) == [None]
    us, es = ["a" * 20, "b" * 20, "c" * 30], ["d" * 41, "e" * 30]
    assert alignment.align(us, es) == [(f"{'a' * 20} {'b' * 20}", "d" * 41), ("c" * 30, "e" * 30)]
    assert alignment.align(us + us, es) is None and alignment.align([], es) is None


def test_stream_equals_batch(spark, tmp_path):
    events = tables.read(spark, DATA, "events")
    events.repartitionByRange(3, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(f"{tmp_path}/in")
    got = stream.run_available(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out")
    want = state.answer_fold(tables.answers(spark, DATA))
    cols = ["learner", "item", "r", "w", "s", "k", "t", "u"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(got) == key(want)


def test_stream_in_steps_equals_batch(spark, tmp_path):
    events = tables.read(spark, DATA, "events")
    days = events.withColumn("p", F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 11))
    for p in range(3):
        days.filter(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = stream.run_available(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", files_per_trigger=1)
    want = state.answer_fold(tables.answers(spark, DATA))
    assert got.agg(F.sum("r"), F.sum("w"), F.sum("s")).first() == want.agg(F.sum("r"), F.sum("w"), F.sum("s")).first()


def test_rank_without_one_task_is_row_number(spark):
    rows = [("x", f"t{k % 37}{k}", (k * 7919) % 11) for k in range(500)] + [("y", "t", 1)]
    df = spark.createDataFrame(rows, "lang string, token string, n long")
    got = {(r["lang"], r["token"]): r["rank"] for r in tables.ranked(df, ["lang"]).collect()}
    order = sorted((r for r in rows if r[0] == "x"), key=lambda r: (-r[2], r[1]))
    assert [got["x", t] for _, t, _ in order] == list(range(1, 501)) and got["y", "t"] == 1


def test_blend_with_a_third_ranking(spark):
    a = spark.createDataFrame([("p", 9), ("q", 5), ("r", 1)], "token string, n long")
    b = spark.createDataFrame([("q", 9), ("p", 5), ("z", 1)], "token string, n long")
    c = spark.createDataFrame([("q", 1)], "token string, rank long")
    assert [r["token"] for r in corpus.rank_blend(a, b).orderBy("rank").collect()] == ["p", "q"]
    assert [r["token"] for r in corpus.rank_blend(a, b, c).orderBy("rank").collect()] == ["q", "p"]


def test_readings_add_up(spark):
    df = spark.createDataFrame([("s", "a", 97), ("s", "b", 2), ("s", "c", 3), ("t", "a", 1)], "surface string, reading string, n long")
    got = {(r["surface"], r["reading"]): r["n"] for r in corpus.distribute_surface(df).collect()}
    assert got.keys() == {("s", "a"), ("s", "c"), ("t", "?")} and abs(got["s", "a"] + got["s", "c"] - 102) < 1e-6


def test_curve(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.86,), (0.89,), (0.9,), (0.85,)], "x double")
    assert [r["sessions_left"] for r in progress.eta_lookup(df).collect()] == [40, 34, 1, 1, 0, 2]


def test_crossing(spark):
    xs = [0.5, 0.91, 0.87, 0.9, 0.89, 0.95]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(xs)], "learner long, session int, x double")
    assert progress.goal_crossing(df, 0.9).collect()[0]["session"] == 3


def test_phrases_and_placement():
    assert planners.phrase_spans("a b c a b".split(), {("a", "b"): 1, ("a", "b", "c"): 2, ("b",): 3}) == [(0, 3, 2), (3, 5, 1)]
    assert planners.placement({0: True, 4: False, 2: True}, 8) == (2, 3) and planners.placement({}, 8) == (-1, 3) and planners.placement({3: True, 4: False}, 8) == (3, None)


def test_pair_plan_asks_an_item_once(spark):
    rows = [(1, k % 6, "type" if k % 2 else "hear", k % 5, k % 3) for k in range(30)]
    got = planners.pair_plan(spark.createDataFrame(rows, "learner long, item int, kind string, s int, session int")).collect()
    assert len({r["item"] for r in got}) == len(got) == 6


def test_gloss_collision(spark):
    rows = [("n", 1, 1, "cup", 1.0), ("n", 2, 2, "cup", 1.0), ("n", 2, 2, "mug", 0.8), ("n", 3, 3, "cup", 1.0), ("n", 3, 3, "jar", 0.5)]
    got = {r["id"]: r["gloss"] for r in planners.gloss_collision(spark.createDataFrame(rows, "pos string, id long, rank long, gloss string, support double")).collect()}
    assert got == {1: "cup", 2: "mug", 3: "cup"}


def test_day_log():
    book: dict = {}
    assert sessions.answer(book, 1, "recall", False, 1, 1) == 0
    assert sessions.answer(book, 1, "recall", True, 1, 1) == 0  # the retry in the same drill
    book, expired = sessions.midnight(book, 2)
    assert book[1]["missed"] == ["recall"] and expired == 0
    assert sessions.answer(book, 1, "hear", True, 2, 2) == 0 and sessions.answer(book, 1, "type", True, 2, 2) == 1
    sessions.answer(book, 2, "hear", False, 2, 2)
    sessions.answer(book, 2, "hear", False, 3, 3)
    assert sessions.midnight(book, 7)[1] == 0 and sessions.midnight(book, 8) == ({}, 1)


def test_mixes_and_picks():
    assert sorted(sessions.kind_mix(10, 0.4)).count("type") == 2 and len(sessions.kind_mix(7, 0.0)) == 7
    assert sessions.missed_kinds([(1, "hear"), (2, "hear"), (3, "hear"), (4, "type")], {1: ["recall"], 2: ["type"], 3: ["read"], 4: ["hear"]}) == [(1, "recall"), (2, "type"), (3, "hear"), (4, "type")]
    assert sessions.weighted_pick({"a": 1, "b": 3}, 0.2) == "a" and sessions.weighted_pick({"a": 1, "b": 3}, 0.25) == "b"


def test_spans():
    assert spans.find("L'eau et l'eau, beau", "eau") == [] and spans.find("eau, Eau beau", "eau") == [(0, 3), (5, 8)]
    assert spans.find("beau", "eau", spaced=False) == [(1, 4)] and spans.locate("a cat sat", ["cat", "cat sat"]) == (2, 9)
    assert spans.locate("cat cat", ["cat"]) is None and spans.blank("a cat", (2, 5)) == "a ____"
    assert spans.segments("abcdef", [(0, 2, 1), (1, 4, 2), (4, 5, 3)]) == [("a", None), ("bcd", 2), ("e", 3), ("f", None)]
    assert spans.token_offsets("e\u0301t x", ["e", "zz", "t"]) == [(0, 2), None, (2, 3)]
    assert spans.move("a  cat (x)", "a cat", [(3, 6), (7, 10)]) == [(2, 5), None]
    assert spans.cut_article("l'eau", ["l'", "la"]) == ("l'", "eau") and spans.cut_article("la", ["la"]) == ("", "la")


def test_feminine_fold(spark):
    rows = [("chat", 1, None), ("chatte", 2, "chat"), ("eau", 3, None), ("grande", 4, "grand"), ("grand", 5, None)]
    df = spark.createDataFrame(rows, "lemma string, rank long, masculine string")
    assert [r["lemma"] for r in planners.feminine_fold(df, 3).orderBy("rank").collect()] == ["chat", "eau", "grande"]
    assert [r["lemma"] for r in planners.feminine_fold(df, 4).orderBy("rank").collect()] == ["chat", "eau", "grand"]


def test_folds():
    assert folding.fold_accents("йЁé") == "йЕe"
    assert folding.normalize_typed(" L’Été ", accents=True) == "l'ete"
    assert folding.normalize_typed("Übergröße", accents=True, german=True) == "uebergroesse"
    assert folding.normalize_typed("ماء", accents=True) == "ما" != folding.normalize_typed("ماء")
    assert folding.search_fold("धीरे-धीरे") == "धीरे"
    assert folding.pointing_key("замо́к") == "замок"
    assert folding.kana_fold("カナ") == "かな"
    assert folding.mark_syllable("xue", 2) == "xué" and folding.mark_syllable("lü", 4) == "lǜ" and folding.tone_of("hǎo") == 3
    assert folding.pron_key("jǚ v") == "jǔü"
    assert folding.graphemes("éa") == ["é", "a"]


def test_page_text():
    assert page_text("<html lang=fr><head><title>T &amp; U</title></head><body><nav>x</nav><p>a <b>b</b></p>c<script>d</script></body></html>") == ("fr", "T & U", "a b\nc")
    assert page_text("") == ("", "", "")


def test_epub():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:p"><manifest><item id="b" href="2.xhtml"/><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/1.xhtml", "<html><body><p>One</p></body></html>")
        z.writestr("o/2.xhtml", "<html><body><p>Two</p></body></html>")
    assert epub_pages(data.getvalue()) == ["One", "Two"]


def test_levels_are_bound():
    keys = [f"k{i}" for i in range(9)]
    assert planners.moved(keys, {"k0": 1}, {}, [3, 3, 3])[:5] == ["k1", "k2", "k3", "k0", "k4"]
    assert planners.moved(keys, {}, {"k7": 0}, [3, 3, 3]) == ["k0", "k1", "k7", "k2", "k3", "k4", "k5", "k6", "k8"]
    assert planners.moved(keys, {}, {}, [3, 3, 3]) == keys


def test_gloss_sides(spark):
    rows = ["to be careful", "to be about", "be careful", "to feel here", "no matter what or how", "hot or boiling water", "(a or b)", "(a or b) or c (d e)", "-a/b(c)", "plain", None]
    x = spark.createDataFrame([(r,) for r in rows], "g string").select("g", glosses.quality_of(F.col("g")).alias("q"), glosses.before_or(F.col("g")).alias("o"), glosses.affix_alternatives(F.col("g")).alias("a")).collect()
    by = {r["g"]: r for r in x}
    assert {g for g, r in by.items() if r["q"]} == {"to be careful"} and by["to be careful"]["q"] == "careful"
    assert {g: r["o"] for g, r in by.items() if r["o"]} == {"no matter what or how": "no matter what", "(a or b) or c (d e)": "(a or b)"}
    assert by["-a/b(c)"]["a"] == ["a/b(c)", "a", "b(c)", "a/bc", "a/b", "bc", "b"] and by["plain"]["a"] == []


def test_english_sentences(spark):
    page = "Mr. Fox ran. \u201cStop!\u201d He did\u2026 not"
    got = spark.createDataFrame([(page,), ("",), ("No end. Here? <b>Yes</b>!",)], "p string").select(glosses.sentences_of(F.col("p"))).collect()
    assert [r[0] for r in got] == [["Mr. Fox ran.", '"Stop!"', "He did... not"], [], ["No end.", "Here?", "Yes !"]]


def test_stems_are_attested(spark):
    words = ["making", "plane", "stopped", "stories", "boxes", "houses", "cats", "glass", "tried", "running", "went", "unknowned"]
    known = ["make", "plan", "stop", "story", "box", "house", "cat", "try", "run"]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = glosses.stems(frame(words, "word"), frame(known, "word"), spark.createDataFrame([("went", "go")], "word string, base string")).collect()
    assert {r["word"]: r["stem"] for r in got} == {"making": "make", "plane": "plane", "stopped": "stop", "stories": "story", "boxes": "box", "houses": "house", "cats": "cat", "glass": "glass", "tried": "try", "running": "run", "went": "go", "unknowned": "unknowned"}


@pytest.mark.parametrize("seed", range(30))
def test_alignment_against_all_ways(seed):
    rng = random.Random(seed)
    text = lambda k: "x" * rng.randrange(4, 40)
    us, es = [text(k) for k in range(rng.randrange(1, 6))], [text(k) for k in range(rng.randrange(1, 6))]

    def ways(i, j):
        if (i, j) == (len(us), len(es)):
            yield 0.0, []
        for a, b in alignment.BEADS:
            if i + a <= len(us) and j + b <= len(es):
                r = (len(" ".join(us[i : i + a])) + 6) / (len(" ".join(es[j : j + b])) + 6)
                if 0.7 <= r <= 1.4:
                    yield from ((c + abs(math.log(r)), [(a, b), *p]) for c, p in ways(i + a, j + b))

    best = min(ways(0, 0), default=(math.inf, []))
    got = alignment.path(us, es)
    assert bool(got) == bool(best[1]) and (not got or abs(sum(abs(math.log((len(" ".join(us[i : i + a])) + 6) / (len(" ".join(es[j : j + b])) + 6))) for (i, j), (a, b) in zip([(sum(x for x, _ in got[:k]), sum(y for _, y in got[:k])) for k in range(len(got))], got, strict=True)) - best[0]) < 1e-9)


def test_page_shift_keeps_a_constant_difference(spark):
    rng = random.Random(2)
    story = {k: [rng.randrange(100, 900) for _ in range(8)] for k in range(4)}
    pages = [(k, n, x) for k, v in story.items() for n, x in enumerate(v)]
    # Numbers 9 apart; the same numbers; the first page missing; every page one further, under an extra first one.
    twins = [(0, n + 9, x) for n, x in enumerate(story[0])] + [(1, n, 2 * x) for n, x in enumerate(story[1])] + [(2, n, x) for n, x in enumerate(story[2]) if n]
    twins += [(3, n + 1, x) for n, x in enumerate(story[3])] + [(3, 0, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "story long, n long, len long")
    got = {r["story"]: (r["shift"], r["usual"], r["pages"]) for r in linking.page_shift(frame(pages), frame(twins)).collect()}
    assert got == {0: (9, 9, 8), 1: (0, 0, 8), 2: (0, 0, 7), 3: (1, 0, 8)}


def test_examples_choose_as_one_after_another_over_all_candidates(spark):
    rng = random.Random(4)
    rows = sorted({("x", f"w{rng.randrange(12)}", d, s) for d in range(30) for s in range(4) for _ in range(3)})
    size = {(d, s): (rng.randrange(3, 14), rng.randrange(50)) for _, _, d, s in rows}
    rows = [(*r, *size[r[2:]]) for r in rows]
    got = planners.examples_exact(spark.createDataFrame(rows, "lang string, token string, doc_id long, sent int, n long, rarest long")).collect()
    by, used, want = {}, set(), []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for token in sorted(by, key=lambda t: (len(by[t]), t)):
        order = sorted(((d, s) not in used, abs(n - 7), z, d, s) for _, _, d, s, n, z in by[token])[:2]
        for place, (*_, d, s) in enumerate(order, 1):
            used.add((d, s))
            want.append((token, place, d, s))
    assert sorted((r["token"], r["place"], r["doc_id"], r["sent"]) for r in got) == sorted(want)


def test_refill(spark):
    words = spark.createDataFrame([("a",), ("b",)], "token string")
    cand = spark.createDataFrame([("b", 1, 2.0), ("b", 2, 1.0), ("a", 3, 0.0)], "token string, sentence long, cost double")
    got = units.refill(words, cand, spark.createDataFrame([("a",)], "token string"), 1).collect()
    assert [(r["token"], r["sentence"]) for r in got] == [("b", 2)]


def test_fnv(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",), ("\U0001f600",)], "s string").select(relations.fnv1a(F.col("s"))).collect()
    assert [r[0] for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, 3409036472]


def test_version_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id long, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "id long, v string")
    got = {(r["id"], r["change"], r["fields"]) for r in relations.version_diff(a, b, "id", ["v"]).collect()}
    assert got == {(2, "changed", "v"), (3, "removed", ""), (4, "added", "")}


def test_synonyms_of_a_frequent_meaning(spark):
    rows = [(k, "hot") for k in range(150)] + [(k, f"m{k // 2}") for k in range(100, 200)] + [(999, "alone")]
    got = {tuple(r) for r in relations.synonym_links(spark.createDataFrame(rows, "id long, meaning string")).collect()}
    assert got == {("hot", 0, k) for k in range(150)} | {(f"m{k // 2}", k - k % 2, k) for k in range(100, 200)}


def test_division_by_classes(spark):
    rng = random.Random(6)
    have = [(o, rng.randrange(5)) for o in range(40) for _ in range(6)]
    need = [(t, rng.randrange(5)) for t in range(60) for _ in range(3)]
    got = [tuple(r) for r in relations.covers(spark.createDataFrame(have, "owner long, value int"), spark.createDataFrame(need, "target long, value int")).collect()]
    h, n = ({k: {v for x, v in rows if x == k} for k, _ in rows} for rows in (have, need))
    of = {kind: {a: b for k, a, b in got if k == kind} for kind in ("owner", "target")}
    pairs = {(a, b) for k, a, b in got if k == "pair"}
    assert {(o, t) for o in h for t in n if (of["owner"][o], of["target"][t]) in pairs} == {(o, t) for o in h for t in n if n[t] <= h[o]}
    assert len(of["owner"].values()) == 40 and len(set(of["owner"].values())) == len({frozenset(v) for v in h.values()})


def test_curves_over_whole_tables(spark, tmp_path):
    put = lambda name, columns, rows: spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    put("orders", "o_orderkey long, o_custkey long, o_totalprice double", [(10, 7, 90.5), (20, 205, 500.0)])
    put("customer", "c_custkey long, c_nationkey long, c_acctbal double, c_name string", [(10, 2, 1.5, "ten"), (11, 2, 2.0, "eleven"), (13, 0, 2.0, "thirteen")])
    got = {r["id"]: r["curve"] for r in queries()["q93_nearest_placed_curve"](spark, str(tmp_path)).collect()}
    assert got == {10: "eleven", 20: "thirteen"}


def test_distractors_beyond_a_hot_guard(spark):
    # Two brands beside a hot one, far apart in the order; in the second group all share the brand.
    rows = [(k, "t", "hot" if k % 40 else f"b{k % 80}", f"n{k}", f"{k:04d}") for k in range(160)] + [(1000 + k, "u", "hot", f"n{k}", f"{k:04d}") for k in range(50)]
    got = relations.distractors(spark.createDataFrame(rows, "id long, kind string, brand string, name string, order_key string"), "kind", ["brand", "name"]).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["id"], []).append((r["place"], r["other"]))
    for k, kind, brand, name, _ in rows:
        turn = [rows[(k + j) % 160] for j in range(1, 160)] if kind == "t" else []
        assert sorted(mine.get(k, [])) == list(enumerate([r[0] for r in turn if r[2] != brand and r[3] != name][:3], 1))


def test_fields_are_removed_at_every_depth(spark):
    df = spark.createDataFrame([((1, [(2, "a"), (3, "b")], (4, "c")), "x"), (None, "y")], "e struct<n: int, l: array<struct<m: int, audio: string>>, s: struct<k: int, audio: string>>, audio string")
    got = rules.without(df, "audio")
    assert got.schema.simpleString() == "struct<e:struct<n:int,l:array<struct<m:int>>,s:struct<k:int>>>"
    assert [r["e"] and (r["e"]["n"], [x["m"] for x in r["e"]["l"]], r["e"]["s"]["k"]) for r in got.collect()] == [(1, [2, 3], 4), None]


def test_weighted_kinds_and_placements_agree_with_the_plain_functions(spark):
    weights = {"a": 3.0, "b": 1.0, "c": 0.5}
    df = spark.range(200).select((F.col("id") / 200).alias("u"))
    got = df.select("u", sessions.weighted_kind(F.col("u"), weights).alias("k")).collect()
    assert all(r["k"] == sessions.weighted_pick(weights, r["u"]) for r in got)
    rng = random.Random(3)
    rows = [(l, b, rng.random() < 0.5) for l in range(60) for b in rng.sample(range(6), rng.randrange(1, 6))]
    got = {r["learner"]: (r["floor"], r["probe"]) for r in planners.placements(spark.createDataFrame(rows, "learner long, bucket int, passed boolean"), 6).collect()}
    assert got == {l: planners.placement({b: ok for x, b, ok in rows if x == l}, 6) for l in range(60)}


def test_phrases_agree_with_the_plain_function(spark):
    rng = random.Random(9)
    phrases = {tuple(rng.choice("abc") for _ in range(n)): k for k, n in enumerate([2, 2, 2, 3, 3, 3, 3])}
    sents = {k: [rng.choice("abc") for _ in range(rng.randrange(0, 12))] for k in range(60)}
    toks = spark.createDataFrame([(k, i, t) for k, s in sents.items() for i, t in enumerate(s)], "sentence long, pos int, token string")
    frame = spark.createDataFrame([(" ".join(p), i) for p, i in phrases.items()], "phrase string, id int")
    got = {}
    for r in planners.phrases_in(toks, frame).collect():
        got.setdefault(r["sentence"], []).append((r["start"], r["stop"], r["id"]))
    assert all(sorted(got.get(k, [])) == planners.phrase_spans(s, phrases) for k, s in sents.items())


def ring(rows, guards, n, loose=None):
    """Distractors by trying all others in cyclic order; rows: dicts."""
    out = {}
    for kind in {r["kind"] for r in rows}:
        order = sorted((r for r in rows if r["kind"] == kind), key=lambda r: (r["order_key"], r["id"]))
        for i, r in enumerate(order):
            after = order[i + 1 :] + order[:i]
            ok = lambda o, some: all(o[g] is not None and r[g] is not None and o[g] != r[g] for g in some)  # noqa: B023, E731
            got = [o["id"] for o in after if ok(o, guards)]
            if loose is not None and len(got) < n:
                got = [o["id"] for o in after if ok(o, loose)]
            out[r["id"]] = got[:n]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("loose", [None, ["name"]])
def test_distractors_with_hot_values(spark, loose):
    rng = random.Random(5)
    rows = [{"id": k, "kind": rng.choice("aab"), "brand": "hot" if rng.random() < 0.97 else f"b{rng.randrange(6)}", "name": rng.choice(["hot", "hot", "n1", "n2", None]), "order_key": f"{rng.randrange(1 << 30):08x}"} for k in range(500)]
    got = {}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, kind string, brand string, name string, order_key string")
    for r in relations.distractors(df, "kind", ["brand", "name"], block=4, loose=loose).orderBy("place").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == ring(rows, ["brand", "name"], 3, loose)


def test_distractors_end_where_all_but_ten_share_a_value(spark):
    n = 4000
    df = spark.range(n).select("id", F.lit("one").alias("kind"), F.when(F.col("id") % 400 == 7, F.col("id").cast("string")).otherwise("hot").alias("brand"), F.md5(F.col("id").cast("string")).alias("order_key"))
    got = relations.distractors(df, "kind", ["brand"]).groupBy("id").count().collect()
    assert len(got) == n and {r["count"] for r in got} == {3}


def test_gloss_cleaning(spark):
    rows = {"(of people) the way (path (long)), a road": "way, road", "a lot, many": "a lot, many", "to do [w] this (open": "to do this", "": "", None: None, "x" * 30 + " " + "y" * 30: "x" * 30}
    got = spark.createDataFrame([(k,) for k in rows], "g string").select("g", glosses.clean(F.col("g")).alias("c")).collect()
    assert {r["g"]: r["c"] for r in got} == rows


def test_phrase_share_counts_what_stands_between_blanks(spark):
    rows = [("x", "the red hat, the red hat"), ("x", "a red, hat"), ("x", "red hats the red hat red hat"), ("y", "red hat"), ("x", "red"), ("x", "red  hat")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("toks", tables.words_of(F.col("text")))
    phrases = spark.createDataFrame([("x", "red hat", "red"), ("y", "red hat", "red"), ("x", "hat red", "hat")], "lang string, phrase string, head string")
    got = {(r["lang"], r["phrase"]): (r["n"], r["bound"]) for r in linking.phrase_share(df, phrases, ("lang",)).collect()}
    assert got == {("x", "red hat"): (5, 2), ("y", "red hat"): (1, 1), ("x", "hat red"): (4, 1)}


def test_association_counts_all_sentences_of_a_key(spark):
    bags = spark.createDataFrame([(k % 2, k // 2, "late word" if k // 2 >= 400 else "Early word") for k in range(1600)] + [(0, 0, "twice early")], "key int, sentence long, text string")
    got = {(r["key"], r["token"], r["n"]) for r in corpus.bag_counts(bags.withColumn("lang", F.lit("en")), ("lang",)).collect()}
    of = lambda k: {(k, "", 800), (k, "word", 800), (k, "early", 400), (k, "late", 400)}
    assert got == of(0) | of(1) | of(None) | {(0, "twice", 1), (None, "twice", 1)}
    score = {(r["key"], r["token"]): r["score"] for r in corpus.sense_association(corpus.bag_counts(bags)).collect()}
    assert score[0, "twice"] == 0.0 and score[1, "late"] == 0.0 and len(score) == 7
