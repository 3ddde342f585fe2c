import json

import pytest
from pyspark.sql import functions as F

from glosswork import cli
from glosswork.functions.language import LANGUAGES
from glosswork.plans import build
from glosswork.sources import readers, writers

DATA = "/root/testdata/sf0.001"


def test_build_and_gate(spark, tmp_path):
    pack = build.build(spark, DATA, "en")
    got = {r["rule"]: r["ok"] for r in build.check(pack).collect()}
    assert len(got) == 11 and all(ok for rule, ok in got.items() if rule != "examples_cover")
    pack.write(str(tmp_path))
    assert spark.read.json(f"{tmp_path}/words").count() == pack.words.count() <= 2000
    assert pack.examples.groupBy("token").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("argv", [["check", "--lang", "de"], ["sample", "--lang", "en", "--n", "2"], ["passages", "--lang", "fr"], ["enrich", "--lang", "es"], ["review", "--n", "3"], ["progress"]])
def test_commands(spark, argv):
    assert cli.run(spark, [argv[0], "--data", DATA, *argv[1:]]).count() > 0


def test_ids_command_is_stable(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    empty.write.parquet(f"{tmp_path}/none")
    first = cli.run(spark, ["sentence-ids", "--data", DATA, "--lang", "es", "--issued", f"{tmp_path}/none", "--out", f"{tmp_path}/ids"])
    again = cli.run(spark, ["sentence-ids", "--data", DATA, "--lang", "es", "--issued", f"{tmp_path}/ids"])
    assert again.filter("fresh").count() == 0 and again.join(first, ["ord", "id"]).count() == first.count()


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('1\tfra\tUn "mot.\tu\n2\teng\tA word.\tv\nx\tfra\tbad\tw\n3\tfra\n')
    (tmp_path / "l.tsv").write_text("1\t2\n1\tz\n")
    (tmp_path / "a.tsv").write_text("1\t7\tu\tCC BY 4.0\n1\t8\tu\tNone\nq\t9\tu\tCC0 1.0\n")
    assert [tuple(r) for r in readers.sentences(readers.lines(spark, str(tmp_path / "s.tsv")), "fra").collect()] == [(1, 'Un "mot.', "u")]
    assert [tuple(r) for r in readers.links(readers.lines(spark, str(tmp_path / "l.tsv"))).collect()] == [(1, 2)]
    assert [r["clip"] for r in readers.audio(readers.lines(spark, str(tmp_path / "a.tsv"))).collect()] == [7]


def test_lists(spark, tmp_path):
    (tmp_path / "f.txt").write_text("The 9\nof 5\nthe 3\n12 4\ncat 2\nof 1\n")
    got = readers.subtitle_list(readers.lines(spark, str(tmp_path / "f.txt")), most=2).collect()
    assert {r["token"]: r["n"] for r in got} == {"the": 9, "of": 5}
    z = readers.zipf_list(spark.createDataFrame([("A", 1.0), ("a", 1.0)], "word string, zipf double")).collect()
    assert [(r["token"], r["n"]) for r in z] == [("a", 20.0)]


def test_a_list_in_several_files_keeps_their_order(spark, tmp_path):
    # The second file is the larger one, which Spark deals first.
    (tmp_path / "1.txt").write_text("b 1\na 2\n")
    (tmp_path / "2.txt").write_text("c 3\n" + "".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} 1\n" for k in range(500)) + "b 5\n")
    got = readers.subtitle_list(readers.lines(spark, str(tmp_path)), most=3).collect()
    assert {r["token"]: r["n"] for r in got} == {"b": 1, "a": 2, "c": 3}


def test_rejected_lines(spark):
    x = spark.createDataFrame([("1\teng\ttext",), ("x\teng\ttext",), ("1\teng",), ("2\teng\t",)], "value string")
    assert {r["value"]: r["reason"] for r in readers.rejected(x, 3, numbers=(0,), filled=(2,)).collect()} == {"x\teng\ttext": "number", "1\teng": "fields", "2\teng\t": "empty"}


def test_lexicon_json_and_script(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"word": "mot", "lang_code": "fr", "pos": "noun", "senses": [{"glosses": ["word"]}]}\n{"word": "fr", "lang_code": "en"}\nnot json "fr"\n')
    assert [r["word"] for r in readers.lexicon(readers.lines(spark, str(tmp_path / "x.jsonl")), "fr").collect()] == ["mot"]
    (tmp_path / "w.js").write_text('const OTHER = [];\nconst WORDS = [{"id": 1, "w": "a"},\n {"id": 2, "w": "b"}];\n')
    assert [r["w"] for r in readers.js_constant(spark, str(tmp_path / "w.js"), "WORDS", "id int, w string").collect()] == ["a", "b"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert readers.table_json(spark, str(tmp_path / "t.json")).count() == 2


def test_progress_quarantine(spark):
    rows = [(1, '{"v": 2, "w": {"a": {"r": 1, "w": 0, "s": 1}}}'), (2, "{broken"), (3, '{"v": 2, "w": {"a": {"r": -1, "w": 0, "s": 1}}}'), (4, '{"v": 2}')]
    good, bad = readers.progress(spark.createDataFrame(rows, "learner long, raw string"))
    assert sorted(r["learner"] for r in good.collect()) == [1, 4]
    assert {r["learner"]: r["reason"] for r in bad.collect()} == {2: "unreadable", 3: "record"}


def test_stages_are_written_once(spark, tmp_path):
    where = writers.stage(spark.range(3), f"file://{tmp_path}/stage", "1")
    assert writers.stage(spark.range(9), f"file://{tmp_path}/stage", "1") == where and spark.read.parquet(where).count() == 3
    writers.snapshot(spark.range(1), f"file://{tmp_path}/snap", 1)
    with pytest.raises(Exception):  # noqa: B017
        writers.snapshot(spark.range(1), f"file://{tmp_path}/snap", 1)


def test_language_hooks(spark):
    fr = LANGUAGES["fr"]
    df = spark.createDataFrame([("le chat", "Un. Deux!  ")], "form string, text string")
    r = df.select(fr.bare(F.col("form")).alias("b"), fr.sentences(F.col("text")).alias("s"), fr.level(F.lit(700)).alias("l")).first()
    assert (r["b"], r["s"], r["l"]) == ("chat", ["Un", "Deux"], "A2")
