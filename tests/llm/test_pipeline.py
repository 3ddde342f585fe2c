"""The pipeline's stages on planted documents, each against what it must keep."""

import random

import pytest

import corpus_pipeline
from glosswork.llm import packing

FUNCTION = "the of and to in is that it was for".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng, d = random.Random(6), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: [rng.choice(FUNCTION) if k % 3 == 0 else word() for k in range(n)]
    docs, labels, what = [], [], {}

    def add(text, kind, toxic=None):
        i = len(docs)
        docs.append((i, text, "en", "s", len(text or "")))
        what[i] = kind
        if toxic is not None:
            labels.append((i, 1, toxic))

    for k in range(300):
        add(" ".join(prose(rng.randrange(60, 200))), "clean", 0 if k % 2 else None)
    for k in range(80):
        w = prose(rng.randrange(60, 200))
        w.insert(rng.randrange(len(w)), rng.choice(["zonko", "wurrkel"]))
        add(" ".join(w), "toxic", 1 if k % 2 else None)
    add(None, "junk")
    add("", "junk")
    add("too short", "junk")
    add("same again " * 60, "junk")
    add(" ".join(f"{w}###" for w in prose(100)), "junk")
    base = prose(150)
    for _ in range(6):
        near = list(base)
        near[rng.randrange(150)] = word()
        add(" ".join(near), "copy")
    docs += [docs[0], docs[-1]]  # repeated rows
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), what


def test_stages_keep_what_they_must(spark, planted):
    d, what = planted
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        out = f"{d}/{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    of = lambda ids: sorted({what[i] for i in ids})
    everything = [i for i in what if what[i] != "junk"]
    assert sorted(set(kept[0])) == everything and len(kept[0]) == len(everything) + 2
    toxic = [i for i in kept[1] if what[i] == "toxic"]
    clean = [i for i in set(kept[1]) if what[i] == "clean"]
    assert len(toxic) <= 2 and len(clean) >= 295
    assert of(kept[2]) in (["clean", "copy"], ["clean", "copy", "toxic"])
    assert sum(what[i] == "copy" for i in kept[2]) == 1 and len(kept[2]) == len(set(kept[2]))
    assert sorted(set(kept[3])) == sorted(kept[2])
    rows = docs.collect()
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // packing.CAPACITY)


def test_run_gives_the_same_rows(spark, planted):
    d, _ = planted
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = sorted(map(tuple, corpus_pipeline.run(spark, d).select(*cols).collect()))
    b = sorted(map(tuple, spark.read.parquet(f"{d}/packing").select(*cols).collect()))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_empty_tables_nulls_and_clashes(spark, tmp_path, labels):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(FUNCTION) if k % 3 == 0 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for k in range(120))
    rows = [(k, text(), "en", None, 1, "x", 7) for k in range(6)] + [(None, text(), None, "s", None, "x", 7), (6, None, "en", "s", 0, "x", 7), (0, "", "en", "s", 0, "x", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, length int"
    for name, some in (("whole", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/whole").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == [(False, k) for k in range(6)] + [(True, None)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
