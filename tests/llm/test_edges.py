"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glosswork.llm import bpe, chat, lm, media, packing, quality_pu, quality_rules, sharding, toxicity

LONG = "word and the other " * 20000
ROWS = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "the one", "d"), (4, "the one", "d"), (None, "of no id", "e"), (5, LONG, None), (6, "The same text", "f"), (7, "The same text", "g"), (8, "\x00퟿ é😀 \\ </turn>", "h")]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, nothing):
    clash = docs.withColumnRenamed("score", "kept")
    got = quality_rules.apply_rules(clash).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0
    assert by[5]["n_words"] == 80000 == by[5]["n_repeat_words"] and by[5]["base_failed"]
    assert not any(r["kept"] for r in got)
    assert quality_rules.apply_rules(nothing).count() == 0


def test_repeated_windows_match_brute_force(spark):
    import random

    rng, rows = random.Random(2), []
    for k in range(200):
        rows.append((k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))))
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        w = r["text"].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r["n_repeat_words"] == len({i + j for i, x in enumerate(g) if g.count(x) > 1 for j in range(3)})


def test_packing(docs, nothing):
    out = packing.pack(packing.pieces_of(docs)).collect()
    assert len({r["doc_id"] for r in out}) == 9
    assert sorted(r["length"] for r in out if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert sum(r["length"] for r in out if r["doc_id"] == 5) == 80001
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(bins) == -(-sum(r["length"] for r in out) // packing.CAPACITY)
    assert packing.pack(packing.pieces_of(nothing)).count() == 0


@pytest.mark.parametrize("lengths", [[1100] * 200, [1100] * 150 + [948] * 60 + [7] * 30])
def test_packing_ends_where_pieces_do_not_fit_together(spark, lengths):
    rows = [(str(k), 0, 0, n, 0, k) for k, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), island_pieces=64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == sorted((k, n) for k, n in enumerate(lengths))
    bins = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        at = bins.get(r["sequence_id"], 0)
        assert r["offset"] == at
        bins[r["sequence_id"]] = at + r["length"]
    assert max(bins.values()) <= packing.CAPACITY
    # No more than one bin for each piece that fits beside no other of its kind, and a few for the rest.
    assert len(bins) <= lengths.count(1100) + 10


def test_sharding(docs, nothing):
    got = sharding.shard(docs.withColumnRenamed("score", "slot"), shards=3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    for k in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.shard(nothing).count() == 0


def test_sharding_repeats_itself_and_follows_the_seed(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    one = lambda seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df, seed=seed).collect()}
    a = one(1)
    assert a == one(1) != one(2)
    # No trace of the order of the input in the order within a shard.
    order = [d for d, x in sorted(a.items(), key=lambda i: i[1][1]) if x[0] == 0]
    ups = sum(x < y for x, y in zip(order, order[1:], strict=False)) / len(order)
    assert 0.4 < ups < 0.6


def test_places_depend_on_records_and_seed_only(spark):
    rows = [(k % 900, "same text" if k % 3 else f"text {k % 900}", None if k % 7 else k % 900) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    places = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, given in ((4, df), (8, df.repartition(3)), (211, df.orderBy(F.rand(5)).coalesce(2)), (8, df.repartition(17, "text"))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = sharding.shard(given, shards=3, bucket_bytes=8 << 10)
            assert out.select("doc_id").distinct().count() == 900
            places.append(sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert all(p == places[0] for p in places)


def test_buckets_are_tasks_and_stay_in_bounds_with_copies(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 7, id) AS doc_id", "repeat('x', 100) AS text")
    out = sharding.shard(df, shards=4, bucket_bytes=16 << 10).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in out.groupBy("task").count().collect()]
    # 3000 records of about 172 bytes in buckets of 16 KB; 2000 of them are the same row.
    assert len(tasks) >= 25 and max(tasks) < 3 * 3000 / len(tasks)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [750] * 4


def test_written_shards(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path, shards=2)
    assert spark.read.parquet(path).count() == len(ROWS)


def test_sharding_counts_buckets_by_bytes_and_digests_what_was_written(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS doc_id", "CASE id WHEN 7 THEN NULL ELSE repeat(concat('é', id), 20000) END AS text")
    path = f"{tmp_path}/documents.parquet"
    df.write.parquet(path)
    # About 6 MB of text: rows alone would make one bucket of a megabyte.
    assert sharding.shard(spark.read.parquet(path), bucket_bytes=1 << 20).select(F.spark_partition_id().alias("p")).distinct().count() >= 5
    out = sharding.query(spark, str(tmp_path))
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(x)) for k, x in texts.items()}
    assert all("/shards-" in f for f in out.inputFiles())
    # Whole texts lie in the folders, in the order of the slots within each file.
    sharding.write_shards(spark.read.parquet(path), f"{tmp_path}/out", shards=2, bucket_bytes=1 << 20)
    assert {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{tmp_path}/out").collect()} == texts
    for k in range(2):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [s for f in files for s in pq.read_table(f, partitioning=None)["slot"].to_pylist()]
        assert slots == list(range(50))


def test_bpe(docs, nothing):
    got = bpe.decode_column(bpe.encode_column(docs)).collect()
    c = bpe.Coder().tokenizer
    assert len(got) == len(ROWS)
    for r in got:
        ids = c.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == c.decode(ids, skip_special_tokens=False)
    assert bpe.encode_column(nothing).count() == 0


def test_media(docs, nothing):
    got = media.decode_column(media.encode_column(docs)).collect()
    for r in got:
        raw = b"".join((p & 0xFFFFFF).to_bytes(3, "big") for p in r["pixels"])
        text = (r["text"] or "").encode()
        assert raw.startswith(text) and set(raw[len(text) :]) <= {32} and len(raw) % 192 == 0 and raw
    assert media.digests(nothing).count() == 0
    told = {r["doc_id"]: r for r in media.digests(docs).collect()}
    assert told[6]["media_sha256"] == told[7]["media_sha256"] and told[1]["payload_bytes"] == 192


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, 1), (4, 0), (6, 0), (7, None), (99, 1), (None, 1)]])
def test_toxicity(spark, docs, nothing, labels):
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "score"}
    assert toxicity.score(nothing, model).count() == 0


@pytest.mark.parametrize("labels", [[], [(4, 1), (6, 1), (6, None), (99, 0)]])
def test_quality_pu(spark, docs, nothing, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_pu.score(docs, quality_pu.train(docs, table)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    model = quality_pu.train(nothing, table)
    assert quality_pu.score(nothing, model).count() == 0


def test_lm(docs, nothing):
    for learn in (docs, nothing):
        counts = lm.word_counts(learn)
        words = lm.frequent(counts)
        got = lm.scored(docs, words, lm.trained(learn, words, share=2), counts).collect()
        assert len(got) == len(ROWS)
        assert all(r["score"] <= 0 and r["base_score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 5) == 80001
    assert lm.scored(nothing, words, lm.trained(nothing, words), counts).count() == 0


def test_lm_learns_from_documents_of_every_residue(spark):
    every = spark.range(400).selectExpr("id AS doc_id", "concat('a b ', id) AS text")
    words = lm.frequent(lm.word_counts(every))
    untrained = lm.trained(every.limit(0), words).p["u"]
    for k in range(8):
        learn = every.filter(f"pmod(xxhash64(doc_id, 41), 8) = {k}")
        assert (lm.trained(learn, words).p["u"] != untrained).any()


def test_chat(spark):
    rows = [(1, 2, "assistant", "b <x> # \\ \\h"), (1, 1, "us:er", None), (1, 1, None, "tie"), (1, 2, "assistant", "b <x> # \\ \\h"), (None, None, "assistant", "</turn>\n### assistant: "), (2, 1, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.events_of(df)))
    from pyspark.sql import functions as F

    got = {r["conv_id"]: r for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("", "tie"), ("us:er", ""), ("assistant", "b <x> # \\ \\h"), ("assistant", "b <x> # \\ \\h")]
    assert got[1]["l"] == "b <x> # \\ \\h" * 2
    assert got[None]["l"] == "</turn>\n### assistant: " and got[2]["t"][0]["text"] == LONG
    assert chat.render(chat.fold(chat.events_of(df.limit(0)))).count() == 0


def test_the_log_has_every_kind_of_event_and_folds_back(spark):
    df = spark.range(300).selectExpr("id div 7 AS conv_id", "id % 7 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id % 11 = 0, NULL, concat('text <', id, '> \\\\h')) AS text", "'x' AS kind", "id AS seq", "'y' AS formatted")
    log = chat.events_of(df)
    n = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(n) == {"message", "delta", "regenerate", "edit"} and min(n["regenerate"], n["edit"]) > 60
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold(log.orderBy(F.rand(3))).collect()}
    assert got == {(r["conv_id"], r["turn"] + 1): (r["role"], r["text"] or "") for r in df.collect()}


def test_chat_events(spark):
    log = [("message", "user", "hi"), ("edit", None, "hello"), ("delta", None, " you")]
    said = [("message", "assistant", ""), ("delta", None, "wro"), ("delta", None, "ng"), ("regenerate", None, None), ("delta", None, "right"), (None, None, None)]
    rows = [(1, k, 1, *x) for k, x in enumerate(log)] + [(1, 10 + k, 2, *x) for k, x in enumerate(said[:-1])]
    df = spark.createDataFrame(rows, "conv_id long, seq long, msg long, kind string, role string, text string")
    got = {r["msg"]: (r["role"], r["text"]) for r in chat.fold(df.orderBy("text")).collect()}
    assert got == {1: ("user", "hello you"), 2: ("assistant", "right")}


def test_inner_names_are_free(spark):
    """Columns named like those that the operators make on the way stay as they are."""
    from glosswork.llm import near_dups

    names = ("_v", "_digest", "_copy", "_r", "_h", "_b", "_n", "_k", "_start")
    own = spark.createDataFrame([(k, "the one of these " * 20 + str(k % 2), *[f"{c}{k}" for c in names]) for k in range(4)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    same = lambda rows: all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
    ruled = quality_rules.apply_rules(own).collect()
    assert len(ruled) == 4 and same(ruled) and "n_words" in ruled[0].asDict()
    kept = near_dups.representatives(own).collect()
    assert [r["doc_id"] for r in sorted(kept)] and same(kept) and set(kept[0].asDict()) == set(own.columns)
    for bucket in (1 << 20, 200):
        dealt = sharding.shard(own.unionByName(own.filter("doc_id = 0")), 3, bucket_bytes=bucket).collect()
        assert len(dealt) == 5 and same(dealt)


def test_starts_of_buckets(spark):
    got = sharding.bucket_starts(spark.createDataFrame([(b, b % 5 + 1) for b in range(100)], "_b int, _k long"), 8).collect()
    assert {r["_b"]: r["_start"] for r in got} == {b: sum(k % 5 + 1 for k in range(b)) for b in range(100)}
