"""Queries without SQL against plain loops over a small fixture."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from glosswork.llm import bpe, lm, media, packing, quality_pu, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty, long and repeated texts; labels for most."""
    rng, path = random.Random(11), f"{tmp_path_factory.mktemp('brute')}"
    words = ["the", "The", "of", "rain", "RAIN", "sun", "zonk", "wurk", "a,b", "42", "é", "漢字", "x" * 30]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "the rain " * 3000), (5, "same text"), (6, "same text"), (7, "no-space" * 900)]
    rows += [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(8, 160)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    labels = [(k, int("zonk" in (t or "")), int("wurk" not in (t or ""))) for k, t in rows if k % 3 or k % 5]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows)


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_packing_pieces(spark, folder):
    path, docs = folder
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    want = {}
    for k, text in docs.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for i, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[k, i] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.query(spark, path).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert len({r["sequence_id"] for r in got}) == -(-sum(x[1] for x in want.values()) // 2048)


def test_toxicity_scores(spark, folder):
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(toxicity.fold_of("doc_id", 4) != 2)
    m = toxicity.train(table, labels)
    weight = dict(zip(m.buckets.tolist(), m.weights.tolist(), strict=True))
    assert weight
    got = {r["doc_id"]: r for r in toxicity.query(spark, path).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        t, seen = (text or "").lower(), set()
        for n in toxicity.GRAMS:
            for i in range(len(t) - n + 1):
                h = 0
                for j, ch in enumerate(t[i : i + n]):
                    h = (h * 0x01000193 + ord(ch)) % (1 << 32) if j else ord(ch)
                seen.add((h * (2654435761 + 2 * n)) % (1 << 32) >> (32 - toxicity.BITS))
        z = m.bias + sum(weight.get(b, 0.0) for b in seen)
        assert abs(got[k]["score"] - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9
        assert got[k]["held_out"] == (fold(k, 4) == 2) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_toxicity_weights_are_log_count_ratios():
    """With no step of the regression, features and their ratios by counting."""
    texts = ["zonk zonk", "a zonk", "zonk b", "zonk c", "sun", "rain", "a sun", "b rain", "sun c", "rain d"]
    y = np.array([1] * 4 + [0] * 6)
    m = toxicity.fit(texts, y)
    z = toxicity.Model(m.buckets, np.ones(len(m.buckets)), 0.0)
    doc, feature = toxicity.present(texts, z.lookup())
    assert len(m.buckets) and {(d, f) for d, f in zip(doc.tolist(), feature.tolist(), strict=True) if y[d] == 0} == set()
    assert (m.weights > 0).all()


def test_quality_scores(spark, folder):
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet").filter(quality_pu.fold_of("doc_id", 5) != 0)
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(quality_pu.fold_of("doc_id", 5) != 0)
    m = quality_pu.train(table, labels)
    assert m.layers is not None
    a, b, c, d = m.layers
    got = {r["doc_id"]: r for r in quality_pu.query(spark, path).collect()}
    for k, text in docs.items():
        x = (plain_features(text or "") - m.mean) / m.scale
        hidden = [math.tanh(sum(x[i] * a[i, j] for i in range(len(x))) + b[j]) for j in range(a.shape[1])]
        z = sum(h * w for h, w in zip(hidden, c, strict=True)) + d
        assert abs(got[k]["score"] - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[k]["held_out"] == (fold(k, 5) == 0)


def plain_features(t):
    raw, n = t.encode(), len(t.encode())
    share = Counter(next((k for k, s in enumerate(quality_pu._CLASSES) if chr(x) in s), len(quality_pu._CLASSES)) for x in raw)
    lower = "".join(ch.lower() if ch.isascii() else ch for ch in t)
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    lines = t.split("\n")
    nw = max(len(w), 1)
    distinct, pairs = len(set(w)) / nw, len(set(zip(w, w[1:], strict=False))) / max(len(w) - 1, 1)
    same = sum(x == y for x, y in zip(w, w[1:], strict=False)) / nw
    return np.array([math.sqrt(share[k] / max(n, 1)) for k in range(len(quality_pu._CLASSES) + 1)] + [math.log1p(n), math.log1p(len(w)), n / nw / 10, distinct, pairs, same, len(set(lines)) / len(lines), math.log1p(len(lines)), distinct * math.log1p(len(w)), math.log1p(n / len(lines))])


def test_quality_does_not_see_held_out_labels(spark, folder):
    path, _ = folder
    table, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    learn = quality_pu.fold_of("doc_id", 5) != 0
    a = quality_pu.train(table.filter(learn), labels.filter(learn))
    turned = labels.withColumn("quality", 1 - labels["quality"]).filter(~learn).unionByName(labels.filter(learn))
    b = quality_pu.train(table.filter(learn), turned.filter(learn))
    assert all(np.array_equal(x, y) for x, y in zip(a.layers, b.layers, strict=True))


def lm_tokens(text):
    lower = "".join(ch.lower() if ch.isascii() else ch for ch in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def test_lm_counts_and_base(spark, folder):
    path, docs = folder
    counts = Counter(w for k, t in docs.items() if fold(k, 7) != 2 for w in lm_tokens(t))
    total, types = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.query(spark, path).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        ws, r = lm_tokens(text), got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(w in counts for w in ws), total, fold(k, 7) == 2)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws)) < 1e-6 * len(ws)


def test_lm_scores_token_by_token(spark, folder):
    """The state, both factors of the softmax and the share of other words, one token after another."""
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    counts = lm.word_counts(table)
    words = lm.frequent(counts)
    # A network of few words, so that there are others.
    words.ids[words.ids > 4] = 0
    net = lm.trained(table, words)
    p = {k: v.astype("float64") for k, v in net.p.items()}
    got = {r["doc_id"]: r["score"] for r in lm.scored(table, words, net, counts).collect()}
    unigram = lambda c: (c + 1) / (words.tokens + words.types + 1)
    mass = 1 - sum(unigram(int(c)) for c, i in zip(words.counts, words.ids, strict=True) if i >= 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for k in [1, 2, 5, *range(8, 30)]:
        h, last, total, n = np.zeros(lm.STATE), lm.END, 0.0, lm.STATE
        hashes, _ = lm.tokens([docs[k]])
        for x in hashes:
            a, u = p["in"][last], h @ p["u"] + p["bu"]
            z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * u[2 * n :])
            h = (1 - z) * c + z * h
            at = int(words.find(np.array([x]))[0])
            i = lm.END if x == lm.END_HASH else int(words.ids[at]) if at >= 0 else lm.OTHER
            kind = soft(h @ p["c"] + p["bc"])
            if i < 2:
                total += math.log10(kind[i])
                if i == lm.OTHER:
                    total += math.log10(unigram(int(words.counts[at]) if at >= 0 else 0) / mass)
            else:
                block, place = divmod(i - 2, lm.BLOCK)
                total += math.log10(kind[2 + block]) + math.log10(soft(h @ p["w"][block] + p["bw"][block])[place])
            last = i
        assert abs(total - got[k]) < 2e-4 * len(hashes) + 1e-3


def test_lm_many_short_and_one_very_long(spark, tmp_path):
    rows = [(k, "a b") for k in range(200)] + [(201, "c d e " * 40_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.query(spark, str(tmp_path)).collect()}
    assert got[201]["n_tokens"] == 120_001 and got[201]["score"] > got[201]["base_score"]


def test_media_columns(spark, folder):
    path, docs = folder
    for r in media.query(spark, path).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        whole = raw + b" " * (192 if not raw else -len(raw) % 192)
        stored = media.store([whole])[0]
        told = []
        for k in range(3):
            c = whole[k::3]
            n = Counter(c)
            told.append(f"{sum(c)},{sum(x * x for x in c)},{min(n, key=lambda v: (-n[v], v))}")
        want = (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"64x{len(whole) // 192};" + ";".join(told))
        assert tuple(r)[1:] == want
