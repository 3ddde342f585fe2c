"""Codecs against their inverses, models against brute force and held-out accuracy."""

import random

import numpy as np
import pytest

from glosswork.llm import bpe, lm, packing, quality_pu, toxicity, webp, webp_many


@pytest.mark.parametrize("seed", range(40))
def test_webp_round_trip(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 40, 2)
    colours = rng.integers(0, 1 << 32, rng.integers(1, 300), dtype="uint32")
    p = rng.choice(colours, (h, w)) if seed % 2 else rng.integers(0, 1 << 32, (h, w), dtype="uint32")
    how = {
        "palette": len(np.unique(p)) <= 256 and seed % 3 == 0, "predictor": int(rng.choice([0, 2, 3])), "cross": int(rng.choice([0, 2])), "green": bool(seed % 5 == 0),
        "lz": bool(rng.random() < 0.7), "cache": int(rng.choice([0, 1, 8])), "groups": int(rng.choice([0, 2])), "seed": seed,
    }
    data = webp.encode(p, **how)
    assert (webp.decode(data) == p).all() and (webp_many.decode_many([data])[0] == p).all()


def test_webp_refuses_what_is_damaged():
    p = np.arange(64, dtype="uint32").reshape(8, 8) * 7
    data = webp.encode(p)
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + data[4:])
    with pytest.raises((ValueError, IndexError)):
        webp.decode(data[:30])


def test_near_places_are_those_of_the_format():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


PARTS = ["a", "B", " ", "\n", ".", ",", "\u0301", "é", "'s", "'", "<|endoftext|>", "\xa0", "\t", "1", "$$", "ß", "İ", "漢", "\x00", "e", "\r\n", "Σ", "the", "\x0b", "'re", "\u0323", "\u1100", "\u1161", "\u11a8", "!!", "<|", "|>", "😀", "aaaa", "ing", "ﬁ"]


@pytest.mark.parametrize("leaf, window", [(2, 1), (5, 3), (17, 1), (8192, 32)])
def test_bpe_tree_equals_the_library(leaf, window):
    c, cached, rng = bpe.Coder(), [bpe.Coder(cache_bytes=20_000, parted=x) for x in (False, True)], random.Random(leaf)
    for k in range(600):
        some = PARTS if k % 2 else rng.sample(PARTS, rng.randrange(1, 8))
        s = "".join(rng.choice(some) for _ in range(rng.randrange(70)))
        ids = c.tokenizer.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(c.encode([s], leaf, window)[0], "<u4").tolist() == ids
        assert all(np.frombuffer(x.encode([s], size, window)[0], "<u4").tolist() == ids for x in cached for size in (leaf, 8192))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "漢字仮名", "#$%!"])
def test_bpe_without_white_space_is_linear_work(letters):
    c, rng = bpe.Coder(), random.Random(4)
    s = "".join(rng.choice(letters) for _ in range(1_000_000))
    got = c.encode([s])[0]
    assert c.encoded_chars < 1.05 * len(s)
    assert np.frombuffer(got, "<u4").tolist() == c.tokenizer.encode(s, add_special_tokens=False).ids


def test_bpe_cache_is_bounded_by_bytes():
    c = bpe.Coder(cache_bytes=50_000)
    for k in range(40):
        c.encode([" ".join(f"w{k}x{j}" for j in range(100)) + " " + "z" * (5000 if k % 2 else 1000)])
        assert c.held <= 50_000 + 100 * (2 * bpe.ENTRY_BYTES + 60) and all(len(w) <= bpe.CACHED_CHARS for w in [*c.cache, *c.spans])


@pytest.mark.parametrize("seed", range(5))
def test_evolved_packings_are_packings_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([700, 900, 1100, 500, rng.randrange(1, 2048)]) for _ in range(300)]
    bins = packing.evolve(lengths, seed=seed)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= packing.CAPACITY for b in bins)
    assert len(bins) <= len(packing._packed(np.array(lengths), packing.CAPACITY, [], list(range(300))))


def test_immigrants_hold_the_patterns_that_can_be_had():
    bins = packing.immigrant([[5, 3, 2], [9, 9]], np.array([5, 2, 3, 9, 1]), 10)
    assert sorted(bins[0]) == [0, 1, 2] and sorted(i for b in bins for i in b) == list(range(5))


def _texts(rng, n, bad):
    out, y = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        y.append(int(k % 4 == 0))
        out.append(bad(rng, words) if y[-1] else " ".join(words))
    return out, np.array(y)


def test_toxicity_held_out():
    def bad(rng, words):
        words.insert(rng.randrange(len(words)), rng.choice(["zonko", "wurrk", "plixx"]))
        return " ".join(words)

    texts, y = _texts(random.Random(1), 600, bad)
    m = toxicity.fit(texts[:400], y[:400])
    s = m.score(texts[400:], m.lookup())
    assert ((s >= 0.3) == y[400:]).mean() > 0.97
    again = toxicity.fit(texts[:400][::-1], y[:400][::-1])
    assert np.array_equal(again.buckets, m.buckets) and np.allclose(again.weights, m.weights)


@pytest.mark.parametrize("task_rows", [quality_pu.TASK_ROWS, 120])
def test_quality_held_out_and_prior(spark, monkeypatch, task_rows):
    """In one task, and in nine that are averaged and summed in a tree."""

    def bad(rng, words):
        return " ".join(w + "###" for w in words).upper()

    monkeypatch.setattr(quality_pu, "TASK_ROWS", task_rows)
    monkeypatch.setattr(quality_pu, "FAN_IN", 3)
    texts, y = _texts(random.Random(3), 2400, bad)
    x = quality_pu.features(texts)
    good = x[:1000][y[:1000] == 0]
    m = quality_pu.fit(good, quality_pu.Unlabelled(spark.createDataFrame([(bytearray(r.tobytes()),) for r in x[1000:2000]], "x binary")))
    s = m.score(x[2000:])
    assert ((s < 0.3) == y[2000:]).mean() > 0.97 and abs(m.prior - 0.75) < 0.1


def test_every_unlabelled_row_is_seen(spark, monkeypatch):
    monkeypatch.setattr(quality_pu, "TASK_ROWS", 7)
    monkeypatch.setattr(quality_pu, "FAN_IN", 2)
    rows = quality_pu.Unlabelled(spark.createDataFrame([(bytearray(np.full(quality_pu._WIDTH, float(k)).tobytes()),) for k in range(100)], "x binary"))
    assert rows.sum(lambda x, _: np.array([len(x), x[:, 0].sum(), (x[:, 1] ** 2).sum()])).tolist() == [100, 4950, sum(k * k for k in range(100))]


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = lm.Network.start(np.arange(1, 400)[::-1], 500, 100)
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    h, t = rng.normal(size=(6, lm.STATE)), np.array([0, 1, 2, 30, 35, 300])
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, dh = net.outputs(h, t, grads)
    for name in ("c", "w", "bw"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was = net.p[name][at]
        f = []
        for e in (1e-5, -1e-5):
            net.p[name][at] = was + e
            f.append(-net.outputs(h, t)[0].sum())
        net.p[name][at] = was
        assert abs((f[0] - f[1]) / 2e-5 - grads[name][at]) < 1e-4
    e = np.zeros_like(h)
    e[3, 2] = 1e-5
    assert abs((net.outputs(h - e, t)[0].sum() - net.outputs(h + e, t)[0].sum()) / 2e-5 - dh[3, 2]) < 1e-4


def test_scores_do_not_depend_on_the_window_and_training_helps():
    rng = np.random.default_rng(1)
    net = lm.Network.start(np.ones(64), 5, 20)
    counts = rng.integers(1, 60, 3000)
    # Two languages of 32 words: the first word tells which.
    ids = np.concatenate([np.append(rng.integers(0, 32, n - 1) + 2 + 32 * (k % 2), lm.END) for k, n in enumerate(counts)])
    before = net.score(ids, counts)
    assert np.allclose(before, net.score(ids, counts, rows=7), atol=1e-3)
    for _ in range(6):
        net.train(ids, counts)
    assert net.score(ids, counts).sum() > before.sum() + 0.3 * len(ids)


@pytest.mark.parametrize("counts", [[1, 5000], [1] * 3 + [700], [9], [40] * 200 + [9000]])
def test_every_token_is_trained_on(counts, monkeypatch):
    net = lm.Network.start(np.ones(1024), 5, 20)
    ids = np.concatenate([np.append(np.arange(n - 1) % 1024 + 2, lm.END) for n in counts])
    seen, outputs = [], lm.Network.outputs
    monkeypatch.setattr(lm.Network, "outputs", lambda self, h, target, grads=None: seen.append(target) or outputs(self, h, target, grads))
    assert net.train(ids, np.array(counts)) == len(ids)
    assert (np.bincount(np.concatenate(seen), minlength=1026) == np.bincount(ids, minlength=1026)).all()


def test_the_network_is_a_distribution():
    net = lm.Network.start(np.arange(1, 1025), 7, 9)
    h = np.random.default_rng(2).normal(size=(1, lm.STATE)).astype("float32")
    every = np.arange(2 + lm.BLOCK * lm.CLASSES)
    assert abs(np.exp(net.outputs(np.repeat(h, len(every), 0), every)[0]).sum() - 1) < 1e-3
