"""The query's stored forms: every part of the format is in them, and the two decoders agree."""

import base64

import numpy as np
import pytest

from glosswork.llm import media, webp, webp_many

TEXTS = ["", "one", "The quick brown fox, 1234; jumps over the lazy dog. " * 90, "ab" * 9000, "\x00\x01é漢😀" * 700, "".join(chr(33 + (k * k) % 90) for k in range(7000))]


def test_every_transform_and_symbol_is_in_the_stored_forms():
    kinds, symbols = set(), np.zeros(3, int)
    for stored in media.store([media.payload(t) for t in TEXTS]):
        for f in media._files(stored):
            transforms, told = webp.told(f)
            assert transforms in ([webp.PREDICTOR, webp.GREEN, webp.CROSS], [webp.PALETTE])
            kinds |= set(transforms)
            symbols += told
    assert kinds == {webp.PREDICTOR, webp.CROSS, webp.GREEN, webp.PALETTE} and (symbols > 0).all()


def test_a_usual_text_has_references_and_places_of_the_cache():
    (stored,) = media.store([media.payload("the same words again and other ones, " * 60)])
    for f in media._files(stored):
        transforms, told = webp.told(f)
        assert transforms == [webp.PREDICTOR, webp.GREEN, webp.CROSS] and told[1] > 0


@pytest.mark.parametrize("seed", range(6))
def test_many_at_once_equal_one_by_one(seed):
    rng = np.random.default_rng(seed)
    raw = [rng.integers(0, int(rng.integers(1, 257)), 192 * int(rng.integers(1, 33)), dtype="uint8").tobytes() for _ in range(40)]
    raw += [bytes(192 * 32), (b"abc" * 64 + b"xyz" * 64) * 9]
    files = webp_many.encode_many(raw, media.WIDTH)
    for r, f, p in zip(raw, files, webp_many.decode_many(files), strict=True):
        assert media._samples(p) == r and (webp.decode(f) == p).all()


def test_a_stored_form_depends_on_its_text_alone():
    rng = np.random.default_rng(4)
    raw = [bytes(rng.choice(list(b"abcde fgh\n.AB0"), 192 * int(rng.integers(1, 33))).astype("uint8")) for _ in range(300)]
    raw += [(b"some words that come again and again, " * 200)[: 192 * k] for k in (1, 5, 32)]
    together = webp_many.encode_many(raw, media.WIDTH)
    for k in [0, 1, 57, 200, 299, 300, 301, 302]:
        assert webp_many.encode_many([raw[k]], media.WIDTH) == [together[k]]
        assert webp_many.encode_many([*raw[10:20], raw[k], raw[3]], media.WIDTH)[10] == together[k]


def test_predictors_are_inverted_in_every_mode():
    rng = np.random.default_rng(1)
    size = np.array([64 * h for h in (1, 2, 9, 32)])
    c = rng.integers(0, 256, (int(size.sum()), 3)).astype("int16")
    edges = webp_many._edges(size, 64)
    for mode in range(1, 14):
        d = (c - webp_many._predict(mode, c, edges, 64)) & 255
        assert (webp_many.unpredicted(d, size, np.full(4, mode), 64) == c).all()


@pytest.mark.parametrize("data, size", [("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", (1, 1)), ("UklGRh4AAABXRUJQVlA4TBEAAAAvAQAAAAfQ//73v/+BiOh/AAA=", (1, 2))])
def test_files_of_other_encoders(data, size):
    """Two tiny files that public feature tests for the format use."""
    raw = base64.b64decode(data)
    assert webp.decode(raw).shape == size and (webp_many.decode_many([raw])[0] == webp.decode(raw)).all()


def test_damaged_files_are_refused():
    f = webp_many.encode_many([TEXTS[2].encode()[:1920]], media.WIDTH)[0]
    with pytest.raises((ValueError, IndexError)):
        webp_many.decode_many([f[:200]])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "x", 5, "y")], "doc_id long, text string, media string, height int, pixels string")
    got = media.decode_column(media.encode_column(docs)).collect()[0]
    assert got["height"] == 1 and len(got["pixels"]) == 64
    assert media.digests(docs.withColumnRenamed("pixels", "feature")).columns == [x.split()[0] for x in media._RESULT.split(", ")]
