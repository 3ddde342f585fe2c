"""Media columns: bytes stored as lossless WebP images and read back.

A payload is cut in segments of at most 64 x 32 pixels of three bytes, each a
file of its own; the stored form is their concatenation (each names its size).
Every segment has prefix codes, back-references and the colour cache. Segments
of few colours have a palette, all others a predictor, subtract-green and
cross-colour; reading inverts what a segment has.

Defined results: null and empty texts are the payload of 192 blanks. Texts of
any length are taken whole. Repeated rows give repeated rows; an empty table
gives an empty result. Equal texts have equal stored forms and features. Extra
columns don't reach the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .base import keyed, table, unkeyed, with_made
from .webp import encode
from .webp_many import decode_many, encode_many
from .words import batches

WIDTH, HEIGHT, UNIT = 64, 32, 192
#: Colours of a palette, at most; segments written and files read together.
COLOURS, SEGMENTS = 16, 2048


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def _segments(raw: bytes) -> list[bytes]:
    n = 3 * WIDTH * HEIGHT
    return [raw[a : a + n] for a in range(0, len(raw), n)]


def _argb(raw: bytes) -> np.ndarray:
    c = np.frombuffer(raw, "uint8").reshape(-1, WIDTH, 3).astype("uint32")
    return 0xFF000000 | c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2]


def _samples(p: np.ndarray) -> bytes:
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype("uint8").tobytes()


def _few(raw: bytes) -> bool:
    """Whether a segment has few colours; most don't within their first row."""
    return len({raw[k : k + 3] for k in range(0, UNIT, 3)}) <= COLOURS and len({raw[k : k + 3] for k in range(0, len(raw), 3)}) <= COLOURS


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    parts = [_segments(p) for p in payloads]
    files: dict[bytes, bytes] = {}
    for a in range(0, len(flat := [s for segments in parts for s in segments]), SEGMENTS):
        some = {s for s in flat[a : a + SEGMENTS] if s not in files}
        few = {s for s in some if _few(s)}
        files |= {s: encode(_argb(s), palette=True, cache=2) for s in few}
        rest = sorted(some - few)
        files |= zip(rest, encode_many(rest, WIDTH) if rest else [], strict=True)
    return [b"".join(files[s] for s in segments) for segments in parts]


def _files(media: bytes) -> list[bytes]:
    out, a = [], 0
    while a < len(media):
        n = 8 + struct.unpack("<I", media[a + 4 : a + 8])[0]
        out.append(media[a : a + n])
        a += n
    return out


def load(media: list[bytes]) -> list[np.ndarray]:
    """The pixels (height x 64, ARGB) of each stored form."""
    files = [_files(m) for m in media]
    pixels = iter(decode_many([f for fs in files for f in fs]))
    return [np.concatenate([next(pixels) for _ in fs] or [np.zeros((0, WIDTH), "uint32")]) for fs in files]


def features(samples: bytes, height: int) -> str:
    """Size, and for each channel its sum, its sum of squares and its most frequent value."""
    c = np.frombuffer(samples, "uint8").reshape(-1, 3)
    told = []
    for k in range(3):
        n = np.bincount(c[:, k], minlength=256)
        v = np.arange(256)
        told.append(f"{n @ v},{n @ (v * v)},{n.argmax()}")
    return f"{WIDTH}x{height};" + ";".join(told)


def encode_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (binary)."""

    return with_made(docs, text, [("media", "binary")], lambda texts: [store([payload(t or "") for t in texts])], 256)


def decode_column(docs: DataFrame, media: str = "media") -> DataFrame:
    """docs with height (int) and pixels (array of int, row by row, ARGB)."""

    def make(stored: list) -> list:
        got = load([m or b"" for m in stored])
        return [[len(p) for p in got], [p.ravel().view("int32") for p in got]]

    return with_made(docs, media, [("height", "int"), ("pixels", "array<int>")], make, 256)


_RESULT = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads it back, and tells about both; the pixels stay in the workers."""

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            every = pdf["text"].fillna("").tolist()
            for a, b in batches(every, 6 << 20):
                part, texts = pdf[a:b], every[a:b]
                media = store([payload(t) for t in texts])
                rows = []
                for doc, t, m, p in zip(part["doc_id"], texts, media, load(media), strict=True):
                    raw = _samples(p)
                    rows.append((doc, len(t.encode("utf-8", "surrogatepass")), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(raw, len(p))))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")])

    return unkeyed(keyed(docs).mapInPandas(run, _RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
