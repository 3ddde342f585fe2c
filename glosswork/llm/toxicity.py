"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its lower-cased characters that occur in
it, whatever their number of times. From the labelled sample, each n-gram gets
the log ratio of its smoothed shares among toxic and other documents; the
n-grams whose counts tell most about the label stay, and a logistic regression
is fitted on their presence times their ratio. Scoring is one pass over the
documents without a shuffle: hash all n-grams of a batch of whole texts, look
up the few that matter, and add their weights once for each document.

The fit takes at most SAMPLE labelled documents (those of lowest hash), a
documented bound on the model's cost that also bounds what is broadcast: ids of
the sample one way, the model (at most FEATURES n-grams) the other.

Defined results: null and empty texts get the score of a text without any
known n-gram. A doc_id with several labels counts as toxic if one of them is;
with several texts, the least one trains. Null labels don't train; if one class
is missing, every score is the share of toxic labels (0.5 without labels).
Repeated rows give repeated rows, an empty table an empty result. Columns that
clash with a result's name are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fold_of, table, with_made
from .words import batches

#: Lengths of the n-grams, bits of their hash, features kept, least documents of a feature.
GRAMS, BITS, FEATURES, LEAST = (3, 4, 5), 20, 6000, 4
SAMPLE = 8192
THRESHOLD = 0.3


def _buckets(texts: list[str], grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the bucket of the n-gram at each place, and the places where texts start.

    Texts are parted by marks, as many as the longest n-gram, so none reaches over two texts.
    """
    gap = "\x00" * max(grams)
    text = gap + gap.join(t.lower() for t in texts) + gap
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t.lower()) for t in texts])
    starts = np.cumsum(np.append(0, lengths[:-1] + len(gap)))
    h, n = codes.copy(), 1
    for g in grams:
        while n < g:
            h = h[:-1] * np.uint32(0x01000193) + codes[n:]
            n += 1
        # The multiplier depends on n, so that n-grams of different lengths part.
        yield (h * np.uint32(2654435761 + 2 * g)) >> np.uint32(32 - bits), starts


def present(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once. known: feature of each bucket, -1 for none; without it a feature is its bucket."""
    pairs = []
    for bucket, starts in _buckets(texts):
        if known is None:
            at, feature = np.arange(len(bucket)), bucket.astype("int64")
        else:
            feature = known[bucket]
            at = np.flatnonzero(feature >= 0)
            feature = feature[at].astype("int64")
        pairs.append((np.searchsorted(starts, at, "right") - 1) << 32 | feature)
    both = np.unique(np.concatenate(pairs))
    return both >> 32, both & 0xFFFFFFFF


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    _lookup: np.ndarray | None = None

    def lookup(self) -> np.ndarray:
        """The feature of each bucket, built once in a worker."""
        if self._lookup is None:
            self._lookup = np.full(1 << BITS, -1, "int32")
            self._lookup[self.buckets] = np.arange(len(self.buckets))
        return self._lookup

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lookup": None}

    def score(self, texts: list[str], known: np.ndarray) -> np.ndarray:
        doc, feature = present(texts, known)
        z = self.bias + np.bincount(doc, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str], labels: np.ndarray, features: int = FEATURES, steps: int = 300, l2: float = 1e-3) -> Model:
    y = np.asarray(labels, "float64")
    order = sorted(range(len(texts)), key=texts.__getitem__)  # the order of arrival is of no account
    texts, y = [texts[k] for k in order], y[order]
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        p = (n1 / len(y)) if len(y) else 0.5
        return Model(np.zeros(0, "int64"), np.zeros(0), float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for a, b in batches(texts, 1 << 20):
        doc, f = present(texts[a:b])
        toxic = y[a:b][doc] == 1
        pos += np.bincount(f[toxic], minlength=1 << BITS)
        neg += np.bincount(f[~toxic], minlength=1 << BITS)
    p, q = pos + 1, neg + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # Chi-squared of presence against the label, for what a bucket tells at all.
    df = pos + neg
    expected = df * n1 / len(y)
    chi = (pos - expected) ** 2 / np.maximum(expected * (n0 / len(y)), 1e-9) / np.maximum(1 - df / len(y), 1e-3)
    chi[df < LEAST] = 0
    best = np.argsort(-chi, kind="stable")[:features]
    best = np.sort(best[chi[best] > 6.6])
    model = Model(best, ratio[best], 0.0)
    known = model.lookup()
    docs, feats = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for a, b in batches(texts, 1 << 20):
        doc, f = present(texts[a:b], known)
        docs.append(doc + a)
        feats.append(f)
    doc, f = np.concatenate(docs), np.concatenate(feats)
    value = ratio[best][f]
    # Logistic regression by Adam on the whole sample.
    w, bias = np.zeros(len(best)), float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(doc, w[f] * value, len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        g = np.bincount(f, e[doc] * value, len(best)) / len(y) + l2 * w
        gb = e.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(best, w * ratio[best], bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled documents, those whose id hashes lowest.

    The ids are bounded by rows, so they can be broadcast; texts of a repeated
    doc_id meet in one aggregate, so the sample stays bounded as well.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> Model:
    """Fits the model in one task on an executor; the driver receives the model only."""

    def one(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batch if len(x)]
        pdf = pd.concat(parts) if parts else pd.DataFrame({"text": [], "label": []})
        yield pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].fillna("").tolist(), pdf["label"].to_numpy()))]})

    sample = labelled_sample(docs, labels, label, rows).select("text", "label")
    made = sample.repartition(1).mapInPandas(one, "model binary").first()
    return pickle.loads(bytes(made[0])) if made else fit([], np.zeros(0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list:
        m, texts = shared.value, [t or "" for t in texts]
        known = m.lookup()
        return [np.concatenate([m.score(texts[a:b], known) for a, b in batches(texts, 1 << 20)])]

    return with_made(docs, text, [("score", "double")], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 4) != 2)
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
