"""Quality classifier by positive-unlabelled learning.

A small network is fitted by the non-negative unbiased risk: with P the trusted
positives (documents labelled good), U documents without any label that may be learnt from, and c the
share of good ones in U,

    risk = c * mean_P loss(+) + max(0, mean_U loss(-) - c * mean_P loss(-)),

and where the second term of a batch falls below zero, its gradient is turned,
which keeps the risk from being driven negative by memorising P. Documents
labelled bad are not used. c is estimated first: a plain classifier of P
against U ranks one half of each that it has not seen, and the least ratio of
the shares of U and of P above a cut, with allowance for the sizes, bounds c.

Features are shares, lengths and repetitions over the whole text, made once where
texts are read; labels meet numbers, not texts. P is a sample: at most SAMPLE
labelled documents, those of lowest hash. U is every unlabelled document: its
rows are dealt to tasks of about TASK_ROWS, each of which goes on from the
network so far with its own rows and all of P, and the copies are averaged, by
rows, in a tree, once a round. Means, spreads and the counts above each cut, by
which the prior is estimated, are sums over all rows in the same way.

Defined results: null and empty texts are scored by the features of a text
without characters. A doc_id with several labels counts as good only if all of
them are; null labels don't train. Without positives or without unlabelled
documents every score is 0.5. Repeated rows give repeated rows, an empty table
an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, fold_of, keyed, table, unkeyed, with_made
from .words import batches, mix, word_hashes

SAMPLE = 6000
THRESHOLD = 0.3
#: Unlabelled rows of a task; rounds of training, and passes over a task's rows in each, for the plain classifier and for the risk; rows that one task sums.
TASK_ROWS, ROUNDS, PLAIN_EPOCHS, EPOCHS, FAN_IN = 16384, 4, 5, 15, 64

#: Classes of ASCII characters whose shares are features; others are letters beyond ASCII.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#$%&*", "<>{}[]()", "/\\@:;=_~^`", "\"'-+", "\t\r\v\f\x00")
_CLASS = np.full(256, len(_CLASSES), "int64")
for _k, _s in enumerate(_CLASSES):
    _CLASS[list(_s.encode())] = _k
_N = len(_CLASSES) + 1


def _distinct(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each group 0 to n - 1."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def features(texts: list[str]) -> np.ndarray:
    """A row for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n, size = len(raw), np.array([len(r) for r in raw], "int64")
    shares = np.stack([np.bincount(_CLASS[np.frombuffer(r, "uint8")], minlength=_N) if r else np.zeros(_N, "int64") for r in raw]) if n else np.zeros((0, _N))
    shares = shares / np.maximum(size, 1)[:, None]
    h, words = word_hashes(raw, lower=True)
    doc = np.repeat(np.arange(n), words)
    nw = np.maximum(words, 1)
    distinct = _distinct(doc, h, n) / nw
    pair_doc, pair = doc[:-1], h[:-1] * np.uint64(3) + mix(h[1:]) if len(h) else h
    inside = doc[:-1] == doc[1:]
    same = np.bincount(pair_doc[inside & (h[:-1] == h[1:])], minlength=n) / nw
    pairs = _distinct(pair_doc[inside], pair[inside], n) / np.maximum(words - 1, 1)
    lines = np.array([t.count("\n") + 1 for t in texts])
    once = np.array([len(set(t.split("\n"))) for t in texts]) / np.maximum(lines, 1)
    log = np.log1p
    return np.column_stack([np.sqrt(shares), log(size), log(words), size / nw / 10, distinct, pairs, same, once, log(lines), distinct * log(words), np.log1p(size / np.maximum(lines, 1))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, (x - self.mean) / self.scale)[1], -35, 35)))


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d


class _Adam:
    def __init__(self, layers: tuple, rate: float):
        self.at, self.m, self.v, self.rate, self.t = list(layers), [0.0] * 4, [0.0] * 4, rate, 0

    def step(self, grads: list) -> None:
        self.t += 1
        for k, g in enumerate(grads):
            g = g + 1e-4 * self.at[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.at[k] = self.at[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _grads(layers: tuple, x: np.ndarray, dz: np.ndarray) -> list:
    hidden, _ = _forward(layers, x)
    back = np.outer(dz, layers[2]) * (1 - hidden**2)
    return [x.T @ back, back.sum(0), hidden.T @ dz, dz.sum()]


def _start(width: int, rng: np.random.Generator, hidden: int = 24) -> tuple:
    return rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0


def _network(layers: tuple, p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, rng: np.random.Generator, rate: float = 3e-3) -> tuple:
    """The network after more passes. prior None: P against U, plainly. Else the non-negative unbiased risk with the logistic loss."""
    opt = _Adam(layers, rate)
    steps = max(1, max(len(p), len(u)) // 256)
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
        for i, j in zip(ps, us, strict=True):
            if not len(i) or not len(j):
                continue
            x = np.concatenate([p[i], u[j]])
            z = _forward(tuple(opt.at), x)[1]
            s = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            sp, su = s[: len(i)], s[len(i) :]
            if prior is None:
                dz = np.concatenate([(sp - 1) / len(i), su / len(j)]) / 2
            else:
                # loss(+) = log(1 + e^-z), loss(-) = log(1 + e^z)
                minus = lambda q: np.logaddexp(0, q).mean()
                negative = minus(z[len(i) :]) - prior * minus(z[: len(i)])
                if negative >= 0:
                    dz = np.concatenate([prior * (sp - 1) / len(i) - prior * sp / len(i), su / len(j)])
                else:
                    dz = np.concatenate([prior * sp / len(i), -su / len(j)])
            opt.step(_grads(tuple(opt.at), x, dz))
    return tuple(opt.at)


def cuts_of(p: np.ndarray) -> np.ndarray:
    """Cuts of scores at which the prior is looked for: the quantiles of P, and even steps between its ends."""
    return np.unique(np.concatenate([np.quantile(p, np.linspace(0, 1, 200)), np.linspace(p.min(), p.max(), 200)]))


def estimate_prior(p: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: float) -> float:
    """The share of positives in U: the least ratio of the shares of U and of P above a cut. p: scores of P; above: rows of U, of n, at or above each cut."""
    up, uu = 1 - np.searchsorted(np.sort(p), cuts) / len(p), above / n
    slack = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + n**-0.5)
    ok = up > 0
    best = np.argmin((uu[ok] + slack) / up[ok])
    return float(np.clip(uu[ok][best] / up[ok][best], 0.01, 0.99))


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the features of each text, as the bytes of 64-bit floats."""

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            texts = pdf[text].fillna("").tolist()
            for a, b in batches(texts):
                yield pd.DataFrame({key: pdf[key][a:b], "x": [row.tobytes() for row in features(texts[a:b])]})

    return unkeyed(keyed(docs, key, text).mapInPandas(run, f"{key} string, x binary"), key)


def _rows(x: pd.Series | list) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, x)), "float64").reshape(-1, _WIDTH)


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of vectors (i, v: bytes of 64-bit floats), added in a tree, so that the driver gets no more than FAN_IN of them."""
    add = lambda vs: np.sum([np.frombuffer(bytes(v), "float64") for v in vs], 0)
    some = lambda pdf: pd.DataFrame({"i": [int(pdf["i"].iloc[0]) // FAN_IN], "v": [add(pdf["v"]).tobytes()]})
    while parts.count() > FAN_IN:
        parts = checkpoint(parts.groupBy(F.floor(F.col("i") / FAN_IN)).applyInPandas(some, "i long, v binary"))
    got = parts.orderBy("i").collect()
    return add([r["v"] for r in got]) if got else None


class Unlabelled:
    """All unlabelled rows, dealt to tasks; what each task makes of its own is summed."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        self.rows = checkpoint(rows.select("x").repartition(max(1, -(-n // TASK_ROWS)))) if n else None
        self.n = n

    def sum(self, make: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        """The sum of make(features of a task's rows, its number) over tasks with rows."""

        def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task, got = TaskContext.get().partitionId(), [_rows(pdf["x"]) for pdf in batch]
            if sum(map(len, got)):
                x = np.concatenate(got)
                yield pd.DataFrame({"i": [task], "v": [make(x[np.lexsort(x.T)], task).astype("float64").tobytes()]})  # the order of arrival is of no account

        return summed(checkpoint(self.rows.mapInPandas(run, "i long, v binary")))


def _packed(layers: tuple) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in layers])


def _unpacked(v: np.ndarray, like: tuple) -> tuple:
    ends = np.cumsum([np.size(x) for x in like])
    return tuple(part.reshape(np.shape(x)) if np.ndim(x) else float(part[0]) for part, x in zip(np.split(v, ends[:-1]), like, strict=True))


def fit(p: np.ndarray, u: Unlabelled, seed: int = 5) -> Model:
    """p: features of positives, in whatever order."""
    if not len(p) or not u.n:
        return Model(np.zeros(_WIDTH), np.ones(_WIDTH), None, 0.5)
    s = u.sum(lambda x, _: np.concatenate([x.sum(0), (x * x).sum(0)])).reshape(2, -1) + np.stack([p.sum(0), (p * p).sum(0)])
    mean = s[0] / (u.n + len(p))
    scale = np.sqrt(np.maximum(s[1] / (u.n + len(p)) - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    p = (p[np.lexsort(p.T)] - mean) / scale
    p = p[rng.permutation(len(p))]

    def rounds(layers: tuple, p: np.ndarray, prior: float | None, epochs: int, step: int) -> tuple:
        for turn in range(ROUNDS):

            def train(x: np.ndarray, task: int, layers=layers, turn=turn) -> np.ndarray:
                own = np.random.default_rng([seed, turn, task])
                x = ((x - mean) / scale)[::step]
                return np.append(len(x) * _packed(_network(layers, p, x, prior, epochs, own)), len(x))

            v = u.sum(train)
            layers = _unpacked(v[:-1] / v[-1], layers)
        return layers

    prior = 0.5
    if len(p) > 1 and u.n > 1:
        # Each task learns from every other of its rows; the others are looked at.
        plain = rounds(_start(_WIDTH, rng), p[::2], None, PLAIN_EPOCHS, 2)
        scores = _forward(plain, p[1::2])[1]
        cuts = cuts_of(scores)

        def above(x: np.ndarray, _: int) -> np.ndarray:
            z = np.sort(_forward(plain, ((x - mean) / scale)[1::2])[1])
            return np.append(len(z) - np.searchsorted(z, cuts), len(z))

        v = u.sum(above)
        if v[-1]:
            prior = estimate_prior(scores, cuts, v[:-1], v[-1])
    return Model(mean, scale, rounds(_start(_WIDTH, rng), p, prior, EPOCHS, 1), prior)


def train_on(rows: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """rows (doc_id, x): documents as features; labels: rows that may be learnt from. Documents without one of them are unlabelled."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.lit(True).alias("labelled"))
    told = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left")
    good = told.filter("q = 1").groupBy("doc_id").agg(F.min("x").alias("x"))
    n, order = good.count(), F.xxhash64("doc_id")
    # The lowest hashes are among those below a share of the range, so that no task sends `most` rows to the driver.
    low = good.filter(order < F.lit(int(-(1 << 63) + min(1.0, 2 * most / n) * ((1 << 64) - 1)))) if n > 4 * most else good
    sample = low.orderBy(order, "doc_id").limit(most).collect()  # `most` rows of features
    return fit(_rows([r["x"] for r in sample]), Unlabelled(told.filter("labelled IS NULL")))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """train_on of documents (doc_id, text)."""
    return train_on(checkpoint(featured(docs)), labels, most)


_WIDTH = features([""]).shape[1]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list:
        texts = [t or "" for t in texts]
        return [np.concatenate([shared.value.score(features(texts[a:b])) for a, b in batches(texts)])]

    return with_made(docs, text, [("score", "double")], make)


def score_on(rows: DataFrame, model: Model) -> DataFrame:
    """rows (…, x) with score in the place of x."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return with_made(rows, "x", [("score", "double")], lambda x: [shared.value.score(_rows(x))]).drop("x")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoint(featured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    learn = fold_of("doc_id", 5) != 0  # what is held out is neither positive nor unlabelled
    out = score_on(rows, train_on(rows.filter(learn), table(spark, sf_dir, "labels").filter(learn)))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
