"""Scoring by a gated recurrent language model.

Words are handled as 64-bit hashes. Over all training documents the counts of
all words are taken (a shuffle by word); the most frequent ones are the
network's own outputs, and a word outside them has the probability of the
class "other words" at its place times its share of that class's add-one
unigram mass, so the model is a proper distribution over all words, unseen
ones included.

The network is a gated recurrent unit in numpy. Its softmax is factored: first
a class, then a word of the class. It is trained by back-propagation through
time, cut at windows over which the state is carried, on all training
documents: in each of ROUNDS rounds every task trains its own copy on its
documents of that round, and the copies are averaged, by tokens, in a tree of
FAN_IN networks a task. A document belongs to one round by its hash, so that
each trains once. The network starts at the unigram probabilities.

Scoring runs whole documents in lockstep, sorted by length, window by window,
the state carried from one to the next. Words outside a broadcast table of the
most frequent ones (at most TABLE words) leave as (document, word, times) rows
and meet their counts in a join by word; frequent words never enter that join,
so no key of it is hot.

Defined results: a null or empty text is its end token alone. Repeated rows give
repeated rows; an empty table gives an empty result; without training documents
every probability is that of an unseen word. Extra columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, fold_of, keyed, table
from .words import batches, word_hashes

#: Hash of the end token. Words are never empty, so none has this value by construction; a clash is as likely as any other.
END_HASH = np.uint64(0x6A09E667F3BCC909)
#: Words of a class, word classes, size of the state.
BLOCK, CLASSES, STATE = 32, 32, 16
#: Words whose counts are broadcast, at most; bits of the index of their hashes.
TABLE, INDEX_BITS = 1 << 18, 20
#: Rounds of training; each takes one training document in ROUNDS. Networks that one task averages.
ROUNDS, FAN_IN = 2, 8
#: Runs side by side and steps of a window in training; states of a window in scoring.
LANES, WINDOW, SCORE_ROWS = 256, 16, 1 << 15

OTHER, END = 0, 1


@dataclass
class Words:
    """The most frequent words: sorted hashes, counts, ids in the network (OTHER outside it), and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tokens: int
    types: int

    def _index(self) -> np.ndarray:
        """Where the hashes of each value of the leading INDEX_BITS start; built once in each worker."""
        if "_starts" not in self.__dict__:
            lead = (self.hashes >> np.uint64(64 - INDEX_BITS)).astype("int64")
            self.__dict__["_starts"] = np.append(0, np.cumsum(np.bincount(lead, minlength=1 << INDEX_BITS))).astype("int32")
        return self.__dict__["_starts"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_starts"}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of h in the table, -1 where absent."""
        out = np.full(len(h), -1, "int32")
        starts, lead = self._index(), (h >> np.uint64(64 - INDEX_BITS)).astype("int32")
        at, left = starts[lead], np.flatnonzero(starts[lead + 1] > starts[lead])
        stop, at = starts[lead[left] + 1], at[left]
        while len(left):
            hit = self.hashes[at] == h[left]
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < stop)
            left, at, stop = left[more], at[more] + 1, stop[more]
        return out

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one unigram probability."""
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, number of each text's tokens), the end tokens included."""
    h, n = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=True)
    out = np.full(len(h) + len(n), END_HASH)
    ends = np.cumsum(n + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = h
    return out, n + 1


class Network:
    """Parameters by name; all arrays are float32."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, counts: np.ndarray, other: float, end: float, seed: int = 3) -> Network:
        """At the unigram: counts of the network's words by id from 2, of all other tokens, of ends."""
        rng = np.random.default_rng(seed)
        words = np.zeros(BLOCK * CLASSES)
        words[: len(counts)] = counts
        blocks = words.reshape(CLASSES, BLOCK)
        log = lambda x: np.log(np.maximum(x, 1e-30))
        mass = np.concatenate([[max(other, 0.5), max(end, 0.5)], blocks.sum(1)])
        n = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype("float32")
        return cls({
            "in": n(2 + BLOCK * CLASSES, 3 * STATE, scale=0.3),
            "u": n(STATE, 3 * STATE, scale=STATE**-0.5),
            "bu": np.zeros(3 * STATE, "float32"),
            "c": n(STATE, 2 + CLASSES, scale=0.01),
            "bc": log(mass / mass.sum()).astype("float32"),
            "w": n(CLASSES, STATE, BLOCK, scale=0.01),
            "bw": log(blocks / np.maximum(blocks.sum(1, keepdims=True), 1e-30)).clip(-60).astype("float32"),
        })

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """One step from the inputs' rows x and the state h: gates and the new state."""
        a = h @ self.p["u"] + self.p["bu"]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * STATE] + a[:, : 2 * STATE])))
        z, r, q = zr[:, :STATE], zr[:, STATE:], a[:, 2 * STATE :]
        n = np.tanh(x[:, 2 * STATE :] + r * q)
        return z, r, q, n, n + z * (h - n)

    def outputs(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target from its state; with grads, adds the gradients of minus their sum and returns that of h."""
        p, n = self.p, len(target)
        kind = np.where(target < 2, target, 2 + (target - 2) // BLOCK)
        # Classes along the first axis: sums over them are then sums of whole rows.
        e = p["c"].T @ h.T
        e += p["bc"][:, None]
        e -= e.max(0)
        row = np.arange(n)
        out = e[kind, row]
        np.exp(e, out=e)
        s = e.sum(0)
        out -= np.log(s)
        dh = None
        if grads is not None:
            e /= s
            e[kind, row] -= 1
            grads["c"] += h.T @ e.T
            grads["bc"] += e.sum(1)
            dh = e.T @ p["c"].T
        words = np.flatnonzero(target >= 2)
        order = words[np.argsort(kind[words], kind="stable")]
        edges = np.searchsorted(kind[order], np.arange(2, CLASSES + 3)).tolist()
        states, places, got = h[order], (target[order] - 2) % BLOCK, np.empty(len(order), out.dtype)
        back = None if grads is None else np.empty_like(states)
        for c in range(CLASSES):
            i, j = edges[c], edges[c + 1]
            if i == j:
                continue
            x, t = states[i:j], places[i:j]
            e = p["w"][c].T @ x.T
            e += p["bw"][c][:, None]
            e -= e.max(0)
            row = np.arange(j - i)
            mine = e[t, row]
            np.exp(e, out=e)
            s = e.sum(0)
            got[i:j] = mine - np.log(s)
            if grads is not None:
                e /= s
                e[t, row] -= 1
                grads["w"][c] += x.T @ e.T
                grads["bw"][c] += e.sum(1)
                back[i:j] = e.T @ p["w"][c].T
        out[order] += got
        if grads is not None:
            dh[order] += back
        return out, dh

    def score(self, ids: np.ndarray, counts: np.ndarray, rows: int = SCORE_ROWS) -> np.ndarray:
        """Natural log probability of each sequence of ids (one after another in ids, `counts` long, each ending with END).

        A window ends when its states number `rows`; the state goes on to the next one.
        """
        out = np.zeros(len(counts))
        if not len(counts):
            return out
        order = np.argsort(-counts, kind="stable")
        size, start = counts[order], (np.cumsum(counts) - counts)[order]
        running = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()  # lanes longer than t, a prefix
        before = np.append(ids[:1], ids[:-1])
        before[start] = END
        h, place, held = np.zeros((len(counts), STATE), "float32"), [], 0
        x, states = np.empty((len(counts), 3 * STATE), "float32"), np.empty((rows + len(counts), STATE), "float32")
        for t, m in enumerate(running):
            at = start[:m] + t
            np.take(self.p["in"], before[at], axis=0, out=x[:m])
            h[:m] = states[held : held + m] = self.step(x[:m], h[:m])[-1]
            place.append(at)
            held += m
            if held >= rows or t == len(running) - 1:
                flat = np.concatenate(place)
                got, _ = self.outputs(states[:held], ids[flat])
                lane = np.concatenate([order[: len(q)] for q in place])
                out += np.bincount(lane, got, len(counts))
                place, held = [], 0
        return out

    def train(self, ids: np.ndarray, counts: np.ndarray, rate: float = 1.2e-2) -> int:
        """One pass of truncated back-propagation over every token; returns their number. The sequences, one after another, are cut into LANES runs whose lengths differ by one at most."""
        if not len(ids):
            return 0
        wide = min(LANES, -(-len(ids) // WINDOW))
        steps, more = divmod(len(ids), wide)
        begin = np.arange(wide) * steps + np.minimum(np.arange(wide), more)
        moments = tuple({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        h, last, turn = np.zeros((wide, STATE), "float32"), np.where(begin > 0, ids[begin - 1], END), 0
        # The first `more` runs have one step more than the others: a window of their own.
        windows = [(begin, a, min(a + WINDOW, steps)) for a in range(0, steps, WINDOW)] + ([(begin[:more], steps, steps + 1)] if more else [])
        for first, a, b in windows:
            turn += 1
            targets = ids[first + np.arange(a, b)[:, None]]
            inputs = np.concatenate([last[None, : len(first)], targets[:-1]])
            h = self._window(inputs, targets, h[: len(first)], moments, turn, rate)
            last = targets[-1]
        return len(ids)

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, moments: tuple, turn: int, rate: float) -> np.ndarray:
        """One step of the parameters from a window (steps x lanes), back-propagated within it; returns the last states."""
        p, (steps, wide) = self.p, inputs.shape
        x = p["in"][inputs]
        ends = inputs == END
        before, z, r, q, n, after = (np.empty((steps, wide, STATE), x.dtype) for _ in range(6))
        for t in range(steps):
            # A new text starts from an empty state.
            if ends[t].any():
                h = h.copy()
                h[ends[t]] = 0
            before[t] = h
            z[t], r[t], q[t], n[t], h = self.step(x[t], h)
            after[t] = h
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        flat = lambda v: v.reshape(steps * wide, -1)
        _, dh = self.outputs(flat(after), targets.ravel(), grads)
        dh = dh.reshape(steps, wide, STATE)
        # What each gate's input gets for one unit of the state's gradient, for the whole window.
        dn = (1 - z) * (1 - n * n)
        gate = np.stack([(before - n) * z * (1 - z), dn * q * r * (1 - r), dn * r], 2)
        da, carry = np.empty_like(gate), np.zeros((wide, STATE), x.dtype)
        for t in range(steps - 1, -1, -1):
            d = dh[t]
            d += carry
            np.multiply(gate[t], d[:, None], out=da[t])
            carry = d * z[t] + da[t].reshape(wide, -1) @ p["u"].T
            carry[ends[t]] = 0
        dx = da.copy()
        np.multiply(dn, dh, out=dx[:, :, 2])
        da, dx, fed = flat(da), flat(dx), inputs.ravel()
        order = np.argsort(fed, kind="stable")
        first = np.flatnonzero(np.diff(fed[order], prepend=-1))
        grads["in"][fed[order[first]]] = np.add.reduceat(dx[order], first)
        grads["u"] += flat(before).T @ da
        grads["bu"] += da.sum(0)
        for k, g in grads.items():
            m, v = moments[0][k], moments[1][k]
            g /= targets.size
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= (rate / (1 - 0.9**turn)) * m / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
        return h


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of all tokens of docs (text)."""

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batch:
            texts = pdf["text"].fillna("").tolist()
            for a, b in batches(texts, 1 << 23):
                h, n = np.unique(tokens(texts[a:b])[0], return_counts=True)
                yield pd.DataFrame({"h": h.view("int64"), "n": n})

    return docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int = TABLE) -> Words:
    """The table of frequent words: those above the least count (in steps of an eighth of an octave) that leaves at most `most`."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = {r[0]: (r[1], r[2]) for r in counts.groupBy(level.alias("l")).agg(F.count("*"), F.sum("c")).collect()}
    types, n_tokens = sum(x[0] for x in levels.values()), sum(x[1] for x in levels.values())
    total, least = 0, None
    for x in sorted(levels, reverse=True):
        total += levels[x][0]
        if total > most:
            break
        least = x
    if least is None:
        return Words(np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64"), n_tokens, types)
    top = counts.filter(level >= least).toPandas().sort_values("h", ignore_index=True)
    h, c = top["h"].to_numpy().view("uint64"), top["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order].astype("int64")
    ids = np.zeros(len(h), "int16")
    words = np.lexsort((h, -c))
    words = words[h[words] != END_HASH][: BLOCK * CLASSES]
    ids[words] = np.arange(2, 2 + len(words))
    ids[h == END_HASH] = END
    return Words(h, c, ids, n_tokens, types)


def _ids(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, numbers of tokens, places in the table, ids in the network) of the texts' tokens."""
    h, n = tokens(texts)
    at = words.find(h)
    known = words.ids[at] if len(words.ids) else np.zeros(len(h), "int16")
    ids = np.where(at >= 0, known, np.int16(OTHER))
    ids[h == END_HASH] = END
    return h, n, at, ids


def trained(docs: DataFrame, words: Words, share: int = ROUNDS) -> Network:
    """The network after `share` rounds of local training and averaging, each over one in `share` of docs (doc_id, text)."""
    spark, inside = docs.sparkSession, words.ids >= 2
    by = np.argsort(words.ids[inside])
    end = words.counts[words.ids == END].sum()
    net = Network.start(words.counts[inside][by], words.tokens - words.counts[inside].sum() - end, end)
    table_ = spark.sparkContext.broadcast(words)
    kind = "salt int, seen long, net binary"

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total = int(pdf["seen"].sum()), None
        for n, raw in zip(pdf["seen"], pdf["net"], strict=True):
            part = {k: x * np.float32(n / seen) for k, x in pickle.loads(raw).items()}
            total = part if total is None else {k: total[k] + part[k] for k in part}
        return pd.DataFrame({"salt": pdf["salt"][:1] // FAN_IN, "seen": seen, "net": [pickle.dumps(total)]})

    for turn in range(share):
        now = spark.sparkContext.broadcast(net.p)

        def run(batch: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            ids, counts = [], []
            for pdf in batch:
                texts = pdf["text"].fillna("").tolist()
                for a, b in batches(texts):
                    _, n, _, i = _ids(table_.value, texts[a:b])
                    ids.append(i)
                    counts.append(n)
            if ids and sum(map(len, counts)):
                own = Network({k: x.copy() for k, x in now.value.items()})
                seen = own.train(np.concatenate(ids), np.concatenate(counts))
                if seen:
                    yield pd.DataFrame({"salt": [TaskContext.get().partitionId()], "seen": [seen], "net": [pickle.dumps(own.p)]})

        chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(share)) == turn)
        nets, width = chosen.select("text").mapInPandas(run, kind), chosen.rdd.getNumPartitions()
        while width > 1:
            nets = nets.groupBy(F.floor(F.col("salt") / FAN_IN).alias("to")).applyInPandas(average, kind)
            width = -(-width // FAN_IN)
        got = nets.collect()
        if got:
            net = Network(pickle.loads(bytes(got[0]["net"])))
    return net


def scored(docs: DataFrame, words: Words, net: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, net))
    inside = words.ids >= 1
    mass = 1 - float((10 ** words.log_share(words.counts[inside])).sum()) if len(words.ids) else 1.0

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, net = shared.value
        uid = TaskContext.get().partitionId() << 33
        for pdf in batch:
            texts, parts, whole = pdf["text"].fillna("").tolist(), [], []
            # Chunk by chunk all but the network's ids becomes sums by document or leaves; those are kept for the whole batch.
            for a, b in batches(texts):
                h, n, at, ids = _ids(w, texts[a:b])
                doc, hit = np.repeat(np.arange(a, b), n), at >= 0
                base = np.zeros(len(h))
                base[hit] = w.log_share(w.counts[at[hit]])
                add = lambda x: np.bincount(doc - a, x, b - a)  # noqa: B023, E731
                # Other words: their class at its place, and their share of its mass.
                whole.append((n, add(hit), add(base), add(np.where(ids == OTHER, base - np.log10(max(mass, 1e-300)), 0))))
                parts.append(ids)
                far = np.flatnonzero(~hit)
                order = far[np.lexsort((h[far], doc[far]))]
                if len(order):
                    d, x = doc[order], h[order]
                    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])))
                    yield pd.DataFrame({"uid": uid + d[new], "doc_id": None, "n": None, "known": None, "base": None, "model": None, "h": x[new].view("int64"), "times": np.diff(np.append(new, len(x)))})
            if not parts:
                continue
            n, known, base, model = (np.concatenate(x) for x in zip(*whole, strict=True))
            model += net.score(np.concatenate(parts), n) / np.log(10)
            yield pd.DataFrame({"uid": uid + np.arange(len(n)), "doc_id": pdf["doc_id"], "n": n, "known": known.astype("int64"), "base": base, "model": model, "h": None, "times": None})
            uid += len(n)

    made = checkpoint(keyed(docs).mapInPandas(run, "uid long, doc_id string, n long, known long, base double, model double, h long, times long"))
    whole = made.filter("n is not null").select("uid", "doc_id", "n", "known", "base", "model")
    rare = made.filter("h is not null").select("uid", "h", "times").join(counts, "h", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(words.tokens + words.types + 1)))
    sums = rare.groupBy("uid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * log).alias("log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.join(sums, "uid", "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_tokens"), (F.col("known") + zero("more")).alias("n_known"), (F.col("base") + zero("log")).alias("base_score"), (F.col("model") + zero("log")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = docs.filter(fold_of("doc_id", 7) != 2)
    counts = checkpoint(word_counts(learn))
    words = frequent(counts)
    out = scored(docs, words, trained(learn, words), counts)
    return out.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
