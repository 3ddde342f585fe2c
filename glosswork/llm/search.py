"""Ranked lexical search by Fagin's threshold algorithm.

The forward index has a row a document: its number of terms, and the terms that
the queries ask for with their numbers. It is written once. Each task holds the
documents of its rows in blocks, with a list for each term, sorted by impact.
For a query, the lists are read round-robin, some places at a time; each
document that turns up is looked up in the forward index, which gives its whole
score; what is read last from each list bounds the score of all that has not
turned up, and the query ends when this threshold lies strictly below the score
of the k-th best, so that equal scores are never lost. Bests of tasks meet by
query, in two steps.

A sixteenth of the tasks goes first. The k-th best score found there is a lower
bound for each query, from which the others start, so that most of their lists
end early and few rows leave a task. Scores are whole numbers, and impacts come
from counts over all documents: neither depends on how rows are dealt.

Queries are taken in blocks of BLOCK_BYTES of text, each over all documents;
what is sent to tasks is a block's terms with their weights.

Defined results: a null text has no term; a query without a term, or whose
terms stand in no document, has no row; each row of queries is one of its own,
repeated ones too; equal scores ascend by key, a null key first; repeated
documents rank one after another; empty tables give an empty result. Columns
that are not named do not matter. Numbers of terms times numbers of documents
must stay below 2 ** 58.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpoint, table

TOP = 20
#: Text of the queries of one block; postings of a block of documents; places first read from a list; tasks of which one goes first; ways in which the bests first meet.
BLOCK_BYTES, BLOCK_POSTINGS, DEPTH, FIRST, MEET = 4 << 20, 1 << 21, 32, 16, 64
#: Names of the sums over documents beside those of terms.
DOCUMENTS, TERMS = -1, -2

INDEX = "key long, n long, part int, ids binary, tf binary"
#: Letters and digits as they are, A-Z lower-cased, other ASCII as a blank; bytes of other code points stay.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and of all other code points beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, part, ids, tf): a row for each document with a term; ids and tf are 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            keys, n, ids, tf = [], [], [], []
            for k, words in zip(batch.column(0).to_pylist(), map(terms, batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                if words:
                    found = [(vocabulary[w], c) for w, c in Counter(words).items() if w in vocabulary]
                    keys.append(k)
                    n.append(len(words))
                    ids.append(np.array([i for i, _ in found], "<i4").tobytes())
                    tf.append(np.array([c for _, c in found], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(ids, pa.binary()), pa.array(tf, pa.binary())], names=["key", "n", "part", "ids", "tf"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, INDEX)


def counts(index: DataFrame, size: int) -> dict[int, int]:
    """Documents with each term, and under DOCUMENTS and TERMS the number of documents and of all their terms. A task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, "int64"), 0, 0
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4"), minlength=size)
            n, total = n + batch.num_rows, total + sum(batch.column("n").to_pylist())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), DOCUMENTS, TERMS], pa.int64()), pa.array([*df[at].tolist(), n, total], pa.int64())], names=["term", "c"])

    summed = index.select("n", "ids").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c"))
    return {r["term"]: r["c"] for r in summed.collect()}  # no more rows than the block of queries has terms


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Documents of a task, as a forward index and as lists sorted by impact."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, impacts: np.ndarray):
        self.keys, self.ids, self.impacts = keys, ids, impacts
        self.offsets = np.append(0, np.cumsum(sizes))
        order = np.lexsort((-impacts, ids))
        self.list_docs, self.list_impacts = np.repeat(np.arange(len(keys)), sizes)[order], impacts[order]
        self.terms, self.begin = np.unique(ids[order], return_index=True)
        self.end = np.append(self.begin[1:], len(ids))

    def score(self, docs: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents."""
        a, n = self.offsets[docs], self.offsets[docs + 1] - self.offsets[docs]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(a - first, n)
        return np.add.reduceat(self.impacts[at] * repeats[self.ids[at]], first)

    def best(self, query: dict[int, int], repeats: np.ndarray, known: np.ndarray, floor: int, top: int = TOP, depth: int = DEPTH) -> np.ndarray:
        """The `top` best (score, key) of known and these documents that reach the floor; repeats: those of the query's terms, else 0."""
        wanted = np.array(sorted(query), "int64")
        at = np.searchsorted(self.terms, wanted)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == wanted[here]
        lists = [(int(self.begin[k]), int(self.end[k]), query[t]) for k, t in zip(at[here].tolist(), wanted[here].tolist(), strict=True)]
        if not lists:
            return known
        seen, bound, a, longest = np.zeros(len(self.keys), bool), kth(known, floor, top), 0, max(e - b for b, e, _ in lists)
        while True:
            # Sorted access, round-robin: the next places of each list.
            b = a + depth
            new = np.unique(np.concatenate([self.list_docs[s + a : min(s + b, e)] for s, e, _ in lists]))
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                scores = self.score(new, repeats)
                good = (scores >= bound) & (scores > 0)
                if good.any():
                    known = np.concatenate([known, np.stack([scores[good], self.keys[new[good]]], 1)])
                    known = known[np.lexsort((known[:, 1], -known[:, 0]))[:top]]
                    bound = kth(known, floor, top)
            threshold = sum(int(self.list_impacts[s + b - 1]) * q for s, e, q in lists if s + b <= e)
            if threshold < bound or b >= longest:
                return known
            a, depth = b, 2 * depth


def kth(known: np.ndarray, floor: int, top: int = TOP) -> int:
    """The least score that can still count: that of the last of `top`, or the floor."""
    return max(floor, int(known[top - 1, 0])) if len(known) >= top else floor


def searched(index: DataFrame, queries: list[Counter], weights: np.ndarray, n: int, total: int, floors: list[int], top: int = TOP) -> DataFrame:
    """(q, score, key): the best documents of each task for each query, by its place in queries; null keys are the least long."""
    least = np.iinfo("int64").min

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        kept, held = [], 0
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column("ids").to_pylist()], "int64")
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4").astype("int64")
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), "<i4").astype("int64")
            m = 75 + 25 * np.array(batch.column("n").to_pylist(), "int64") * n // total
            impacts = weights[ids] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes)))
            keys = np.array([least if k is None else k for k in batch.column("key").to_pylist()], "int64")
            kept.append((keys[sizes > 0], sizes[sizes > 0], ids, impacts))
            held += len(ids)
            if held >= BLOCK_POSTINGS:
                yield Block(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, held = [], 0
        if held:
            yield Block(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, repeats = [np.zeros((0, 2), "int64") for _ in queries], np.zeros(len(weights), "int64")
        for block in blocks(batches):
            for q, query in enumerate(queries):
                at = np.fromiter(query, "int64", len(query))
                repeats[at] = np.fromiter(query.values(), "int64", len(query))
                found[q] = block.best(query, repeats, found[q], floors[q], top)
                repeats[at] = 0
        number = np.repeat(np.arange(len(found)), [len(x) for x in found])
        rows = np.concatenate([*found, np.zeros((0, 2), "int64")])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["q", "score", "key"])

    return index.select("key", "n", "ids", "tf").mapInArrow(run, "q int, score long, key long")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """(q, rank, score, key): the best of all tasks."""
    best = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "key"))
    some = found.withColumn("way", F.pmod(F.xxhash64("key"), F.lit(MEET))).withColumn("rank", best("q", "way")).filter(F.col("rank") <= top)
    return some.withColumn("rank", best("q")).filter(F.col("rank") <= top).select("q", "rank", "score", "key")


def blocks_of(queries: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The queries in lists of at most `most` bytes of text, or of one."""
    held, size = [], 0
    for k, t in queries.select(F.col(key), F.encode(F.coalesce(text, F.lit("")), "UTF-8")).toLocalIterator():
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append((k, bytes(t)))
        size += len(t)
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_key, rank, key, score): the `top` best documents for each row of queries."""
    out: DataFrame | None = None
    spark, number = docs.sparkSession, dict(queries.dtypes)[query_key]
    for block in blocks_of(queries, query_key, text, block_bytes):
        asked = [Counter(terms(t)) for _, t in block]
        vocabulary = {w: k for k, w in enumerate(sorted({w for q in asked for w in q}))}
        index = checkpoint(forward_index(docs, vocabulary, key, text))
        c = counts(index, len(vocabulary))
        n, total = c.get(DOCUMENTS, 0), max(1, c.get(TERMS, 0))
        weights = np.array([weight(n, c.get(k, 0)) for k in range(len(vocabulary))], "int64")
        numbered = [Counter({vocabulary[w]: x for w, x in q.items()}) for q in asked]
        run: Callable[[DataFrame, list[int]], DataFrame] = lambda x, floors: searched(x, numbered, weights, n, total, floors, top)  # noqa: B023, E731
        first = F.col("part") % FIRST == 0
        early = checkpoint(ranked(run(index.filter(first), [1] * len(block)), top))
        floors = [1] * len(block)
        for r in early.filter(F.col("rank") == top).collect():  # one row a query of the block at most
            floors[r["q"]] = r["score"]
        late = run(index.filter(~first), floors)
        named = spark.createDataFrame([(q, k) for q, (k, _) in enumerate(block)], f"q int, {query_key} {number}")
        whole = ranked(early.select("q", "score", "key").unionByName(late), top).join(named, "q")
        least = np.iinfo("int64").min
        got = checkpoint(whole.select(query_key, F.col("rank").cast("int").alias("rank"), F.when(F.col("key") > least, F.col("key")).alias(key), "score"))
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], f"{query_key} {number}, rank int, {key} long, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM docs),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
q AS (SELECT z, item_id, term, count(*) AS q FROM (SELECT z, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS z, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
s AS (SELECT z, item_id, doc_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN docs USING (r), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
