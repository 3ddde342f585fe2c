"""Near duplicates by consistent weighted sampling, banding and exact verification.

1. Document frequencies of five-word shingles are counted over all documents
   into a table of 2^20 buckets (1 MB at the workers, whatever the input).
   A weight is the shingle's times in the text by 1 plus IDF_SHARE of its
   relative inverse frequency. The share is small on purpose: a large group of
   copies makes its own shingles frequent, and a steep frequency weight would
   part such a group because it is large.
2. One pass gives each text's digest and, from 144 samples of improved
   consistent weighted sampling, 24 band keys of 6 samples: two texts of
   similarity 0.8 meet in a band with probability 0.999. Equal texts become
   one node by digest; from here on nodes only are handled.
3. Each band bucket names a centre, the node that meets most others, and its
   other nodes are compared with it, then those of other components with a
   second one. Pairs are verified by the exact weighted Jaccard similarity of
   the whole texts; links of 0.8 or more are joined to components (see
   components). In buckets that still hold several components, pairs across
   them are found by prefix filtering relative to what is common to a group of
   buckets (see _profiles): exact, so no candidate link is left out, and
   without forming the pairs of a large group whose members are near its
   middle but not near each other. Pairs inside a component would add nothing to it.
4. Each document gets its class: the least doc_id of its component.

Buckets of any size are only aggregated (least and greatest) and joined, never
gathered; a frequent centre is split into groups of SALT members.

Defined results: a null text counts as empty. Texts without a word are in a
class only with equal texts. Texts of fewer than five words have one shingle of
all their words. Repeated rows give repeated rows; of a doc_id with several
texts each row has the class of its own text. A null doc_id is kept; it never
names a class unless all ids of the class are null. An empty table gives an
empty result; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, free, table, unkeyed
from .shingles import DF_BITS, Sampler, bands, df_bucket, idf_levels, jaccard, shingles, weights
from .words import batches

SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Members that are verified against one copy of their centre's text.
SALT = 64
#: Members of a large group from which its common shingles are told.
SAMPLE = 16
#: Links of nodes that one task may join to components.
LOCAL_EDGES = 1 << 20
#: Turns of comparing a bucket's nodes with a centre.
TURNS = 2
#: Buckets of document frequencies that travel as one row.
_PART = 1 << 12


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """The table of inverse document frequencies over all documents, 1 MB."""

    def count(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << DF_BITS, "int64"), 0
        for pdf in batch:
            texts = pdf["text"].tolist()
            for a, b in batches(texts):
                df += np.bincount(df_bucket(shingles(texts[a:b])[0]), minlength=1 << DF_BITS)
            n += len(texts)
        if n:
            parts = df.reshape(-1, _PART)
            yield pd.DataFrame({"part": np.arange(len(parts)), "salt": TaskContext.get().partitionId() % 1000, "docs": n, "df": [zlib.compress(p.tobytes(), 1) for p in parts]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        df = np.zeros(_PART, "int64")
        for x in pdf["df"]:
            df += np.frombuffer(zlib.decompress(x), "int64")
        return pd.DataFrame({"part": pdf["part"][:1], "salt": 0, "docs": int(pdf["docs"].sum()), "df": [zlib.compress(df.tobytes(), 1)]})

    kind = "part int, salt int, docs long, df binary"
    rows = docs.select("text").mapInPandas(count, kind).groupBy("part", "salt").applyInPandas(total, kind).groupBy("part").applyInPandas(total, kind).collect()
    df = np.zeros((1 << DF_BITS) // _PART * _PART, "int64").reshape(-1, _PART)
    for r in rows:
        df[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["df"])), "int64")
    return idf_levels(df.ravel(), rows[0]["docs"] if rows else 0)


def _signed(docs: DataFrame, levels) -> DataFrame:
    """(doc_id, digest, total, keys) of each row; keys is null for texts without a word."""

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(BANDS * ROWS)
        for pdf in batch:
            texts = pdf["text"].tolist()
            for a, b in batches(texts):
                x, times, n = shingles(texts[a:b])
                w = weights(x, times, levels.value)
                keys = bands(sampler.sample(x, w, n), BANDS)
                total = np.bincount(np.repeat(np.arange(len(n)), n), w, len(n))
                part = pdf[a:b]
                yield pd.DataFrame({"doc_id": part["doc_id"], "digest": part["digest"], "total": total, "keys": [k if m else None for k, m in zip(keys, n, strict=True)]})

    made = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, digest binary, total double, keys array<long>")
    return unkeyed(made)


def _against(pairs: DataFrame, centres: DataFrame, texts: DataFrame, levels, schema: str, compare, members: int = SALT) -> DataFrame:
    """compare(a, b, own, found) for each pair (a, b), where own is (shingles, weights) of node a and found a list of those of b's centres.

    centres: (b, node). Each group of `members` pairs of a b is one run of rows,
    the centres' texts first, so a task holds those and a batch, however many
    pairs b has.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / members).cast("int").alias("n"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.col("n")).cast("int").alias("salt"))
    first = centres.join(groups, "b").select("node", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(0).alias("kind"))
    roles = dealt.select(F.col("a").alias("node"), "b", "salt", F.lit(1).alias("kind")).unionByName(first)
    rows = roles.join(texts, "node").select("node", "b", "salt", "kind", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind", "node")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, last = None, [], None
        for pdf in batch:
            node, b, salt, kind = (pdf[c].tolist() for c in ("node", "b", "salt", "kind"))
            all_texts = pdf["text"].tolist()
            for i, j in batches(all_texts):
                found = []
                x, times, n = shingles(all_texts[i:j])
                w, ends = weights(x, times, levels.value), np.append(0, np.cumsum(n))
                for k in range(i, j):
                    own = slice(ends[k - i], ends[k - i + 1])
                    if at != (b[k], salt[k]):
                        at, held, last = (b[k], salt[k]), [], None
                    if (node[k], kind[k]) == last:  # a repeated row
                        continue
                    last = (node[k], kind[k])
                    if kind[k] == 0:
                        held.append((x[own].copy(), w[own].copy()))
                    else:
                        found += compare(node[k], b[k], (x[own], w[own]), held)
                yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, levels, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts' weighted Jaccard similarity is `least` or more. texts: (node, text)."""

    def compare(a: int, b: int, own: tuple, held: list) -> list[tuple]:
        return [(a, b)] if jaccard(*own, *held[0]) >= least else []

    centres = pairs.select("b").distinct().select("b", F.col("b").alias("node"))
    return _against(pairs, centres, texts, levels, "a long, b long", compare)


def _profiles(groups: DataFrame, texts: DataFrame, levels, least: float) -> DataFrame:
    """(a, b, total, on, prefix) of each member a of a group b: what tells without comparing all members with each other which can be similar.

    Let C be a set of shingles that is common to the group: those that two of
    about SAMPLE members hold, or none where the group is not much larger than
    that. on is a's weight on C; prefix holds a's first shingles outside C, in
    the order of their hashes, up to more than 1 - least of the total.

    Two texts of similarity `least` share a shingle of their prefixes in the
    order "outside C by hash, then C". So either they share one of `prefix`, or
    both have all they have outside C in `prefix` and none of it in common;
    then their overlap is at most the lesser of their weights on C. That holds
    for any C, so nothing is lost by taking C from a sample.
    """
    size = groups.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * SAMPLE)
    sample = groups.join(size, "b").filter(F.pmod(F.xxhash64("a", F.lit(9)), F.ceil(F.col("n") / SAMPLE)) == 0).select("b", F.col("a").alias("node"))
    memo: dict = {}

    def compare(a: int, b: int, own: tuple, held: list) -> list[tuple]:
        if memo.get("b") != (b, len(held)):
            every, n = np.unique(np.concatenate([x for x, _ in held] or [np.zeros(0, "uint64")]), return_counts=True)
            memo.update(b=(b, len(held)), common=every[n > 1])
        (x, w), common, total = own, memo["common"], float(own[1].sum())
        inside = np.zeros(len(x), bool)
        if len(common):
            at = np.searchsorted(common, x)
            at[at == len(common)] = 0
            inside = common[at] == x
        out = ~inside
        reach = np.cumsum(w[out])
        prefix = x[out][: int(np.searchsorted(reach, (1 - least) * total * (1 + 1e-9), "right")) + 1]
        return [(a, b, total, float(w[inside].sum()), prefix.view("int64"))]

    return _against(groups, sample, texts, levels, "a long, b long, total double, on double, prefix array<long>", compare, 16 * SAMPLE)


def _residual(held: DataFrame, pivots: DataFrame, texts: DataFrame, levels, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket and of different components whose similarity can be `least`; exact.

    held: (key, node, root) of buckets with several components; pivots: (key, b),
    by which buckets of the same middle form one group.
    """
    groups = checkpoint(held.join(pivots, "key").select(F.col("node").alias("a"), "b", "root").distinct())
    told = checkpoint(_profiles(groups.select("a", "b"), texts, levels, least).join(groups, ["a", "b"]))
    # Pairs that share a shingle outside C, where several components do: at least one of the two is not in the largest of them.
    own = told.select("b", "a", "root", "total", F.explode("prefix").alias("s"))
    parts = own.groupBy("b", "s", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("b", "s").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("n")).filter("n > 1").select("b", "s", "main")
    own = own.join(mixed, ["b", "s"])
    side = lambda rows, n: rows.select("b", "s", F.col("a").alias(n), F.col("root").alias(f"r{n}"), F.col("total").alias(f"t{n}"))
    shared = side(own.filter("root <> main"), "x").join(side(own, "y"), ["b", "s"])
    # No similarity is above the lesser total by the greater.
    shared = shared.filter((F.col("rx") != F.col("ry")) & (F.least("tx", "ty") * (1 + 1e-9) >= least * F.greatest("tx", "ty")))
    shared = shared.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    # Pairs that share none: both mostly in C, and short enough for each other; one of them not in the pivot's component.
    t = told.filter(F.col("total") - F.col("on") <= (1 - least) * F.col("total") * (1 + 1e-6)).select("b", "a", "root", "total", "on")
    short = t.groupBy("b").agg(F.min("total").alias("least_total"))
    need = (1 + least) / least * (1 + 1e-9)  # overlap * need >= sum of the totals
    opened = t.join(short, "b").filter(F.col("least_total") + F.col("total") <= need * F.col("on"))
    opened = opened.join(groups.filter("a = b").select("b", F.col("root").alias("rb")), "b").filter("root <> rb")
    x = opened.select("b", F.col("a").alias("x"), F.col("root").alias("rx"), F.col("total").alias("tx"), F.col("on").alias("ox"))
    y = t.select("b", F.col("a").alias("y"), F.col("root").alias("ry"), F.col("total").alias("ty"), F.col("on").alias("oy"))
    near = x.join(y, "b").filter((F.col("rx") != F.col("ry")) & (F.col("tx") + F.col("ty") <= need * F.least("ox", "oy")))
    near = near.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    return shared.unionByName(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _joined(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for pdf in batch:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
            up.setdefault(min(a, b), min(a, b))
    nodes = [x for x in up if root(x) != x]
    yield pd.DataFrame({"node": np.array(nodes, "int64"), "root": np.array([root(x) for x in nodes], "int64")})


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots, which are the least nodes of their components.

    Up to `local` edges (16 bytes each) one task joins them; more take
    large-star and small-star in turns, until a turn changes nothing.
    """
    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= local:
        return checkpoint(e.repartition(1).mapInPandas(_joined, "node long, root long"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text)."""
    return _classes(docs, least).select("doc_id", "class_id")


def _classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, root, class_id) for each row of docs; root tells classes apart even where their class_ids agree."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))
    signed = checkpoint(_signed(docs, levels))
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("total").alias("total"), F.first("keys").alias("keys"))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("keys").alias("key"))
    size = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = members.join(size, "key")
    # A node that meets many others is near the middle of its group and makes a good centre.
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = checkpoint(members.select("key", "node").join(degree, "node"))
    # The texts of nodes that have a candidate, once; a node's row is the least doc_id of its digest.
    wanted = nodes.join(degree.select("node"), "node").select("node", "digest", F.col("doc_id").alias("_id"))
    own = wanted["digest"].eqNullSafe(docs["digest"]) & wanted["_id"].eqNullSafe(docs["doc_id"])
    texts = checkpoint(docs.join(wanted, own).select("node", "text"))

    owner, links, seen = members.withColumn("root", F.col("node")), None, None
    first = F.max(F.struct("degree", (-F.col("node")).alias("m"), "node", "root"))
    for turn in range(TURNS):
        # The centre of a bucket; in later turns one of those that aren't in the component of the first.
        pick = owner.groupBy("key").agg(first.alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key", "c")
        if turn:
            rest = owner.join(pick, "key").filter(F.col("root") != F.col("c.root"))
            pick = rest.groupBy("key").agg(first.alias("c"))
        pairs = owner.join(pick, "key").filter(F.col("root") != F.col("c.root")).select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        found = checkpoint(verified(pairs, texts, levels, least))
        links = found if links is None else links.unionByName(found)
        seen = pairs if seen is None else seen.unionByName(pairs)
        roots = components(links)
        owner = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn < TURNS - 1:
            owner = checkpoint(owner)

    # What is left: pairs across the components of a bucket, other than with a centre.
    pivots = owner.groupBy("key").agg(first["node"].alias("b"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key", "b")
    held = checkpoint(owner.join(pivots.select("key"), "key").select("key", "node", "root"))
    cross = _residual(held, pivots, texts, levels, least)
    known = seen.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cross = checkpoint(cross.join(known, ["a", "b"], "left_anti"))
    roots = components(links.unionByName(verified(cross, texts, levels, least)))

    node = nodes.select("node", "digest", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = node.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = node.join(first, "root").select("digest", "root", "class_id")
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "root", "class_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs (with doc_id and text) for each class of near duplicates: one whose doc_id names the class.

    Classes whose ids are all null keep one row as well. Rows that repeat the
    chosen id are told apart by their text's digest and reduced to one; only the
    chosen rows are shuffled whole.
    """
    digest = free("_digest", docs)
    own = docs.withColumn(digest, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    named = _classes(docs)
    chosen = named.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("_c")).select("_c.*")
    same = own[digest].eqNullSafe(chosen["digest"]) & own["doc_id"].eqNullSafe(chosen["doc_id"])
    kept = own.join(chosen.select("doc_id", "digest"), same).select(*[own[c] for c in own.columns])
    return kept.dropDuplicates(["doc_id", digest]).drop(digest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
