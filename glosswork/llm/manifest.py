"""Merkle manifest of a dataset, built by superblock reduction.

Every row is a leaf: the digest of its columns, each with its length in bytes.
Leaves of a group (source) ascend by key; every FANOUT in a row become their
digest, level by level, until one is left, the group's subroot. Subroots in
the order of their groups become the root in the same way.

An index divided by FANOUT ** LEVELS is a superblock. Each is collapsed by one
call of applyInPandas, whatever the size of its group: its nodes go up LEVELS
levels, and the roots of superblocks are the nodes of the next round, so the
rounds are as many as the logarithm of the largest group. Proofs come down the
same way: the proof of a node is its lower proof, within its superblock,
followed by the upper proof of that superblock.

Indices come without a window over a group: rows are dealt by ranges of (group,
key) and sorted there, and a row's place is its place within its task after the
numbers that earlier tasks hold of the group. So a group of a third of all rows
spreads like any other. All tables between the rounds are checkpointed.

Defined results: nulls are `-` in a leaf, and a null group or key comes first;
repeated rows are leaves of their own, rows of equal group and key ascend by
leaf; a row of a null key is never tampered with; an empty table gives an empty
result. Columns that are not named do not matter. Rows with equal group and key
meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpoint, fold_of, table, unkeyed

FANOUT, LEVELS = 16, 2
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One key in so many is tampered with, to see that a changed row is found.
TAMPERED = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = "s string, i long, n long, d string, ds array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row's values: each its length in bytes, a colon and itself, `-` for a null."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def collapse(nodes: list[str], levels: int | None, fanout: int = FANOUT) -> list[list[str]]:
    """The levels above and with nodes, lowest first: so many, or without a number until one node is left."""
    out = [nodes]
    while (len(out[-1]) > 1) if levels is None else (len(out) <= levels):
        below = out[-1]
        out.append([digest("".join(below[k : k + fanout])) for k in range(0, len(below), fanout)])
    return out


def sides(levels: list[list[str]], k: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """What stands left and right of node k and of the nodes above it, level by level below the last."""
    out = []
    for nodes in levels[:-1]:
        a = k - k % fanout
        out.append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + fanout])))
        k //= fanout
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its path give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def said(path: list[tuple[str, str]]) -> str:
    """A path as text: the sides of a level parted by a comma, levels by blanks."""
    return " ".join(f"{a},{b}" for a, b in path)


def heard(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(" ")] if text else []


def indexed(rows: DataFrame, *more: str) -> DataFrame:
    """rows (s, ...) with n, the rows of s, and i, the place of each among them by `more`; i runs from 0 without gaps."""
    dealt = checkpoint(rows.repartitionByRange("s", *more[:1]).sortWithinPartitions("s", *more))
    at = dealt.withColumn("_m", F.monotonically_increasing_id())
    at = at.withColumn("_p", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    # A row for each task and group in it.
    held = at.groupBy("s", "_p").agg(F.min("_k").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("s").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("s", "_p", (before - F.col("_first")).alias("_start"), F.sum("_rows").over(W.partitionBy("s")).alias("n"))
    return at.join(starts, ["s", "_p"]).withColumn("i", F.col("_start") + F.col("_k")).drop("_m", "_p", "_k", "_start")


def _reduce(pdf: pd.DataFrame, fanout: int, levels: int) -> tuple[pd.DataFrame, int, str]:
    """The nodes of a superblock in order, the nodes of its group on this level, and the superblock's root."""
    pdf, n = pdf.sort_values("i"), int(pdf["n"].iloc[0])
    return pdf, n, collapse(pdf["d"].tolist(), levels if n > fanout**levels else None, fanout)[-1][0]


def rounds(blocks: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The tables of superblocks, lowest first; blocks (s, i, n, d): those of the leaves, n being the nodes below of all the group."""
    size, out = fanout**levels, [blocks]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n, root = _reduce(pdf, fanout, levels)
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "i": [int(pdf["i"].iloc[0]) // size], "n": [n], "d": [root], "ds": [pdf["d"].tolist()]})

    while out[-1].filter(F.col("n") > size).limit(1).count():
        nodes = out[-1].filter(F.col("n") > size).select("s", "i", F.ceil(F.col("n") / size).alias("n"), "d")
        out.append(checkpoint(nodes.withColumn("b", F.floor(F.col("i") / size)).groupBy("s", "b").applyInPandas(run, BLOCKS)))
    return out


def tops(tables: list[DataFrame], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(s, d): the root of each group."""
    parts = [x.filter(F.col("n") <= fanout**levels).select("s", "d") for x in tables]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def with_paths(tables: list[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The lowest superblocks with `up`, the path from their roots to the very root; above (s, up): that of the groups' roots."""
    size = fanout**levels

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, i, n, ds, up in pdf[["s", "i", "n", "ds", "up"]].itertuples(index=False):
                tree = collapse(list(ds), levels if n > size else None, fanout)
                rows += [(s, i * size + k, said([*sides(tree, k, fanout), *heard(up)])) for k in range(len(ds))]
            yield pd.DataFrame(rows, columns=["s", "i", "up"])

    known = None
    for x in reversed(tables):
        last = x.filter(F.col("n") <= size).join(above, "s")
        known = last if known is None else last.unionByName(x.filter(F.col("n") > size).join(known.select("s", "i", "ds", "up", "n").mapInPandas(children, "s string, i long, up string"), ["s", "i"]))
    return known


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    tampered: other values of columns, null where a row is as it was; the root
    is then folded from what the row has become, and its original proof.
    """
    size = fanout**levels
    # A null group before all others: no name begins with the hyphen, as names follow an equals sign.
    s = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    other = leaf(*[F.coalesce(tampered[c], F.col(c)) if c in tampered else F.col(c) for c in fields]) if tampered else None
    changed = F.when(F.coalesce(*tampered.values()).isNotNull(), other) if tampered else F.lit(None).cast("string")
    leaves = checkpoint(docs.select(s.alias("s"), F.col(key).alias("key"), leaf(*[F.col(c) for c in fields]).alias("d"), changed.alias("other")))
    nodes = indexed(leaves, "key", "d").withColumn("key", F.col("key").cast("string")).withColumn("b", F.floor(F.col("i") / size))

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n, root = _reduce(pdf, fanout, levels)
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "i": [int(pdf["b"].iloc[0])], "n": [n], "d": [root], "ds": [pdf["d"].tolist()], "keys": [pdf["key"].tolist()], "others": [pdf["other"].tolist()]})

    tables = rounds(checkpoint(nodes.groupBy("s", "b").applyInPandas(lowest, BLOCKS + ", keys array<string>, others array<string>")), fanout, levels)
    subroots = checkpoint(tops(tables, fanout, levels))

    # The tree over the groups: one group of its own, by the same rounds.
    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n, root = _reduce(pdf, fanout, levels)
        return pd.DataFrame({"s": [""], "i": [int(pdf["b"].iloc[0])], "n": [n], "d": [root], "ds": [pdf["d"].tolist()], "names": [pdf["name"].tolist()]})

    named = indexed(subroots.select(F.lit("").alias("s"), F.col("s").alias("name"), "d"), "name").withColumn("b", F.floor(F.col("i") / size))
    heads = rounds(checkpoint(named.groupBy("s", "b").applyInPandas(over, BLOCKS + ", names array<string>")), fanout, levels)
    top = tops(heads, fanout, levels).first()
    if top is None:
        return docs.select(F.col(key), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).limit(0)
    root = top["d"]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, ds, names, up in pdf[["n", "ds", "names", "up"]].itertuples(index=False):
                tree = collapse(list(ds), levels if n > size else None, fanout)
                rows += [(s, d, said([*sides(tree, k, fanout), *heard(up)])) for k, (s, d) in enumerate(zip(names, ds, strict=True))]
            yield pd.DataFrame(rows, columns=["s", "subroot", "up"])

    start = heads[-1].sparkSession.createDataFrame([("", "")], "s string, up string")
    above = checkpoint(with_paths(heads, start, fanout, levels).mapInPandas(groups, "s string, subroot string, up string"))

    def proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, ds, keys, others, subroot, up in pdf[["n", "ds", "keys", "others", "subroot", "up"]].itertuples(index=False):
                tree, upper, rows = collapse(list(ds), levels if n > size else None, fanout), heard(up), []
                tail = "".join(a + b for a, b in upper)
                for k, (doc, d, other) in enumerate(zip(keys, ds, others, strict=True)):
                    lower = sides(tree, k, fanout)
                    got = folded(d if other is None else other, [*lower, *upper])
                    rows.append((doc, d, subroot, root, digest("".join(a + b for a, b in lower) + tail), got, got == root))
                yield pd.DataFrame(rows, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    paths = with_paths(tables, above.select("s", "up"), fanout, levels).join(above.select("s", "subroot"), "s")
    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return unkeyed(paths.select("n", "ds", "keys", "others", "subroot", "up").mapInPandas(proofs, schema), "key").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; a fifth of the keys is tampered with, by lower case."""
    docs = table(spark, sf_dir, "documents")
    struck = F.col("doc_id").isNotNull() & (fold_of("doc_id", TAMPERED) == 0)
    return manifest(docs, tampered={"text": F.when(struck, F.translate("text", UPPER, LOWER))})


def _sql(depth: int = 6, groups: int = 3) -> str:
    """The same rows level by level in SQL, for at most 16 ** depth rows of a source and 16 ** groups sources."""
    told = lambda c, v: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {v}, '-')"
    row = lambda text: "sha256(" + " || ".join(told(c, text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"

    def climb(name: str, levels: int) -> str:
        out = []
        for k in range(levels):
            run = f"PARTITION BY s, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}p{k} AS (SELECT s, i, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
            out.append(f"""{name}{k + 1} AS (SELECT s, i // {FANOUT} AS i, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY s, i // {FANOUT}
  UNION ALL SELECT s, i, n, d FROM {name}{k} WHERE n = 1)""")
        return ",\n".join(out)

    def path(start: str, name: str, levels: int, s: str) -> str:
        out, before = [], start
        for k in range(levels):
            out.append(f"""{name}f{k} AS (SELECT a.* REPLACE (CASE WHEN b.l IS NULL THEN a.f ELSE sha256(b.l || a.f || b.r) END AS f, a.proof || coalesce(b.l || b.r, '') AS proof)
  FROM {before} a LEFT JOIN {name}p{k} b ON b.s = a.{s} AND b.i = a.{'i' if name == 'a' else 'g'} // {FANOUT**k})""")
            before = f"{name}f{k}"
        return ",\n".join(out)

    return f"""
WITH crc AS (SELECT list(c ORDER BY x) AS t FROM (SELECT x, list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) q(x))),
told AS (SELECT coalesce('=' || source, '-') AS s, doc_id, {row('text')} AS d,
  CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {TAMPERED} = 0
    THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM told),
a0 AS (SELECT s, i, n, d FROM leaves),
{climb('a', depth)},
subs AS (SELECT s, d, row_number() OVER (ORDER BY s) - 1 AS g FROM a{depth}),
b0 AS (SELECT '' AS s, g AS i, count(*) OVER () AS n, d FROM subs),
{climb('b', groups)},
start AS (SELECT x.doc_id, x.s, x.i, x.d AS leaf, y.d AS subroot, y.g, '' AS one, coalesce(x.other, x.d) AS f, '' AS proof FROM leaves x JOIN subs y USING (s)),
{path('start', 'a', depth, 's')},
{path(f'af{depth - 1}', 'b', groups, 'one')}
SELECT doc_id, leaf, subroot, o.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = o.d AS verified FROM bf{groups - 1}, b{groups} o"""


ORACLE = _sql()
