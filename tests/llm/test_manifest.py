"""The manifest against a whole recursion in Python, on several rounds, nulls, ties and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glosswork.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, s string"
SEE = lambda x: hashlib.sha256(x.encode()).hexdigest()


def leaf_of(values):
    return SEE("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root, and for each node its siblings level by level and its fold from another leaf."""
    if len(nodes) < 2:
        return nodes[0], [[] for _ in nodes]
    runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
    root, above = climb([SEE("".join(r)) for r in runs], fanout)
    return root, [[("".join(runs[k // fanout][: k % fanout]), "".join(runs[k // fanout][k % fanout + 1 :])), *above[k // fanout]] for k in range(len(nodes))]


def whole(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r[:1] + r[1:5]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    root, tops = climb([trees[s][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path, node = path + tops[k], leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % M.TAMPERED == 0 and r[4] is not None:
                node = leaf_of([*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])])
            for a, b in path:
                node = SEE(a + node + b)
            out.append((r[0], leaf, trees[s][0], root, SEE("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def made(spark, rows, fanout, levels):
    docs = spark.createDataFrame(rows, SCHEMA)
    struck = F.col("doc_id").isNotNull() & (M.fold_of("doc_id", M.TAMPERED) == 0)
    got = M.manifest(docs, tampered={"text": F.when(struck, F.translate("text", M.UPPER, M.LOWER))}, fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Upper É", "all low", "x" * 50]), "own", "own") for k in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("fanout,levels,n", [(2, 2, 90), (3, 1, 40), (16, 2, 700), (4, 3, 65)])
def test_rounds_match_the_whole_recursion(spark, fanout, levels, n):
    rows = rows_of(n, ["a", "a", "a", "b", None, "é", "ｚ", "😀", "-", "="], fanout)
    assert made(spark, rows, fanout, levels) == whole(rows, fanout)


def test_many_groups_and_lone_leaves(spark):
    rows = [(k, f"s{k}", None, None, "T", "", "") for k in range(60)]
    assert made(spark, rows, 2, 2) == whole(rows, 2)
    assert made(spark, rows[:1], 16, 2) == whole(rows[:1], 16)


def test_nulls_repeated_rows_and_nothing(spark):
    rows = [(None, None, None, None, None, "", ""), (5, "a", "en", 1, "One", "", ""), (5, "a", "en", 1, "One", "", ""), (5, "a", "en", 1, "Two", "", ""), (None, "a", None, None, "A" * 300_000, "", "")]
    got = made(spark, rows, 16, 2)
    assert got == whole(rows, 16) and len(got) == 5
    assert made(spark, [], 16, 2) == []


def test_a_tampered_row_alone_fails(spark):
    rows = rows_of(300, ["a", "b"], 4)
    for doc, *_, verified in made(spark, rows, 16, 2):
        text = next(r[4] for r in rows if r[0] == doc)
        struck = zlib.crc32(str(doc).encode()) % M.TAMPERED == 0
        assert verified == (not struck or text is None or text == "".join(c.lower() if c.isascii() else c for c in text))
