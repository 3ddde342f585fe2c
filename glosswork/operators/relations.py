"""Links, identities, differences, integrity checks and selections over keyed tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswork.operators.settle import settled


def argmin_link(left: DataFrame, links: DataFrame, right: DataFrame, outer: bool = False) -> DataFrame:
    """Each row of left (id, …) with the linked row of right (id, text) of the least id.

    links: (left_id, right_id). The least id is found by an aggregate before
    right is joined, so that only chosen rows meet their texts. outer keeps
    rows without a link, with an empty text.
    """
    there = links.join(right.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    first = there.groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    x = left.join(first, left["id"] == first["left_id"], "left" if outer else "inner").drop("left_id")
    return x.join(right.select(F.col("id").alias("right_id"), F.col("text").alias("linked")), "right_id", "left").withColumn("linked", F.coalesce("linked", F.lit("")))


def form_chase(edges: DataFrame, usable: DataFrame, depth: int = 3) -> DataFrame:
    """(form, lemma, steps): from each form along edges (form, target, ord) to the first usable lemma, at most `depth` steps.

    Level by level: what a level settles leaves the next; among paths of equal
    length the least sequence of edge orders wins.
    """
    front = edges.select("form", F.array(F.col("ord")).alias("path"), "target")
    ok = usable.select(F.col("lemma").alias("target"), F.lit(True).alias("ok"))
    out = None
    for step in range(1, depth + 1):
        x = front.join(ok, "target", "left")
        hit = x.filter("ok").groupBy("form").agg(F.min(F.struct("path", "target"))["target"].alias("lemma")).withColumn("steps", F.lit(step))
        out = hit if out is None else out.unionByName(hit)
        if step < depth:
            e = edges.select(F.col("form").alias("target"), F.col("target").alias("next"), "ord")
            front = x.filter("ok IS NULL").drop("ok").join(hit.select("form"), "form", "left_anti").join(e, "target")
            front = front.select("form", F.concat("path", F.array("ord")).alias("path"), F.col("next").alias("target"))
    return out


def able(items: DataFrame, group: str, guards: list[str]) -> DataFrame:
    """items with size, their group's, and able, the others in it that share none of the guards, by inclusion and exclusion over the guards."""
    out = items.join(items.groupBy(group).agg(F.count("*").alias("size")), group)
    count = F.col("size")
    for k in range(1, len(guards) + 1):
        for some in combinations(guards, k):
            name = "_n_" + "_".join(some)
            out = out.join(items.groupBy(group, *some).agg(F.count("*").alias(name)), [group, *some])
            count = count + (-1) ** k * F.col(name)
    return out.withColumn("able", count).select(*items.columns, "size", "able")


def distractors(items: DataFrame, group: str, guards: list[str], n: int = 3, block: int = 16, loose: list[str] | None = None, hot: float = 0.25) -> DataFrame:
    """(id, place, other): the next n others in the group's hash order that share none of the guards with the item; fewer only where the group has fewer.

    loose: guards of a second pass, for the items that have fewer than n others
    by all guards. items: (id, order_key, group, guards), order_key a text that
    tells the order within a group, such as a digest; a null guard shares with all.

    An item looks round a ring of its group. A value that a share `hot` of the
    group has is hot, and the items with hot values look round a ring that
    leaves these values out; a group has few such rings, as a guard has
    1 / hot hot values at most. So what an item passes over is bounded by what
    its other guards rule out, and others are looked for among the next
    `block` places; the few items left with too few look on in ranges that
    double, and end when they have as many as there are.
    """
    x = able(items.dropna(subset=guards), group, guards)
    if loose is not None:
        enough = x.filter(F.col("able") >= n).select("id")
        few = items.join(enough, "id", "left_anti").select("id")
        return _around(x, group, guards, n, block, hot, enough).unionByName(_around(able(items.dropna(subset=loose), group, loose), group, loose, n, block, hot, few))
    return _around(x, group, guards, n, block, hot)


def _around(x: DataFrame, group: str, guards: list[str], n: int, block: int, hot: float, only: DataFrame | None = None) -> DataFrame:
    """The search of distractors; x: items with size and able; only: the ids that look."""
    x = x.withColumn("_p", F.substring("order_key", 1, 2))
    marks = [f"_h_{g}" for g in guards]
    for g, h in zip(guards, marks, strict=True):
        often = x.groupBy(group, g).agg(F.count("*").alias("_c"), F.max("size").alias("_s")).filter(F.col("_c") > hot * F.col("_s"))
        x = x.join(often.select(group, g, F.col(g).alias(h)), [group, g], "left")
    # The rings of a group: each set of hot values that one item has.
    rings = x.select(group, *marks).distinct().groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*marks))).alias("_rings"))
    y = x.join(rings, group).select(group, "id", "order_key", "_p", "able", *guards, *marks, F.posexplode("_rings").alias("_r", "_ring"))
    member, own = F.lit(True), F.lit(True)
    for g, h in zip(guards, marks, strict=True):
        member = member & (F.col(f"_ring.{h}").isNull() | (F.col(g) != F.col(f"_ring.{h}")))
        own = own & F.col(f"_ring.{h}").eqNullSafe(F.col(h))
    y = y.withColumn("_in", member).withColumn("_own", own).filter("_in OR _own").select(group, "_r", "_p", "order_key", "id", "able", *guards, "_in", "_own")
    # Places in a ring: those within a part of the order, after the members of earlier parts.
    held = y.groupBy(group, "_r", "_p").agg(F.count_if("_in").alias("_c"))
    up = W.partitionBy(group, "_r").orderBy("_p")
    held = held.select(group, "_r", "_p", (F.sum("_c").over(up) - F.col("_c")).alias("_o"), F.sum("_c").over(W.partitionBy(group, "_r")).alias("ring"))
    part = W.partitionBy(group, "_r", "_p").orderBy("order_key", "id").rowsBetween(W.unboundedPreceding, 0)
    y = settled(y.withColumn("_k", F.sum(F.col("_in").cast("long")).over(part)).join(held, [group, "_r", "_p"]).withColumn("i", F.col("_o") + F.col("_k")))
    others = y.filter("_in").select(group, "_r", F.col("i").alias("at"), F.col("id").alias("other"), *[F.col(g).alias(f"_{g}") for g in guards])
    ok = F.lit(True)
    for g in guards:
        ok = ok & (F.col(g) != F.col(f"_{g}"))

    def found(short: DataFrame, low: int, high: int) -> DataFrame:
        last = F.least(F.lit(high).cast("long"), F.col("ring") - F.col("_in").cast("long"))
        a = short.filter(last >= low).withColumn("j", F.explode(F.sequence(F.lit(low).cast("long"), last)))
        return a.withColumn("at", (F.col("i") + F.col("j") - 1) % F.col("ring") + 1).join(others, [group, "_r", "at"]).filter(ok).select("id", "j", "other")

    left = y.filter("_own").withColumn("want", F.least("able", F.lit(n))).filter("want > 0")
    if only is not None:
        left = left.join(only, "id", "left_semi")
    left, out, low, high = left.withColumn("have", F.lit(0).cast("long")), None, 1, block
    while True:
        got = settled(found(left, low, high))
        out = got if out is None else out.unionByName(got)
        more = left.join(got.groupBy("id").agg(F.count("*").alias("_more")), "id", "left").withColumn("have", F.col("have") + F.coalesce("_more", F.lit(0))).drop("_more")
        left = settled(more.filter("have < want"))
        if left.isEmpty():
            break
        low, high = high + 1, 2 * high
    c = out.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("j"))).filter(F.col("place") <= n)
    return c.select("id", "place", "other")


def typed_match(typed: DataFrame, words: DataFrame) -> DataFrame:
    """(id, answer, verdict): exact, folded, or other (the exact form of another word) or wrong.

    typed: (id, answer); words: (id, form). A folded hit does not count where
    the answer is exactly another word's form.
    """
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", "")
    own = words.select("id", F.col("form").alias("own"))
    forms = words.select(F.col("form").alias("answer")).distinct().withColumn("taken", F.lit(True))
    x = typed.join(own, "id").join(forms, "answer", "left")
    verdict = F.when(F.col("answer") == F.col("own"), "exact").when(F.col("taken"), "other").when(fold(F.col("answer")) == fold(F.col("own")), "folded").otherwise("wrong")
    return x.select("id", "answer", verdict.alias("verdict"))


def occurrences(df: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """Adds k: which occurrence of its key a row is, in the order of a whole-number column.

    Numbered within blocks of the order and set off by the blocks' sizes, so that
    a frequent key is not sorted by one task.
    """
    x = df.withColumn("_b", F.floor(F.col(order) / block))
    sizes = x.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    i = F.row_number().over(W.partitionBy(key, "_b").orderBy(order))
    return x.withColumn("_i", i).join(sizes.select(key, "_b", before.alias("_o")), [key, "_b"]).withColumn("k", F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def carry_ids(texts: DataFrame, issued: DataFrame) -> DataFrame:
    """(ord, text, id, fresh): the k-th occurrence of a text takes the k-th id issued for it; the rest get new ids after the greatest.

    texts: (ord, text); issued: (id, text). Ids keep their texts, and retired
    ones are not issued again. New ids are numbered by offsets of blocks of
    ord, so no task sorts all rows.
    """
    texts, issued = texts.select("ord", "text"), issued.select("id", "text")
    x = occurrences(texts, "text", "ord").join(occurrences(issued, "text", "id"), ["text", "k"], "left")
    block = F.floor(F.col("ord") / 4096)
    new = x.filter("id IS NULL").withColumn("b", block)
    sizes = new.groupBy("b").agg(F.count("*").alias("c"))
    offset = sizes.withColumn("o", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("b", "o")
    top = issued.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("i", F.row_number().over(W.partitionBy("b").orderBy("ord"))).join(offset, "b").crossJoin(F.broadcast(top))  # one row
    fresh = numbered.select("ord", "text", (F.col("top") + F.col("o") + F.col("i")).alias("id"), F.lit(True).alias("fresh"))
    return x.filter("id IS NOT NULL").select("ord", "text", "id", F.lit(False).alias("fresh")).unionByName(fresh)


def retired(issued: DataFrame, carried: DataFrame) -> DataFrame:
    """Issued ids that no text has claimed."""
    return issued.join(carried.filter("NOT fresh").select("id"), "id", "left_anti")


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed or changed rows with the names of the fields that differ, nulls equal to nulls."""
    a = old.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_o_{c}") for c in fields])
    b = new.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    x = a.join(b, a["_a"] == b["_b"], "full_outer")
    names = F.array_join(F.filter(F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.lit(c)) for c in fields]), lambda v: v.isNotNull()), ",")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    x = x.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), F.when(change == "changed", names).otherwise("").alias("fields"))
    return x.filter((F.col("change") != "changed") | (F.col("fields") != ""))


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent: str, rule: str) -> DataFrame:
    """(rule, n, first): rows whose reference has no parent."""
    lost = rows.join(parents.select(F.col(parent).alias(column)), column, "left_anti")
    return lost.agg(F.count("*").alias("n"), F.coalesce(F.min(column).cast("long"), F.lit(-1)).alias("first")).select(F.lit(rule).alias("rule"), "n", "first")


def search(words: DataFrame, text: str, meaning: str, needle: str, limit: int = 20) -> DataFrame:
    """The first `limit` words by relevance: equal, prefix, part of the text, part of the meaning; then by id."""
    q = F.lit(needle.lower().strip())
    t, m = F.lower(F.trim(text)), F.lower(meaning)
    tier = F.when(t == q, 0).when(t.startswith(q), 1).when(F.contains(t, q), 2).when(F.contains(m, q), 3)
    return words.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", "id").limit(limit)


def stratified(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group in the order of a seeded hash of the key."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    w = W.partitionBy(group).orderBy(h, key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def attribution(rows: DataFrame, licence: str, user: str) -> DataFrame:
    """(licence, place, user, n): contributors of each licence by falling number, then name."""
    g = rows.groupBy(F.col(licence).alias("licence"), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("licence").orderBy(F.col("n").desc(), "user")))


def confusion(rows: DataFrame, mine: str, theirs: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, mine, theirs, n, exact, near): counts of each pair of levels (ordinals) and whether they are equal or next to each other."""
    g = rows.groupBy(*by, F.col(mine).alias("mine"), F.col(theirs).alias("theirs")).agg(F.count("*").alias("n"))
    return g.withColumn("exact", F.col("mine") == F.col("theirs")).withColumn("near", F.abs(F.col("mine") - F.col("theirs")) <= 1)


def quota_pick(rows: DataFrame, group: str, kind: str, order: list, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each kind within a group, as many as its quota says."""
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(kind)]
    w = W.partitionBy(group, kind).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= quota)


def synonym_links(meanings: DataFrame) -> DataFrame:
    """(meaning, first, id): the ids that share a meaning (id, meaning), each linked with the least of them; meanings of one id have no row.

    Two ids are synonyms if they stand under one meaning. A frequent meaning is
    as many rows as it has ids, not as many as it has pairs.
    """
    m = meanings.distinct()
    size = m.groupBy("meaning").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").drop("n")
    return m.join(size, "meaning").select("meaning", "first", "id")


def covers(have: DataFrame, need: DataFrame) -> DataFrame:
    """(kind, a, b): which owners (owner, value) have every value of which targets (target, value): relational division by counting.

    Owners with the same values are one class, named by the least of them, and
    so are targets. Rows of kind `owner` and `target` give an id and its class,
    those of kind `pair` an owner class and a target class that it covers, so
    that copies are not multiplied with each other. Sets of values are compared
    by their size and two sums of hashes.
    """

    def classes(rows: DataFrame, key: str) -> DataFrame:
        sums = [F.sum(F.xxhash64(F.lit(k), "value").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
        one = rows.groupBy(key).agg(F.count("*").alias("size"), *sums)
        first = one.groupBy("size", "h1", "h2").agg(F.min(key).alias("class"))
        return one.join(first, ["size", "h1", "h2"]).select(key, "class", "size")

    have, need = settled(have.select("owner", "value").distinct()), settled(need.select("target", "value").distinct())
    owners, targets = classes(have, "owner"), classes(need, "target")
    x = have.join(owners.filter("owner = class").select("owner"), "owner")
    y = need.join(targets.filter("target = class").select("target", "size"), "target")
    pairs = x.join(y, "value").groupBy("owner", "target", "size").agg(F.count("*").alias("n")).filter("n = size")
    out = pairs.select(F.lit("pair").alias("kind"), F.col("owner").alias("a"), F.col("target").alias("b"))
    for rows, key in ((owners, "owner"), (targets, "target")):
        out = out.unionByName(rows.select(F.lit(key).alias("kind"), F.col(key).alias("a"), F.col("class").alias("b")))
    return out


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units, as a long; a letter beyond them counts as its two surrogates."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1), lambda u: F.conv(u, 16, 10).cast("long"))
    start, prime = F.lit(0x811C9DC5).cast("long"), F.lit(0x01000193).cast("long")
    return F.aggregate(units, start, lambda h, u: (h.bitwiseXOR(u) * prime) % F.lit(1 << 32))
