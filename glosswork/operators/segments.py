"""Words cut into syllables of an inventory, and characters taken apart into their components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.operators.settle import settled

# Signs that describe a character as two parts, and as three, and the sign of an unknown part.
BINARY, TERNARY, UNKNOWN = "⿰⿱⿴⿵⿶⿷⿸⿹⿺⿻", "⿲⿳", "？"


def syllables(words: DataFrame, inventory: DataFrame, on: tuple[str, ...] = (), vowels: str = "aoe", apart: int = 10, longest: int = 7) -> DataFrame:
    """(*on, word, parts): each distinct word as syllables of the inventory; null parts where it has no such reading.

    words: (*on, word); inventory: (*on, syllable). Of all readings the one with
    the fewest syllables counts, where a syllable inside a word that begins with
    one of `vowels` costs `apart` more, as writing would part it; among equals
    the longest first syllable wins, then the longest second, and so on.

    Pieces of words meet the inventory in a join, so it may be any table; the
    best reading is one fold over a word's places, from the last to the first.
    """
    x = words.select(*on, "word").filter("word <> ''").distinct()
    n = F.length("word")
    at = x.select(*on, "word", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    cut = at.select(*on, "word", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("i") + 1))).alias("k"))
    piece = cut.withColumn("syllable", F.substring("word", F.col("i"), F.col("k")))
    known = piece.join(inventory.select(*on, "syllable").distinct(), [*on, "syllable"])
    extra = F.when((F.col("i") > 1) & F.col("syllable").rlike(f"^[{vowels}]"), apart).otherwise(0) if vowels else F.lit(0)
    # From the last place to the first, longer pieces first.
    edges = known.groupBy(*on, "word").agg(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("m"), (-F.col("k")).alias("l"), (extra + 1).alias("cost"), "syllable"))).alias("edges"))
    none = F.array().cast("array<string>")
    # What is known of each place: the cost of its best reading to the end, and the reading.
    end = F.map_from_arrays(F.array(n + 1), F.array(F.struct(F.lit(0).alias("cost"), none.alias("parts"))))

    def step(best: Column, e: Column) -> Column:
        i, rest = -e["m"], F.try_element_at(best, -e["m"] - e["l"])
        cost, old = rest["cost"] + e["cost"], F.try_element_at(best, i)
        better = rest.isNotNull() & (old.isNull() | (cost < old["cost"]))
        kept = F.map_filter(best, lambda k, _: k != i)
        return F.when(better, F.map_concat(kept, F.map_from_arrays(F.array(i), F.array(F.struct(cost.alias("cost"), F.concat(F.array(e["syllable"]), rest["parts"]).alias("parts")))))).otherwise(best)

    read = edges.select(*on, "word", F.try_element_at(F.aggregate("edges", end, step), F.lit(1))["parts"].alias("parts"))
    return x.join(read, [*on, "word"], "left")


def numbered(syllable: Column, tone: Column) -> Column:
    """The ways to type a syllable with its tone as a digit; the neutral tone 5 is also 0 or left out."""
    return F.when(tone == 5, F.array(F.concat(syllable, F.lit("5")), F.concat(syllable, F.lit("0")), syllable)).otherwise(F.array(F.concat(syllable, tone.cast("string"))))


def products(parts: Column, most: int = 64) -> Column:
    """All texts that take one of each part's ways, in order; none if they are more than `most`. parts: array<array<string>>."""
    none = F.array().cast("array<string>")
    size = F.aggregate(parts, F.lit(1).cast("long"), lambda n, p: F.least(n * F.size(p), F.lit(most + 1).cast("long")))
    made = F.aggregate(parts, F.array(F.lit("")), lambda out, p: F.flatten(F.transform(out, lambda a: F.transform(p, lambda b: F.concat(a, b)))))
    return F.when((F.size(parts) == 0) | (size > most), none).otherwise(made)


def tree(marks: Column) -> Column:
    """array<struct<part, parent, slot>>: the nodes of a description in prefix notation, null if it is none.

    marks: its signs and parts, in order. A node's parent is the place of its
    sign, from 0, or -1. The fold carries the signs that still lack parts.
    """
    stack = "array<struct<at:int,lacks:int,arity:int>>"
    start = F.struct(F.lit(0).alias("i"), F.array().cast(stack).alias("open"), F.array().cast("array<struct<part:string,parent:int,slot:int>>").alias("out"), F.lit(True).alias("ok"))

    def step(s: Column, mark: Column) -> Column:
        arity = F.when(F.contains(F.lit(BINARY), mark), 2).when(F.contains(F.lit(TERNARY), mark), 3).otherwise(0)
        top = F.try_element_at(s["open"], F.lit(-1))
        node = F.struct(mark.alias("part"), F.coalesce(top["at"], F.lit(-1)).alias("parent"), F.coalesce(top["arity"] - top["lacks"], F.lit(0)).alias("slot"))
        rest = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        used = F.when(top["lacks"] > 1, F.concat(rest, F.array(F.struct(top["at"].alias("at"), (top["lacks"] - 1).alias("lacks"), top["arity"].alias("arity"))))).otherwise(rest)
        now = F.when(arity > 0, F.concat(used, F.array(F.struct(s["i"].alias("at"), arity.alias("lacks"), arity.alias("arity"))))).otherwise(used)
        # After the first node something must be open.
        return F.struct((s["i"] + 1).alias("i"), now.alias("open"), F.concat(s["out"], F.array(node)).alias("out"), (s["ok"] & ((s["i"] == 0) | (F.size(s["open"]) > 0))).alias("ok"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["ok"] & (s["i"] > 0) & (F.size(s["open"]) == 0), s["out"]))


def components(described: DataFrame, sep: str = "") -> DataFrame:
    """(whole, part): the direct components of each described character (whole, description); none where the description is no tree.

    sep: what stands between the marks of a description, nothing for characters.
    """
    nodes = described.select("whole", F.explode(tree(F.filter(F.split("description", sep), lambda m: m != ""))).alias("n"))
    signs = BINARY + TERNARY + UNKNOWN
    return nodes.select("whole", F.col("n.part").alias("part")).filter(~F.contains(F.lit(signs), F.col("part")) & (F.col("part") != F.col("whole"))).distinct()


def leaves(parts: DataFrame) -> DataFrame:
    """(whole, leaf): what each character comes to when components are taken apart again and again, down to those without components.

    parts: (whole, part). A round joins what is new with the components; it ends
    when nothing new comes, so a character that contains itself by a detour ends
    too. A whole all of whose components go round has no leaf.
    """
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(parts.select("whole", "part").distinct())
    reached = new = parts
    step = parts.select(F.col("whole").alias("part"), F.col("part").alias("next"))
    while True:
        more = new.hint("merge").join(step, "part").select("whole", F.col("next").alias("part")).distinct()
        new = settled(more.join(reached.hint("merge"), ["whole", "part"], "left_anti"))
        if new.isEmpty():
            break
        # Rounds send the driver no rows (the hints), and add no tasks to those after them.
        reached = reached.unionByName(new).coalesce(tasks)
    own = parts.select(F.col("whole").alias("part")).distinct()
    return reached.join(own.hint("merge"), "part", "left_anti").select("whole", F.col("part").alias("leaf"))
