"""Chains of renames: edges from hints within an entity, and the end of each chain.

Defined cases: a name on a cycle keeps the name at which its walk would first repeat, which is the name
itself; of several successors of one name the last by ordinal counts; null names have no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import bare_name
from millrace.operators.windows import keep_first
from millrace.session import cut


def hint_fits(candidate: Column, hint: Column) -> Column:
    """Whether a bare name fits a hint: equal, led by it, or with the same first word and the hint within."""
    first = lambda c: F.substring_index(c, " ", 1)
    return (candidate == hint) | F.startswith(candidate, F.concat(hint, F.lit(" "))) | ((first(candidate) == first(hint)) & F.contains(candidate, hint))


def first_fit(hints: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """(entity, ordinal, name, hint, other): for each hint the first other name of its entity that fits.

    hints: (entity, ordinal, name, hint); names: (entity, ordinal, name). The two meet on entity and first
    word, which every kind of fit shares, so an entity with many names does not pair them all. strict: only
    equal names and names led by the hint fit.
    """
    h = hints.withColumn("bare", bare_name(F.col("hint"))).where("bare <> ''").withColumn("first", F.substring_index("bare", " ", 1))
    n = names.select("entity", F.col("ordinal").alias("at"), F.col("name").alias("other"), bare_name(F.col("name")).alias("theirs")).withColumn("first", F.substring_index("theirs", " ", 1))
    fits = hint_fits(F.col("theirs"), F.col("bare")) if not strict else (F.col("theirs") == F.col("bare")) | F.startswith(F.col("theirs"), F.concat(F.col("bare"), F.lit(" ")))
    met = h.join(n, ["entity", "first"]).where((F.col("other") != F.col("name")) & fits)
    return keep_first(met, ["entity", "ordinal", "name", "hint"], F.col("at"), F.col("other")).select("entity", "ordinal", "name", "hint", "other")


def chain_ends(edges: DataFrame) -> DataFrame:
    """(entity, name, root): every name with a successor and the end of its chain, by pointer doubling.

    edges: (entity, name, next, ordinal). Each round doubles the distance walked and cuts its lineage in the
    shared folder; rounds grow with the logarithm of the longest chain. Who has walked as many names as there are
    edges and found no end stands on a cycle: names on it keep themselves, names that lead to it get the one they enter by.
    """
    step = edges.where("name is not null and next is not null and name <> next").groupBy("entity", "name").agg(F.max_by("next", F.struct("ordinal", "next")).alias("root"))
    walk = cut(step)
    covered, most = 1, walk.count()
    while covered <= most:
        up = walk.select("entity", F.col("name").alias("root"), F.col("root").alias("further"))
        moved = cut(walk.join(up, ["entity", "root"], "left").select("entity", "name", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        walk, covered = moved.drop("moved"), covered * 2
        if moved.where("moved").isEmpty():
            return walk
    live = walk.join(step.select("entity", F.col("name").alias("root")), ["entity", "root"], "left_semi")
    return _off_cycles(walk, step, live)


def _off_cycles(walk: DataFrame, step: DataFrame, live: DataFrame) -> DataFrame:
    on = cut(live.select("entity", F.col("root").alias("name")).distinct())
    while True:  # the names on a cycle are closed under the step
        more = step.join(on, ["entity", "name"]).select("entity", F.col("root").alias("name")).join(on, ["entity", "name"], "left_anti").distinct()
        if more.isEmpty():
            break
        on = cut(on.unionByName(more).distinct())
    inside = on.withColumn("on", F.lit(True))
    bound = live.select("entity", "name").join(inside, ["entity", "name"], "left")
    entry = cut(bound.where("on is null").select("entity", "name").join(step, ["entity", "name"]))
    while True:  # names that lead into a cycle walk on until they stand on it
        open_ = entry.join(inside.select("entity", F.col("name").alias("root")), ["entity", "root"], "left_anti")
        if open_.isEmpty():
            break
        nxt = step.select("entity", F.col("name").alias("root"), F.col("root").alias("further"))
        entry = cut(entry.join(inside.select("entity", F.col("name").alias("root"), F.lit(True).alias("there")), ["entity", "root"], "left").join(nxt, ["entity", "root"], "left").select("entity", "name", F.when(F.col("there"), F.col("root")).otherwise(F.col("further")).alias("root")))
    done = walk.join(live.select("entity", "name"), ["entity", "name"], "left_anti")
    return done.unionByName(bound.where("on").select("entity", "name", F.col("name").alias("root"))).unionByName(entry.select("entity", "name", "root"))
