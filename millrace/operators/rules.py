"""Curation by rule tables: remaps, overwrites, flags, exclusions, lookups with fallbacks, and default rows.

Rules are tables, never code. A rule table is joined, not collected: whether it is broadcast is left to the
optimizer, which knows its size. Rules are folded to one row a key first, so no join multiplies rows
unless it says so.

Defined cases: a null key meets no rule; a rule with a null value sets null (it is a rule all the same); of
several rules for one key the one with the greatest ordinal wins, of equal ordinals the greatest value;
an empty rule table changes nothing; columns of a rule table other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT, NEW = "__hit", "__new"


def last_rules(rules: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """One row a key: the value of its last rule."""
    # a struct of one field keeps a null value apart from no value
    return rules.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(ordinal, value)).alias("r")).select(*keys, F.col("r.v").alias(NEW), F.lit(True).alias(HIT))


def overwrite(df: DataFrame, rules: DataFrame, keys: list[str], target: str, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """`df` with `target` set by the last rule of each key; rows without rule keep theirs."""
    one = df.join(last_rules(rules, keys, value, ordinal), keys, "left")
    return one.withColumn(target, F.when(F.col(HIT), F.col(NEW)).otherwise(F.col(target))).select(*df.columns)


def remap(df: DataFrame, rules: DataFrame, target: str, source: str = "from", to: str = "to", ordinal: str = "ordinal", keep: bool = True) -> DataFrame:
    """`df` with the values of `target` replaced; unmapped ones stay (`keep`) or become null."""
    last = last_rules(rules.select(F.col(source).alias("__from"), F.col(to).alias("__to"), F.col(ordinal).alias("__ordinal")), ["__from"], "__to", "__ordinal")
    one = df.join(last, F.col(target) == F.col("__from"), "left")
    return one.withColumn(target, F.when(F.col(HIT), F.col(NEW)).otherwise(F.col(target) if keep else F.lit(None))).select(*df.columns)


def flag(df: DataFrame, rules: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with a flag that is true for the keys of the rule table; a flag already set stays."""
    one = df.join(rules.select(*keys).distinct().withColumn(HIT, F.lit(True)), keys, "left")
    old = F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    return one.withColumn(name, old | F.col(HIT).isNotNull()).select(*dict.fromkeys([*df.columns, name]))


def without_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with none of the flags set; a null flag is not set."""
    return df.where(reduce(lambda a, b: a & b, [~F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def lookup_with_fallback(df: DataFrame, names: DataFrame, key: str, name: str, value: str, ordinal: str) -> DataFrame:
    """`df` with `value` of the name that equals the key in lower case, else of the one that does so without blanks; the first of `names` counts."""
    tight = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))
    ranked = F.min_by(F.col(value), F.struct(ordinal, value))
    one = names.groupBy(F.lower(F.trim(name)).alias("__k1")).agg(ranked.alias("__v1"))
    two = names.groupBy(tight(F.col(name)).alias("__k2")).agg(ranked.alias("__v2"))
    got = df.join(one, F.lower(F.trim(key)) == F.col("__k1"), "left").join(two, tight(F.col(key)) == F.col("__k2"), "left")
    return got.select(*df.columns, F.coalesce("__v1", "__v2").alias(value))


def with_status(grid: DataFrame, found: DataFrame, keys: list[str], status: str, missing: str, statuses: dict[str, Column] | None = None) -> DataFrame:
    """Every row of the grid with what was found for it, and a status: `missing` where nothing was, else the first named condition that holds, else 'OK'."""
    one = grid.join(found.withColumn(HIT, F.lit(True)), keys, "left")
    s = F.when(F.col(HIT).isNull(), F.lit(missing))
    for name, condition in (statuses or {}).items():
        s = s.when(condition, F.lit(name))
    return one.withColumn(status, s.otherwise("OK")).drop(HIT)


def combine_first(new: DataFrame, old: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`new` with the values of `old` where its own are null; `old` must have one row a key."""
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns])
    one = new.join(o, keys, "left")
    return one.select(*[F.coalesce(c, f"__old_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])


def tier(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, null if none does; a condition that is null does not hold."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out


def populated(columns: list[str]) -> Column:
    """How many of the columns hold more than white space."""
    return sum((F.when(F.col(c).cast("string").rlike(r"\S"), 1).otherwise(0) for c in columns), F.lit(0))


def not_in(c: Column, values: list) -> Column:
    """`c` not among the values; null counts as not among them."""
    return ~F.coalesce(c.isin(values), F.lit(False))


def number(c: Column) -> Column:
    """A number from text, null for anything that is not plainly one."""
    return F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))


def minus(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose keys the other table lacks: restart from a table of what is done."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def within(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose keys the other table has."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")
