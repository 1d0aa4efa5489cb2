"""Picking rows within groups: first, last, best, top, thinned and capped, and state carried down an order.

Each takes the keys, an order that must be total (pass a tie-breaker as its last column) and keeps all
columns. Defined cases: a null key is a group of its own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "__rank"


def _ranked(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    return df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each group; a filter on rank 1 lets Spark keep one row a group before the shuffle."""
    return _ranked(df, keys, list(order)).where(F.col(RANK) == 1).drop(RANK)


def top(df: DataFrame, keys: list[str | Column], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with `rank`; Spark prunes each group to n rows before the shuffle."""
    return _ranked(df, keys, list(order)).where(F.col(RANK) <= n).withColumnRenamed(RANK, "rank")


def best_value(df: DataFrame, keys: list[str], value: Column, *metric: Column) -> DataFrame:
    """One row a group with `value` where the metric is greatest; folds map-side, so a hot group is no hot task."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*metric)).alias("value"))


def ranked_in_blocks(df: DataFrame, keys: list[str], block: Column, *order: Column) -> DataFrame:
    """`df` with `rank` and group size `n`, each block of a group ranked by its own task: a hot group is no hot task.

    block: a value that grows with the order, as the day of a timestamp. The sizes of the blocks are summed over
    one row a block.
    """
    one = df.withColumn("__b", block)
    inner = one.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    sizes = one.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__bb")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*[f"__{k}" for k in keys])
    sizes = sizes.withColumn("n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__bb").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
    on = F.col("__b").eqNullSafe(F.col("__bb"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return inner.join(sizes, on).select(*df.columns, (F.col(RANK) + F.col("__before")).alias("rank"), "n")


def thinned(df: DataFrame, keys: list[str], most: int, *order: Column, block: Column | None = None) -> DataFrame:
    """Up to `most` rows of each group at even steps of its order, the first among them; with a block, hot groups are ranked in parts."""
    one = ranked_in_blocks(df, keys, block if block is not None else F.lit(0), *order)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    at = F.col("rank") - 1
    return one.where((at % step == 0) & (at / step < most)).drop("rank", "n")


def carried(df: DataFrame, keys: list[str], order: list[Column], **states: Column) -> DataFrame:
    """`df` with the last non-null value of each state up to and with the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in states.items()])


def carried_in_blocks(df: DataFrame, order: str, block: Column, **states: Column) -> DataFrame:
    """As `carried` for one long log without keys: each block of the order is carried by its own task, then gets
    what the blocks before it ended with.

    block: number of the block of a row, growing with the order. The last states of the blocks are one row a
    block; they are carried by one task, which sees blocks and no lines.
    """
    one = df.withColumn("__b", block)
    inner = carried(one, ["__b"], [F.col(order)], **states)
    ends = one.groupBy("__b").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in states.items()])
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__b", *[F.last(n, ignorenulls=True).over(w).alias(f"__{n}") for n in states])
    out = inner.join(before, "__b")
    return out.select(*df.columns, *[F.coalesce(n, f"__{n}").alias(n) for n in states])


def first_seen_list(df: DataFrame, keys: list[str], value: str, order: str, name: str, separator: str = "; ") -> DataFrame:
    """(keys, name): the distinct non-null values of each group in order of first appearance, joined.

    Values are folded to their first appearance before they are listed, so a group lists its distinct values and not its rows.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__o", F.col(value).alias("v")))), lambda x: x["v"])
    return first.groupBy(*keys).agg(F.array_join(listed, separator).alias(name))


def ordered_concat(value: Column, separator: str, *order: Column) -> Column:
    """Aggregate: all non-null values joined in order."""
    seen = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))))
    return F.array_join(F.transform(seen, lambda x: x["v"]), separator)


def sorted_set(value: Column, separator: str = "; ") -> Column:
    """Aggregate: distinct non-null values in alphabetical order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)
