"""Joins in time: nearest snapshot, carried-forward pages with reachability and liveness, validity, coverage.

None of these pairs all rows of a group. The nearest snapshot is a neighbour of its target in date order;
a page is carried until its next snapshot; validity spans are unfolded into years and met by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators.generators import span
from millrace.operators.windows import keep_first


def nearest(targets: DataFrame, snapshots: DataFrame, key: str, target_at: str, snapshot_at: str, value: str) -> DataFrame:
    """`targets` with the nearest snapshot of its key: its `value` and the distance; null where the key has none.

    target_at and snapshot_at are numbers on one axis (day numbers, or YYYYMMDD). Equally near snapshots: the
    earlier one; several of one moment: the one with the least value. Targets and snapshots are sorted
    together once, and each target looks one snapshot back and one ahead.
    """
    t = targets.withColumn("__at", F.col(target_at).cast("long"))
    s = snapshots.where(F.col(snapshot_at).isNotNull()).groupBy(F.col(key), F.col(snapshot_at).cast("long").alias("__at")).agg(F.min(value).alias("__v"))
    cols = targets.columns
    both = t.select(F.col(key).alias("__k"), "__at", F.lit(1).alias("__side"), F.struct(*cols).alias("__t"), F.lit(None).cast(s.schema["__v"].dataType).alias("__v"))
    both = both.unionByName(s.select(F.col(key).alias("__k"), "__at", F.lit(0).alias("__side"), "__v"), allowMissingColumns=True)
    w = Window.partitionBy("__k").orderBy("__at", "__side")
    hit = F.when(F.col("__side") == 0, F.struct("__at", "__v"))
    one = both.select("*", F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__b"), F.first(hit, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("__a"))
    one = one.where("__side = 1")
    back, ahead = F.col("__at") - F.col("__b.__at"), F.col("__a.__at") - F.col("__at")
    earlier = F.col("__a").isNull() | (back <= ahead)
    return one.select("__t.*", F.when(earlier, F.col("__b.__v")).otherwise(F.col("__a.__v")).alias(value), F.when(earlier, back).otherwise(ahead).alias("distance"))


def used_once(chosen: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of the targets that chose one snapshot, the first; targets without snapshot are dropped."""
    return keep_first(chosen.where(F.col(value).isNotNull()), [key, value], F.col(order))


def carried_pages(pages: DataFrame, keys: list[str], url: str, day: str, ident: str, last: Column) -> DataFrame:
    """(keys, h, url, ident, fresh): for each half-year the latest page of every address up to its end.

    A page lives from its own half-year to the one before that of the address's next page, or to `last`. Only
    ids are carried; texts are joined when they are needed. Of several pages of one day the first by id counts.
    """
    own = dates.half_year_index(F.col(day))
    one = pages.where(F.col(day).isNotNull()).withColumn("__h", own)
    # of the pages of one half-year only the latest is ever the latest at its end
    latest = keep_first(one, [*keys, url, "__h"], F.col(day).desc(), F.col(ident))
    until = F.coalesce(F.lead("__h").over(Window.partitionBy(*keys, url).orderBy("__h")) - 1, last)
    spread = latest.withColumn("__until", until).withColumn("h", F.explode(span(F.col("__h"), F.col("__until").cast("int"))))
    return spread.select(*keys, "h", url, ident, (F.col("h") == F.col("__h")).alias("fresh"))


def reachable(carried: DataFrame, says: DataFrame, keys: list[str], url: str, ident: str) -> DataFrame:
    """Carried pages that are fresh, or whose address a fresh page of the group and half-year names.

    says: (ident, named): which addresses each page names. Fresh pages are met with what they name, stale ones by
    equality on the address.
    """
    fresh = carried.where("fresh")
    named = fresh.select(*keys, "h", ident).join(says, ident).select(*keys, "h", F.col("named").alias(url)).distinct()
    stale = carried.where("not fresh").join(named, [*keys, "h", url], "left_semi")
    return fresh.unionByName(stale)


def alive(carried: DataFrame, keys: list[str], mentions: Column) -> DataFrame:
    """The pages of the groups and half-years in which a fresh page mentions the entity."""
    live = carried.where(F.col("fresh") & mentions).select(*keys, "h").distinct()
    return carried.join(live, [*keys, "h"], "left_semi")


def valid_at(df: DataFrame, spans: DataFrame, keys: list[str], year: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Rows of `df` with the rows of `spans` that hold at their year: start < year < end, both strict.

    Spans are unfolded into their years and met by equality; a row with a null year meets all spans of its key,
    a span with a null bound none but those rows.
    """
    s = spans.select(*keys, *columns, F.col(start).cast("int").alias("__a"), F.col(end).cast("int").alias("__b"))
    by_year = s.withColumn("__y", F.explode(span(F.col("__a") + 1, F.col("__b") - 1))).drop("__a", "__b")
    dated = df.where(F.col(year).isNotNull()).withColumn("__y", F.col(year).cast("int")).join(by_year, [*keys, "__y"]).drop("__y")
    undated = df.where(F.col(year).isNull()).join(s.drop("__a", "__b"), keys)
    return dated.unionByName(undated)


def running_total(counts: DataFrame, order: str, **sums: str) -> DataFrame:
    """`counts`, one row a period, with running totals; the rows are as few as there are periods."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
