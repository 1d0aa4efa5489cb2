"""Distribution statistics: exact quantiles, trims, tails, deciles by value edges, histograms, summaries.

Quantiles are exact with linear interpolation, and no task ever sees all values: equal values are folded, the
folded ones fall into blocks by value, the sizes of the blocks tell which ones hold the wanted ranks, and only
those are ordered. Defined cases: nulls take no part; a table without values gives no quantiles and no bins, and
so keeps no row in a trim or tail; a column with one value falls into one bin; a null key is a group of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCKS = 128


def quantiles(df: DataFrame, value: str, at: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, q): one array of quantiles a group."""
    keys = list(keys)
    # nulls are left out of JSON, so that a null key and an empty one differ
    ident = F.to_json(F.struct(*keys)) if keys else F.lit("")
    folded = df.where(F.col(value).isNotNull()).groupBy(ident.alias("g"), *[F.col(k).alias(f"k_{k}") for k in keys], F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    # one row of edges; where they are rough, blocks are of unequal size and the result is the same
    edges = folded.agg(F.percentile_approx("v", F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)]), F.lit(1000)).alias("edges"))
    laid = folded.join(F.broadcast(edges), how="cross").withColumn("b", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    sizes = laid.groupBy("g", *[f"k_{k}" for k in keys], "b").agg(F.sum("c").alias("s"))
    w = Window.partitionBy("g")
    sizes = sizes.withColumn("n", F.sum("s").over(w)).withColumn("before", F.sum("s").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)])).alias("w")
    # of each quantile the two ranks it lies between
    asked = sizes.select("*", wanted).withColumn("x", F.col("w.p") * (F.col("n") - 1))
    asked = asked.withColumn("r", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x"))))).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("s")))
    met = laid.select("g", "b", "v", "c").join(asked.select("g", "b", "before", "r", *[f"k_{k}" for k in keys], F.col("w.i").alias("i"), "x"), ["g", "b"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "b", "i", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = met.withColumn("upto", upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
    share = F.col("x") - F.floor("x")
    one = hit.groupBy("g", *[f"k_{k}" for k in keys], "i").agg((F.min("v") + (F.max("v") - F.min("v")) * F.max(share)).alias("q"))
    got = one.groupBy("g", *[f"k_{k}" for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))
    return got.select(*[F.col(f"k_{k}").alias(k) for k in keys], "q")


def trim(df: DataFrame, value: str, low: float, high: float, keys: list[str] = ()) -> DataFrame:
    """Rows between two quantiles of their group, bounds included."""
    q = quantiles(df, value, [low, high], list(keys))
    if keys:
        q = q.select(*[F.col(k).alias(f"__{k}") for k in keys], "q")
        one = df.join(q, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])
    else:
        one = df.join(F.broadcast(q), how="cross")  # one row
    return one.where(F.col(value).between(F.col("q")[0], F.col("q")[1])).drop("q")


def tail(df: DataFrame, value: str, from_: float) -> DataFrame:
    """Rows at or above a quantile."""
    q = quantiles(df, value, [from_])  # one row
    return df.join(F.broadcast(q), how="cross").where(F.col(value) >= F.col("q")[0]).drop("q")


def bins_by_quantile(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """`df` with its bin from 1 to n between the value edges of the quantiles, each closed on the right, the lowest value in bin 1.

    Equal edges make empty bins rather than an error; nulls have a null bin.
    """
    q = quantiles(df, value, [i / n for i in range(n + 1)])
    one = df.join(F.broadcast(q), how="cross")  # one row of n + 1 edges
    v = F.col(value)
    return one.withColumn(name, F.when(v.isNotNull(), F.greatest(F.lit(1), F.size(F.filter("q", lambda e: e < v))))).drop("q")


def histogram(df: DataFrame, value: str, n: int = 50) -> DataFrame:
    """(bin, low, high, n_values, density): n bins of equal width from least to greatest, the last one closed; empty bins included."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("total"))
    v = F.col(value)
    # a column with one value has no width: its values fall into the first bin
    at = F.when(F.col("a") == F.col("b"), 1).otherwise(F.least(F.lit(n), F.floor((v - F.col("a")) / (F.col("b") - F.col("a")) * n).cast("int") + 1))
    got = df.where(v.isNotNull()).join(F.broadcast(ends), how="cross").groupBy(at.alias("bin")).agg(F.count("*").alias("k"))
    grid = ends.where("total > 0").select("a", "b", "total", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin"))
    width = (F.col("b") - F.col("a")) / n
    one = grid.join(got, "bin", "left").withColumn("n_values", F.coalesce("k", F.lit(0)))
    return one.select("bin", (F.col("a") + width * (F.col("bin") - 1)).alias("low"), (F.col("a") + width * F.col("bin")).alias("high"), "n_values", F.try_divide(F.col("n_values"), F.col("total") * width).alias("density"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n): how often each value occurs, null included."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, std, least, q25, q50, q75, most) of a column."""
    v = F.col(value)
    one = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    # both sides have one row
    one = one.join(F.broadcast(quantiles(df, value, [0.25, 0.5, 0.75])), how="left", on=F.lit(True))
    return one.select("n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def share(flag: Column) -> Column:
    """Aggregate: share of rows with the flag set, null flags left out."""
    return F.avg(flag.cast("int"))
