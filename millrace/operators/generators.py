"""Generated rows: active years, half-years, quarter ends, task grids and ranked candidates.

Defined cases: a span whose end lies before its start gives no rows; a null start gives none; a null end is
read as the given last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates


def span(first: Column, last: Column) -> Column:
    """Whole numbers from first to last, empty if last is less (`sequence` alone would count down)."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def active_years(df: DataFrame, start: str, end: str, first: int, last: int, name: str = "year") -> DataFrame:
    """One row for each year from start to end, within the bounds; the end defaults to `last`."""
    a, b = F.greatest(F.col(start).cast("int"), F.lit(first)), F.least(F.coalesce(F.col(end).cast("int"), F.lit(last)), F.lit(last))
    return df.where(F.col(start).isNotNull()).withColumn(name, F.explode(span(a, b)))


def half_years(df: DataFrame, date: str) -> DataFrame:
    """(h, period, cutoff): every half-year from the least date to the first whose end is past the greatest one."""
    got = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a is not null")
    last = dates.half_year_index(F.col("b")) + F.when(dates.half_year_end(dates.half_year_index(F.col("b"))) > F.col("b"), 0).otherwise(1)
    one = got.select(F.explode(F.sequence(dates.half_year_index(F.col("a")), last)).alias("h"))
    return one.select("h", dates.half_year_name(F.col("h")).alias("period"), dates.half_year_end(F.col("h")).alias("cutoff"))


def quarter_ends(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(quarter_end, quarter_code): the quarter ends from one date to another."""
    one = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "quarter"), F.lit(last).cast("date"), F.expr("interval 3 months"))).alias("q"))
    end = F.last_day(F.add_months("q", 2))
    return one.select(end.alias("quarter_end")).where(F.col("quarter_end") <= F.lit(last).cast("date")).withColumn("quarter_code", dates.quarter_code(F.col("quarter_end")))


def task_grid(df: DataFrame, first: Column, last: int, months: list[int], upto: tuple[int, int]) -> DataFrame:
    """`df` with a row for each year from `first` to `last` and each month, up to the given (year, month)."""
    one = df.withColumn("year", F.explode(span(first.cast("int"), F.lit(last)))).withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    return one.where(F.col("year") * 12 + F.col("month") <= upto[0] * 12 + upto[1])
