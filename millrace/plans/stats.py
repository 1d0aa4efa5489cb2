"""Queries of distribution statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
AT = [0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999]


@R.query("select event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) as q{str(p)[2:]}" for p in AT) + " from events group by 1")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of event values by type, extreme ones included."""
    q = stats.quantiles(table(spark, sf_dir, "events"), "value", AT, ["event_type"])
    return q.select("event_type", *[F.round(F.col("q")[i], 6).alias(f"q{str(p)[2:]}") for i, p in enumerate(AT)])


@R.query("""
with q as (select event_type, quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as b from events group by 1)
select event_type, count(*)::bigint as n, round(avg(value), 6) as mean, max(value) as most from events join q using (event_type) where value between a and b group by 1
""")
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values between the first and the last percentile of their type."""
    one = stats.trim(table(spark, sf_dir, "events").select("event_type", "value"), "value", 0.01, 0.99, ["event_type"])
    return one.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@R.query("select count(*)::bigint as n, min(o_totalprice) as least, max(o_totalprice) as most from orders where o_totalprice between (select quantile_cont(o_totalprice, 0.001) from orders) and (select quantile_cont(o_totalprice, 0.999) from orders)")
def quantile_trim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices between two quantiles of all orders."""
    return stats.trim(table(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice", 0.001, 0.999).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@R.query("select o_orderkey, o_totalprice from orders where o_totalprice >= (select quantile_cont(o_totalprice, 0.99) from orders)")
def outlier_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at or above the last percentile of price."""
    return stats.tail(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.99)


@R.query("""
with q as (select quantile_cont(c_acctbal, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) as e from customer),
b as (select c_acctbal, greatest(1, len(list_filter(e, lambda x: x < c_acctbal))) as decile from customer, q)
select decile::integer as decile, count(*)::bigint as n, round(avg(c_acctbal), 4) as mean from b group by 1
""")
def qcut_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of customer balances by value edges, with count and mean."""
    one = stats.bins_by_quantile(table(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal", 10, "decile")
    return one.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@R.query("""
with e as (select min(value) as a, max(value) as b, count(value) as n from events),
v as (select least(50, floor((value - a) / (b - a) * 50)::integer + 1) as bin, count(*) as k from events, e group by 1)
select g.bin::integer as bin, round(a + (b - a) / 50 * (g.bin - 1), 6) as low, round(a + (b - a) / 50 * g.bin, 6) as high, coalesce(k, 0)::bigint as n_values, round(coalesce(k, 0) / (n * ((b - a) / 50)), 6) as density
from e, range(1, 51) g(bin) left join v on v.bin = g.bin
""")
def histogram_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values in fifty bins of equal width, as counts and as density."""
    one = stats.histogram(table(spark, sf_dir, "events").select("value"), "value")
    return one.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_values", F.round("density", 6).alias("density"))


@R.query("""
select event_type, date_trunc('day', ts)::date as day, count(*)::bigint as n, round(avg((value > 10)::integer), 6) as share_high, round(avg(abs(value - 10)), 6) as mean_off, min(value) as least, max(value) as most, round(stddev_samp(value), 5) as std
from events group by all
""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures of each event type: share above a bound, mean distance, extremes, sample deviation."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.round(stats.share(v > 10), 6).alias("share_high"), F.round(F.avg(F.abs(v - 10)), 6).alias("mean_off"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.stddev_samp(v), 5).alias("std")
    )


@R.query("select count(value)::bigint as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as least, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75, max(value) as most from events")
def describe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual summary of event values."""
    return stats.describe(table(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@R.query("select page_type as value, count(*)::bigint as n from product_pages group by 1")
def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page types with their counts, null included, most frequent first."""
    return stats.value_counts(table(spark, sf_dir, "product_pages"), "page_type").orderBy(F.desc("n"), F.col("value").asc_nulls_last())


@R.query("select company_name, count(*)::bigint as n_missed from product_pages where snapshot_timestamp is null and company_name is not null group by 1 order by n_missed desc, company_name limit 15")
def top_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen companies with most missed fetches; the limit is the feature."""
    one = table(spark, sf_dir, "product_pages").where("snapshot_timestamp is null and company_name is not null")
    return one.groupBy("company_name").agg(F.count("*").alias("n_missed")).orderBy(F.desc("n_missed"), "company_name").limit(15)


@R.query("""
select row_id, round((end_year - y) / nullif(y - 2000, 0), 6) as ratio, abs(y - 2012)::integer as off, round(100.0 * (end_year - y) / nullif(y, 0), 6) as pct
from (select row_id, end_year, try_cast(year_launched as double)::integer as y from fintech_timelines_master where regexp_full_match(year_launched, '\\d{4}') and end_year is not null) where abs(y - 2012) <= 8
""")
def proportional_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios and percentages, null where there is nothing to divide by, within a bound of size."""
    y = F.col("year_launched").cast("int")
    one = table(spark, sf_dir, "fintech_timelines_master").where(F.col("year_launched").rlike(r"^\d{4}$") & F.col("end_year").isNotNull())
    one = one.select("row_id", "end_year", y.alias("y")).where(F.abs(F.col("y") - 2012) <= 8)
    return one.select("row_id", F.round(F.try_divide(F.col("end_year") - F.col("y"), F.col("y") - 2000), 6).alias("ratio"), F.abs(F.col("y") - 2012).alias("off"), F.round(F.try_divide(100.0 * (F.col("end_year") - F.col("y")), F.col("y")), 6).alias("pct"))
