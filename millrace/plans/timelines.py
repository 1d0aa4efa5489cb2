"""Queries over the course of companies through product categories: paths, transitions, expansion, shares; and pages that speak of other products.

The analyses of paths and shares are designed here, as no code for them is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import rules
from millrace.plans.registry import Registry
from millrace.plans.texts import _keywords
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_name, category, year): the first year of each company in each category."""
    one = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product' and company_name is not null and product_category is not null")
    return one.withColumn("year", rules.number(F.col("year_launched")).cast("int")).where("year is not null").groupBy("company_name", F.col("product_category").alias("category")).agg(F.min("year").alias("year"))


LAUNCHES = r"""launches as (select company_name, product_category as category, min(try_cast(trim(year_launched) as double)::integer) as year from fintech_timelines_master
  where entry_type = 'Product' and company_name is not null and product_category is not null and regexp_full_match(year_launched, '\s*\d+(\.\d*)?\s*') group by all)"""


@R.query(f"""with {LAUNCHES}, paths as (select company_name, string_agg(category, ' > ' order by year, category) as path from launches group by 1)
select path, count(*)::bigint as n_companies from paths group by 1""")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many companies entered categories in each order."""
    steps = F.array_sort(F.collect_list(F.struct("year", "category")))
    paths = _launches(spark, sf_dir).groupBy("company_name").agg(F.array_join(F.transform(steps, lambda x: x["category"]), " > ").alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n_companies"))


@R.query(f"""with {LAUNCHES}, s as (select category, lag(category) over (partition by company_name order by year, category) as before from launches)
select before, category as after, count(*)::bigint as n from s where before is not null group by all""")
def category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which category companies went on to which."""
    before = F.lag("category").over(Window.partitionBy("company_name").orderBy("year", "category"))
    return _launches(spark, sf_dir).withColumn("before", before).where("before is not null").groupBy("before", F.col("category").alias("after")).agg(F.count("*").alias("n"))


@R.query(f"""with {LAUNCHES}, f as (select company_name, min(year) as first from launches group by 1)
select category, count(*)::bigint as n_companies, round(avg(year - first), 6) as mean_years, max(year - first)::integer as most_years from launches join f using (company_name) group by 1""")
def expansion_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many years after their first product companies entered each category."""
    one = _launches(spark, sf_dir)
    since = F.col("year") - F.min("year").over(Window.partitionBy("company_name"))
    return one.withColumn("since", since).groupBy("category").agg(F.count("*").alias("n_companies"), F.round(F.avg("since"), 6).alias("mean_years"), F.max("since").alias("most_years"))


@R.query("""with n as (select trim(bank_partner_specific) as bank, product_type, count(*) as n from extracted_product_info_v2 where status = 'OK' and trim(bank_partner_specific) <> '' and product_type is not null group by all)
select bank, product_type, n::bigint as n, round(n / sum(n) over (partition by bank), 6) as share from n""")
def partner_specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each product type among the products of a partner."""
    one = table(spark, sf_dir, "extracted_product_info_v2").where("status = 'OK' and trim(bank_partner_specific) <> '' and product_type is not null")
    n = one.groupBy(F.trim("bank_partner_specific").alias("bank"), "product_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("bank")), 6))


@R.query(rf"""with names as (select distinct company_name, product_name, {_keywords('product_name')} as ws from fintech_timelines_master where entry_type = 'Product' and company_name is not null and product_name is not null),
p as (select page_id, company_name, coalesce(product_name, '') as own, regexp_replace(lower(text_preview), '[^a-z0-9 ]', ' ', 'g') as low from product_pages where company_name is not null and text_preview is not null)
select page_id, n.product_name as mentioned from p join names n using (company_name) where n.product_name <> own and (len(ws) = 0 or len(list_filter(ws, lambda w: contains(low, w))) / len(ws) >= 0.5)""")
def cross_product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that mention another product of their company: candidates for its context.

    A page meets one row with all products of its company, and only the mentioned ones become rows; pages are not
    paired with products, nor with each other.
    """
    own = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product' and company_name is not null and product_name is not null").select("company_name", "product_name").distinct()
    names = own.groupBy("company_name").agg(F.collect_list(F.struct("product_name", text.keywords(F.col("product_name")).alias("ws"))).alias("names"))
    pages = table(spark, sf_dir, "product_pages").where("company_name is not null and text_preview is not null").select("page_id", "company_name", F.coalesce("product_name", F.lit("")).alias("own"), F.regexp_replace(F.lower("text_preview"), r"[^a-z0-9 ]", " ").alias("low"))
    share = lambda x: (F.size(x["ws"]) == 0) | (F.size(F.filter(x["ws"], lambda w: F.contains(F.col("low"), w))) / F.size(x["ws"]) >= 0.5)
    met = pages.join(names, "company_name")
    return met.select("page_id", F.explode(F.filter("names", lambda x: (x["product_name"] != F.col("own")) & share(x))).alias("n")).select("page_id", F.col("n.product_name").alias("mentioned"))
