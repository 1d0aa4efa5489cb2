"""Queries of entity by period panels.

An entity is a customer, its activities are orders, a period is a half-year, the category of an activity is
its priority; the partner of an activity is its status, and open ones ('O') have none.

Defined cases: activities without entity or date are dropped; an entity missing in the customers has no
birth category, and one with several has a row for each; a mean without values and a deviation of fewer than two are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.dates import half_year
from millrace.operators import rules, windows
from millrace.session import table

# fixed texts: categories by the name of their columns
CATEGORIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "not_specified": "4-NOT SPECIFIED", "low": "5-LOW"}


def entity_period_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity and half-year with activity: counts, partners in order of appearance, and figures by category."""
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderdate is not null")
    one = orders.select(F.col("o_custkey").alias("entity"), half_year(F.col("o_orderdate")).alias("period"), "o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("partner"), "o_orderpriority", "o_totalprice")
    has = F.col("partner").isNotNull()
    flag = lambda c: F.coalesce(F.max(F.when(c, 1).otherwise(0)), F.lit(0))
    by_category = []
    for name, value in CATEGORIES.items():
        inside = F.col("o_orderpriority") == value
        price = F.when(inside, F.col("o_totalprice"))
        by_category += [flag(inside).alias(f"has_{name}"), flag(inside & has).alias(f"has_{name}_partner"), F.round(F.avg(price), 6).alias(f"avg_price_{name}"), F.round(F.stddev_samp(price), 4).alias(f"std_price_{name}")]
    panel = one.groupBy("entity", "period").agg(
        F.count("*").alias("n_activities"),
        F.count("partner").alias("n_with_partner"),
        F.count_distinct("partner").alias("n_partners"),
        flag(has).alias("has_partner"),
        *by_category,
    )
    birth = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("birth_category")).distinct()
    named = windows.first_seen_list(one, ["entity", "period"], "partner", "o_orderkey", "partners")
    return panel.join(named, ["entity", "period"], "left").withColumn("partners", F.coalesce("partners", F.lit(""))).join(birth, "entity", "left")


def _panel_sql() -> str:
    by_category = []
    for name, value in CATEGORIES.items():
        inside = f"o_orderpriority = '{value}'"
        by_category += [
            f"coalesce(max(case when {inside} then 1 else 0 end), 0)::integer as has_{name}",
            f"coalesce(max(case when {inside} and partner is not null then 1 else 0 end), 0)::integer as has_{name}_partner",
            f"round(avg(case when {inside} then o_totalprice end), 6) as avg_price_{name}",
            f"round(stddev_samp(case when {inside} then o_totalprice end), 4) as std_price_{name}",
        ]
    columns = ",\n  ".join(by_category)
    return f"""
with one as (
  select o_custkey as entity, year(o_orderdate)::varchar || case when month(o_orderdate) <= 6 then '-H1' else '-H2' end as period,
    o_orderkey, nullif(o_orderstatus, 'O') as partner, o_orderpriority, o_totalprice
  from orders where o_custkey is not null and o_orderdate is not null
), firsts as (
  select entity, period, partner, min(o_orderkey) as ord from one where partner is not null group by all
), named as (
  select entity, period, string_agg(partner, '; ' order by ord, partner) as partners from firsts group by all
), panel as (
  select entity, period, count(*)::bigint as n_activities, count(partner)::bigint as n_with_partner, count(distinct partner)::bigint as n_partners,
  max(case when partner is not null then 1 else 0 end)::integer as has_partner,
  {columns}
  from one group by entity, period
)
select entity, period, n_activities, n_with_partner, n_partners, coalesce(partners, '') as partners,
  panel.* exclude (entity, period, n_activities, n_with_partner, n_partners), birth_category
from panel left join named using (entity, period)
left join (select distinct c_custkey as entity, c_mktsegment as birth_category from customer) using (entity)
"""


BROAD = {"financial": "Financial", "non_financial": "Non-financial"}
# fixed values: what is cut from the name of a partner
PARTNER_TAILS = [r"\s*,?\s*\bMember FDIC\b.*$", r",?\s*\bN\.?A\.?$"]


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good extracted rows with the broad categories of their product; a product of two categories has two rows."""
    info = table(spark, sf_dir, "extracted_product_info_v2").where("status = 'OK' and company is not null and period is not null")
    kinds = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product'").select(F.col("company_name").alias("company"), "product_name", "product_broad_category").distinct()
    real = lambda c: F.when(F.col(c).rlike(r"\S"), F.col(c))
    one = info.select("extract_id", "company", "product_name", "period", real("bank_partner_specific").alias("partner"), rules.number(F.regexp_replace("interest_rate", "%", "")).alias("rate"))
    return one.join(kinds, ["company", "product_name"], "left")


def firm_period_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each company and half-year: activities, partners in order of appearance, flags and mean rates by broad category, and the category the company began in."""
    one, has = _activity(spark, sf_dir), F.col("partner").isNotNull()
    flag = lambda c: F.coalesce(F.max(F.when(c, 1).otherwise(0)), F.lit(0))
    by_category = []
    for name, value in BROAD.items():
        inside = F.col("product_broad_category") == value
        by_category += [flag(inside).alias(f"has_{name}"), flag(inside & has).alias(f"has_{name}_partner"), F.round(F.avg(F.when(inside, F.col("rate"))), 6).alias(f"avg_rate_{name}")]
    panel = one.groupBy("company", "period").agg(
        F.count("*").alias("n_activities"), F.count("partner").alias("n_with_partner"), F.count_distinct("partner").alias("n_partners"), *by_category
    )
    birth = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product'").groupBy(F.col("company_name").alias("company")).agg(F.min_by("product_category", F.when(F.col("product_category").isNotNull(), F.col("row_id"))).alias("birth_category"))
    named = windows.first_seen_list(one, ["company", "period"], "partner", "extract_id", "partners")
    return panel.join(named, ["company", "period"], "left").withColumn("partners", F.coalesce("partners", F.lit(""))).join(birth, "company", "left")


def partner_period_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each partner, its name without legal tails, and half-year: companies in order of appearance, and rates by broad category with their sample deviation."""
    one = _activity(spark, sf_dir).withColumn("bank_name", text.legal_form_free(F.col("partner"), PARTNER_TAILS)).where("bank_name <> ''")
    by_category = []
    for name, value in BROAD.items():
        rate = F.when(F.col("product_broad_category") == value, F.col("rate"))
        by_category += [F.count_distinct(F.when(F.col("product_broad_category") == value, F.col("company"))).alias(f"n_firms_{name}"), F.round(F.avg(rate), 6).alias(f"avg_rate_{name}"), F.round(F.stddev_samp(rate), 4).alias(f"std_rate_{name}")]
    named = windows.first_seen_list(one, ["bank_name", "period"], "company", "extract_id", "firms")
    return one.groupBy("bank_name", "period").agg(F.count_distinct("company").alias("n_firms"), *by_category).join(named, ["bank_name", "period"])


ACTIVITY = r"""act as (
  select extract_id, company, e.product_name, period, case when regexp_matches(bank_partner_specific, '\S') then bank_partner_specific end as partner,
    case when regexp_full_match(replace(interest_rate, '%', ''), '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim(replace(interest_rate, '%', '')) as double) end as rate, product_broad_category
  from extracted_product_info_v2 e left join (select distinct company_name as company, product_name, product_broad_category from fintech_timelines_master where entry_type = 'Product') k using (company, product_name)
  where status = 'OK' and company is not null and period is not null)"""


def _firm_sql() -> str:
    by = ", ".join(
        f"coalesce(max(case when product_broad_category = '{v}' then 1 else 0 end), 0)::integer as has_{n}, coalesce(max(case when product_broad_category = '{v}' and partner is not null then 1 else 0 end), 0)::integer as has_{n}_partner, round(avg(case when product_broad_category = '{v}' then rate end), 6) as avg_rate_{n}"
        for n, v in BROAD.items()
    )
    return f"""with {ACTIVITY},
seen as (select company, period, partner, min(extract_id) as o from act where partner is not null group by all),
named as (select company, period, string_agg(partner, '; ' order by o, partner) as partners from seen group by all),
birth as (select company_name as company, arg_min(product_category, row_id) as birth_category from fintech_timelines_master where entry_type = 'Product' and product_category is not null group by 1),
panel as (select company, period, count(*)::bigint as n_activities, count(partner)::bigint as n_with_partner, count(distinct partner)::bigint as n_partners, {by} from act group by company, period)
select panel.*, coalesce(partners, '') as partners, birth_category from panel left join named using (company, period) left join birth using (company)"""


def _partner_sql() -> str:
    by = ", ".join(
        f"count(distinct case when product_broad_category = '{v}' then company end)::bigint as n_firms_{n}, round(avg(case when product_broad_category = '{v}' then rate end), 6) as avg_rate_{n}, round(stddev_samp(case when product_broad_category = '{v}' then rate end), 4) as std_rate_{n}"
        for n, v in BROAD.items()
    )
    return rf"""with {ACTIVITY},
own as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(partner, '(?i)\s*,?\s*\bMember FDIC\b.*$', '', 'g'), '(?i),?\s*\bN\.?A\.?$', '', 'g'), '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '') as bank_name from act where partner is not null),
seen as (select bank_name, period, company, min(extract_id) as o from own group by all),
named as (select bank_name, period, string_agg(company, '; ' order by o, company) as firms from seen group by all),
panel as (select bank_name, period, count(distinct company)::bigint as n_firms, {by} from own where bank_name <> '' group by bank_name, period)
select panel.*, firms from panel join named using (bank_name, period)"""


QUERIES = {"entity_period_panel": entity_period_panel, "firm_period_panel": firm_period_panel, "partner_period_panel": partner_period_panel}
SQL = {"entity_period_panel": _panel_sql(), "firm_period_panel": _firm_sql(), "partner_period_panel": _partner_sql()}
