"""Queries in time: snapshots, half-years, carried pages, validity, coverage, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import dates, text, url
from millrace.operators import generators, rules, temporal, windows
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "product_pages")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _pages(spark, sf_dir).select("target_url", "snapshot_timestamp").where("target_url is not null and snapshot_timestamp is not null").distinct()
    return one.withColumn("day", dates.day_number(F.col("snapshot_timestamp"))).withColumn("number", F.unix_date(dates.snapshot_date(F.col("snapshot_timestamp"))))


SNAPSHOTS = "snapshots as (select distinct target_url, snapshot_timestamp from product_pages where target_url is not null and snapshot_timestamp is not null)"


@R.query(f"with {SNAPSHOTS} select target_url, min(snapshot_timestamp) as first_of_month, max(snapshot_timestamp) as last_of_month from snapshots group by target_url, substring(snapshot_timestamp, 1, 6)")
def monthly_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest and the latest snapshot of every address in each calendar month."""
    one = _snapshots(spark, sf_dir)
    return one.groupBy("target_url", F.substring("snapshot_timestamp", 1, 6).alias("m")).agg(F.min("snapshot_timestamp").alias("first_of_month"), F.max("snapshot_timestamp").alias("last_of_month")).drop("m")


@R.query("select user_id, arg_min(event_id, (ts, event_id)) as event_id from events group by user_id, date_trunc('day', ts)")
def daily_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user and day."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).drop("d")


@R.query(f"""
with {SNAPSHOTS}, r as (select *, row_number() over (partition by target_url, substring(snapshot_timestamp, 1, 4) order by snapshot_timestamp) as k from snapshots)
select target_url, snapshot_timestamp, k::integer as rank from r where k <= 3
""")
def yearly_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three snapshots of every address and year."""
    return windows.top(_snapshots(spark, sf_dir).select("target_url", "snapshot_timestamp"), ["target_url", F.substring("snapshot_timestamp", 1, 4)], 3, F.col("snapshot_timestamp"))


@R.query("""
with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, greatest(1, count(*) over (partition by user_id) // 10) as step from events)
select user_id, event_id from r where i % step = 0 and i // step < 10
""")
def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten events of every user at even steps."""
    return windows.thinned(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], 10, F.col("ts"), F.col("event_id"), block=F.to_date("ts")).select("user_id", "event_id")


def _targets(spark: SparkSession, sf_dir: str, axis: str) -> DataFrame:
    years = _snapshots(spark, sf_dir).groupBy("target_url").agg(F.min(F.substring("snapshot_timestamp", 1, 4).cast("int")).alias("a"), F.max(F.substring("snapshot_timestamp", 1, 4).cast("int")).alias("b"))
    one = years.select("target_url", F.explode(F.sequence("a", "b")).alias("year")).withColumn("month", F.explode(F.array(F.lit(1), F.lit(7))))
    first = F.make_date("year", "month", F.lit(1))
    return one.withColumn("target", F.unix_date(first) if axis == "number" else F.col("year") * 10000 + F.col("month") * 100 + 1)


TARGETS = f"""{SNAPSHOTS}, years as (select target_url, min(substring(snapshot_timestamp, 1, 4)::integer) as a, max(substring(snapshot_timestamp, 1, 4)::integer) as b from snapshots group by 1),
targets as (select target_url, year, month from (select target_url, unnest(range(a, b + 1))::integer as year from years) cross join (values (1), (7)) m(month))"""


@R.query(f"""
with {TARGETS}, best as (
  select t.*, s.snapshot_timestamp, abs(substring(s.snapshot_timestamp, 1, 8)::integer - (year * 10000 + month * 100 + 1)) as d
  from targets t join snapshots s using (target_url) qualify row_number() over (partition by t.target_url, year, month order by d, s.snapshot_timestamp) = 1
), once as (select * from best qualify row_number() over (partition by target_url, snapshot_timestamp order by year, month) = 1)
select target_url, year, month, snapshot_timestamp, d::bigint as distance from once
""")
def nearest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each address the snapshot nearest to the first of January and July of each year, by distance of YYYYMMDD numbers; a snapshot serves its first target only."""
    got = temporal.nearest(_targets(spark, sf_dir, "day"), _snapshots(spark, sf_dir), "target_url", "target", "day", "snapshot_timestamp")
    return temporal.used_once(got, "target_url", "snapshot_timestamp", "target").select("target_url", "year", "month", "snapshot_timestamp", "distance")


@R.query(f"""
with {TARGETS}, best as (
  select t.*, s.snapshot_timestamp, abs(date_diff('day', make_date(year, month, 1), strptime(substring(s.snapshot_timestamp, 1, 8), '%Y%m%d')::date)) as d
  from targets t join snapshots s using (target_url) qualify row_number() over (partition by t.target_url, year, month order by d, s.snapshot_timestamp) = 1
)
select target_url, year, month, case when d <= 90 then snapshot_timestamp end as snapshot_timestamp, d::bigint as distance, case when d <= 90 then 'OK' else 'too_far' end as status from best
""")
def nearest_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the nearest snapshot, by true days; one further off than 90 days is no match and its row says so."""
    got = temporal.nearest(_targets(spark, sf_dir, "number"), _snapshots(spark, sf_dir), "target_url", "target", "number", "snapshot_timestamp")
    near = F.col("distance") <= 90
    return got.select("target_url", "year", "month", F.when(near, F.col("snapshot_timestamp")).alias("snapshot_timestamp"), "distance", F.when(near, "OK").otherwise("too_far").alias("status"))


@R.query("""
select target_url, min(snapshot_timestamp) as first_seen, count(distinct substring(snapshot_timestamp, 1, 4))::bigint as n_years, string_agg(distinct substring(snapshot_timestamp, 1, 4), ';' order by substring(snapshot_timestamp, 1, 4)) as years
from product_pages where target_url is not null and snapshot_timestamp is not null group by 1
""")
def first_seen_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First snapshot of every address and the years it was seen in."""
    one = _pages(spark, sf_dir).where("target_url is not null and snapshot_timestamp is not null")
    years = F.array_sort(F.collect_set(F.substring("snapshot_timestamp", 1, 4)))
    return one.groupBy("target_url").agg(F.min("snapshot_timestamp").alias("first_seen"), F.size(years).cast("long").alias("n_years"), F.array_join(years, ";").alias("years"))


@R.query("""
with p as (select distinct company_name, target_year * 12 + target_month as m from product_pages where page_type in ('terms', 'deep_terms') and company_name is not null and target_year is not null),
l as (select row_id, company_name, try_cast(year_launched as integer) * 12 + 1 as m from fintech_timelines_master where regexp_full_match(year_launched, '\\d{4}'))
select row_id, arg_min(p.m, (abs(p.m - l.m), p.m))::bigint as period_month, min(abs(p.m - l.m))::bigint as distance from l join p using (company_name) group by 1
""")
def nearest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each product launch the month nearest to it for which terms of its company were fetched; the earlier of two."""
    months = _pages(spark, sf_dir).where(F.col("page_type").isin("terms", "deep_terms") & F.col("company_name").isNotNull()).select("company_name", dates.month_index(F.col("target_year"), F.col("target_month")).alias("m")).where("m is not null")
    launched = table(spark, sf_dir, "fintech_timelines_master").where(F.col("year_launched").rlike(r"^\d{4}$") & F.col("company_name").isNotNull()).select("row_id", "company_name", dates.month_index(F.col("year_launched").cast("int"), F.lit(1)).alias("target"))
    got = temporal.nearest(launched, months.withColumn("period_month", F.col("m").cast("long")), "company_name", "target", "m", "period_month")
    return got.where("period_month is not null").select("row_id", "period_month", "distance")


@R.query("""
select row_id, year, month from (select row_id, unnest(range(greatest(try_cast(year_launched as integer), 2005), 2026))::integer as year from fintech_timelines_master where entry_type = 'Product' and regexp_full_match(year_launched, '\\d{4}'))
cross join (values (1), (7)) m(month) where year * 12 + month <= 2025 * 12 + 6
""")
def task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with each January and July since its launch, nothing of the future."""
    one = table(spark, sf_dir, "fintech_timelines_master").where((F.col("entry_type") == "Product") & F.col("year_launched").rlike(r"^\d{4}$")).select("row_id", "year_launched")
    return generators.task_grid(one, F.greatest(F.col("year_launched").cast("int"), F.lit(2005)), 2025, [1, 7], (2025, 6)).select("row_id", "year", "month")


@R.query("""
with recursive d as (select min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders where o_orderdate is not null),
walk as (select year(a) * 2 + (case when month(a) <= 6 then 0 else 1 end) as h, b from d
  union all select h + 1, b from walk where (case when h % 2 = 0 then make_date((h // 2)::integer, 6, 30) else make_date((h // 2)::integer, 12, 31) end) <= b)
select (h // 2)::varchar || (case when h % 2 = 0 then '-H1' else '-H2' end) as period, case when h % 2 = 0 then make_date((h // 2)::integer, 6, 30) else make_date((h // 2)::integer, 12, 31) end as cutoff from walk
""")
def half_year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half-years of all orders, up to the first that ends past the last order."""
    return generators.half_years(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), "d").select("period", "cutoff")


@R.query("""
with pages as (select page_id, company_name, product_name, target_url, snapshot_date::date as d, text_preview, regexp_replace(lower(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1)), '[-_/;]', ' ', 'g') as said
  from product_pages where company_name is not null and product_name is not null and target_url is not null and regexp_full_match(snapshot_date, '\\d{4}-\\d{2}-\\d{2}') and text_preview is not null),
h as (select *, year(d) * 2 + (case when month(d) <= 6 then 0 else 1 end) as h from pages),
top as (select max(h) as top from h),
latest as (select * from h qualify row_number() over (partition by company_name, product_name, target_url, h order by d desc, page_id) = 1),
spans as (select *, coalesce(lead(h) over (partition by company_name, product_name, target_url order by h) - 1, top) as until from latest, top),
carried as (select company_name, product_name, target_url, page_id, h as own, unnest(range(h, until + 1)) as p, text_preview, said from spans),
kept as (select c.* from carried c where p = own or (trim(said) <> '' and exists (select 1 from carried f where f.own = f.p and f.p = c.p and f.company_name = c.company_name and f.product_name = c.product_name and contains(lower(f.text_preview), trim(c.said))))),
words as (select distinct product_name, list_filter(string_split(lower(regexp_replace(regexp_replace(product_name, '[^a-zA-Z0-9 ]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda w: length(w) > 2 and not list_contains(['the','a','an','for','and','or','of','by','in','on','to','with','from','at','is','it','as'], w)) as ws from kept),
alive as (select distinct company_name, product_name, p from kept join words using (product_name)
  where own = p and (len(ws) = 0 or len(list_filter(ws, lambda w: contains(regexp_replace(lower(text_preview), '[^a-z0-9 ]', ' ', 'g'), w))) / len(ws) >= 0.5))
select company_name, product_name, (p // 2)::varchar || (case when p % 2 = 0 then '-H1' else '-H2' end) as period, count(*)::bigint as n_pages, count(*) filter (where own = p)::bigint as n_fresh,
  string_agg(page_id::varchar, ';' order by page_id) as pages from kept join alive using (company_name, product_name, p) group by company_name, product_name, p
""")
def carry_forward_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that stand for each product and half-year: the latest of each address, carried on while a fresh page
    names it, in the half-years in which a fresh page mentions the product.

    An address is named by the words of its path, as these texts hold no markup. Only ids are carried; a page's
    text is read once, for what it names and mentions.
    """
    keys = ["company_name", "product_name"]
    words = F.trim(F.regexp_replace(F.lower(url.path(F.col("target_url"))), r"[-_/;]", " "))
    day = F.when(F.col("snapshot_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("snapshot_date", "yyyy-MM-dd"))
    pages = _pages(spark, sf_dir).where("company_name is not null and product_name is not null and target_url is not null and text_preview is not null").select("page_id", *keys, "target_url", day.alias("day"), "text_preview").where("day is not null")
    top = pages.agg(F.max(dates.half_year_index(F.col("day"))).alias("top"))
    # the last half-year is one row
    carried = temporal.carried_pages(pages.drop("text_preview").join(F.broadcast(top), how="cross"), keys, "target_url", "day", "page_id", F.col("top"))
    # one row of addresses a product beside its pages: no pairs of pages
    sites = pages.select(*keys, "target_url", words.alias("words")).where("words <> ''").distinct().groupBy(*keys).agg(F.collect_list(F.struct("target_url", "words")).alias("sites"))
    told = pages.select("page_id", *keys, F.lower("text_preview").alias("low")).join(sites, keys)
    says = told.select("page_id", F.explode(F.filter("sites", lambda s: F.contains(F.col("low"), s["words"]))).alias("s")).select("page_id", F.col("s.target_url").alias("named"))
    kept = temporal.reachable(carried, says, keys, "target_url", "page_id")
    mention = pages.select("page_id", text.mentions(F.col("text_preview"), text.keywords(F.col("product_name"))).alias("mentions"))
    live = temporal.alive(kept.join(mention, "page_id"), keys, F.col("mentions"))
    panel = live.groupBy(*keys, "h").agg(F.count("*").alias("n_pages"), F.count_if("fresh").alias("n_fresh"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ";").alias("pages"))
    return panel.select(*keys, dates.half_year_name(F.col("h")).alias("period"), "n_pages", "n_fresh", "pages")


@R.query("""
with spans as (select row_id, company_name, product_name, try_cast(year_launched as double)::integer as a, coalesce(end_year::integer, 2030) as b from fintech_timelines_master where entry_type = 'Product' and company_name is not null and product_name is not null)
select page_id, row_id, target_year from product_pages p join spans s using (company_name, product_name) where p.target_year is null or (a < p.target_year and b > p.target_year)
""")
def validity_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the master rows of their product that were valid at their target year, both ends strict."""
    spans = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product'").select("row_id", "company_name", "product_name", rules.number(F.col("year_launched")).cast("int").alias("a"), F.coalesce(F.col("end_year").cast("int"), F.lit(2030)).alias("b"))
    pages = _pages(spark, sf_dir).select("page_id", "company_name", "product_name", "target_year")
    return temporal.valid_at(pages, spans, ["company_name", "product_name"], "target_year", "a", "b", ["row_id"]).select("page_id", "row_id", "target_year")


@R.query("""
with periods as (select y * 12 + m as p, y as year, m as month from range(2005, 2026) t(y), (values (1), (7)) v(m)),
products as (select company_name, product_name, try_cast(year_launched as double)::integer as y from fintech_timelines_master where entry_type = 'Product' and product_broad_category = 'Financial' and try_cast(year_launched as double) >= 2005),
seen as (select distinct company_name, product_name, target_year * 12 + target_month as p from product_pages where text_length > 0 and target_year is not null)
select year::integer as year, month::integer as month, (select count(*) from products where products.y <= year)::bigint as n_launched, (select count(*) from (select distinct company_name, product_name from products where products.y <= year))::bigint as n_pairs,
  (select count(*) from (select distinct company_name, product_name from products where products.y <= year intersect select company_name, product_name from seen where seen.p <= periods.p))::bigint as n_found
from periods
""")
def cumulative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each January and July how many financial products were launched by then, and how many of them had been fetched.

    Every product counts from the first period on; running totals over the periods take the place of a join with
    all that came before. Pairs of which one name is null are met by null-safe equality, as in a set.
    """
    grid = spark.range(2005, 2026).select(F.col("id").cast("int").alias("year")).withColumn("month", F.explode(F.array(F.lit(1), F.lit(7)))).withColumn("p", F.col("year") * 12 + F.col("month"))
    year = rules.number(F.col("year_launched")).cast("int")
    products = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product' and product_broad_category = 'Financial'").select("company_name", "product_name", (year * 12 + 1).alias("p")).where("p >= 2005 * 12")
    seen = _pages(spark, sf_dir).where("text_length > 0 and target_year is not null").groupBy(F.col("company_name").alias("c"), F.col("product_name").alias("n")).agg(F.min(F.col("target_year") * 12 + F.col("target_month")).alias("s"))
    pairs = products.groupBy("company_name", "product_name").agg(F.min("p").alias("p"))
    got = pairs.join(seen, F.col("company_name").eqNullSafe(F.col("c")) & F.col("product_name").eqNullSafe(F.col("n")), "left").withColumn("found", F.greatest("p", "s"))
    # a month between two periods counts from the next one on
    up = lambda c: F.when(c % 12 == 1, c).when((c % 12 >= 2) & (c % 12 <= 7), c - c % 12 + 7).otherwise(F.when(c % 12 == 0, c + 1).otherwise(c - c % 12 + 13))
    steps = products.select(up(F.col("p")).alias("p"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("f"))
    steps = steps.unionByName(pairs.select(up(F.col("p")).alias("p"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("f")))
    steps = steps.unionByName(got.where("s is not null").select(up(F.col("found")).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("f")))
    per = steps.groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("f").alias("f"))
    one = grid.join(per, "p", "left").fillna(0, ["a", "b", "f"])
    return temporal.running_total(one, "p", n_launched="a", n_pairs="b", n_found="f").select("year", "month", "n_launched", "n_pairs", "n_found")


@R.query("""
select company, product_name, arg_max(extract_id, (period, -extract_id)) as extract_id, max(period) as period from extracted_product_info_v2 where company is not null and product_name is not null and period is not null group by 1, 2
""")
def latest_period_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the latest period of every product, the first on ties."""
    one = table(spark, sf_dir, "extracted_product_info_v2").where("company is not null and product_name is not null and period is not null")
    got = windows.best_value(one, ["company", "product_name"], F.struct("extract_id", "period"), F.col("period"), -F.col("extract_id"))
    return got.select("company", "product_name", "value.extract_id", "value.period")


@R.query("""
select company_name, product_name, count(text_preview)::bigint as n_texts, coalesce(string_agg(text_preview, E'\\n\\n' order by snapshot_date, page_id), '') as context, coalesce(string_agg(distinct page_type, '; ' order by page_type), '') as page_types
from product_pages where company_name is not null and product_name is not null group by 1, 2
""")
def context_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a product in order of date, a blank line between, beside its page types."""
    one = _pages(spark, sf_dir).where("company_name is not null and product_name is not null")
    # a null date comes last in the order that checks this
    day = [F.col("snapshot_date").isNull(), F.col("snapshot_date"), F.col("page_id")]
    return one.groupBy("company_name", "product_name").agg(F.count("text_preview").alias("n_texts"), windows.ordered_concat(F.col("text_preview"), "\n\n", *day).alias("context"), windows.sorted_set(F.col("page_type")).alias("page_types"))


@R.query("""
with s as (select *, last_value(case when event_type = 'error' then user_id end ignore nulls) over (order by event_id) as last_error_user,
  last_value(case when event_type = 'purchase' then value end ignore nulls) over (order by event_id) as last_purchase from events)
select event_id, last_error_user, last_purchase from s
""")
def log_state_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the log with what was said last before it: the user of the last error and the last purchase.

    The log has no key, so it is carried by blocks of lines and then from block to block.
    """
    states = {"last_error_user": F.when(F.col("event_type") == "error", F.col("user_id")), "last_purchase": F.when(F.col("event_type") == "purchase", F.col("value"))}
    one = windows.carried_in_blocks(table(spark, sf_dir, "events"), "event_id", F.floor(F.col("event_id") / 4096), **states)
    return one.select("event_id", "last_error_user", "last_purchase")


@R.query("""
with s as (select event_type, user_id, lead(event_type) over (partition by user_id order by ts, event_id) as nxt, value from events)
select user_id, count(*) filter (where event_type = 'error')::bigint as n_errors, count(*) filter (where event_type = 'error' and nxt = 'error')::bigint as n_repeated,
  count(*) filter (where event_type = 'view' and value > 10)::bigint as n_long_views, round(coalesce(count(*) filter (where event_type = 'error') / nullif(count(*), 0), 0), 6) as error_share from s group by 1
""")
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every user's log, one of them looking at the line after, and a share that is 0 where nothing was logged."""
    one = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    error = F.col("event_type") == "error"
    got = one.withColumn("nxt", nxt).groupBy("user_id").agg(F.count_if(error).alias("n_errors"), F.count_if(error & (F.col("nxt") == "error")).alias("n_repeated"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 10)).alias("n_long_views"), F.count("*").alias("n"))
    return got.withColumn("error_share", F.round(F.coalesce(F.try_divide("n_errors", "n"), F.lit(0.0)), 6)).drop("n")


@R.query("select o_orderpriority, year(o_orderdate)::integer as year, quarter(o_orderdate)::integer as quarter, count(*)::bigint as n_orders, round(avg(o_totalprice), 4) as avg_price from orders group by all")
def calendar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and calendar quarter: periods of unequal length, as derived keys."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
