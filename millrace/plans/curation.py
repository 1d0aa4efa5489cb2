"""Queries of curation: rule tables over the product master, flags, lookups, rename chains, active years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import closure, generators, rules, windows
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
FLAGS = ["is_rebrand", "is_feature", "is_variant", "is_excluded", "is_non_us"]
PANEL_FIRST, PANEL_LAST = 2005, 2025
INFO = ["product_type", "interest_rate", "interest_rate_description", "fees", "bank_partner_specific", "bank_partner_broad", "baas_middleware_specific", "baas_middleware_broad", "key_features"]


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fintech_timelines_master")


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from, to, ordinal): every other word for a subcategory."""
    one = table(spark, sf_dir, "subcategory_list").select("product_subcategory", "subcategory_id", F.explode(F.split("also_called", ",")).alias("a"))
    return one.select(F.lower(F.trim("a")).alias("from"), F.col("product_subcategory").alias("to"), F.col("subcategory_id").alias("ordinal"))


ALIASES = """aliases as (
  select lower(trim(a)) as f, arg_max(product_subcategory, (subcategory_id, product_subcategory)) as t
  from (select product_subcategory, subcategory_id, unnest(string_split(also_called, ',')) as a from subcategory_list) group by 1
)"""


@R.query(f"""
with {ALIASES}
select row_id, coalesce(t, lower(trim(product_subcategory))) as subcategory
from fintech_timelines_master left join aliases on f = lower(trim(product_subcategory))
""")
def value_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategories in lower case, other words for an entry replaced by it, all others kept."""
    one = _master(spark, sf_dir).select("row_id", F.lower(F.trim("product_subcategory")).alias("subcategory"))
    return rules.remap(one, _aliases(spark, sf_dir), "subcategory")


@R.query("""
select row_id, l.product_category as category from fintech_timelines_master m
left join (select product_subcategory, arg_max(product_category, (subcategory_id, product_category)) as product_category from subcategory_list group by 1) l using (product_subcategory)
""")
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of each subcategory that is spelled as listed, null for all others."""
    listed = table(spark, sf_dir, "subcategory_list")
    one = _master(spark, sf_dir).select("row_id", F.col("product_subcategory").alias("category"))
    return rules.remap(one, listed, "category", "product_subcategory", "product_category", "subcategory_id", keep=False)


@R.query("""
with last as (
  select company, product_name, product_type from extracted_product_info_v2 where company is not null and product_name is not null
  qualify row_number() over (partition by company, product_name order by extract_id desc) = 1
)
select row_id, case when last.company is not null then last.product_type else m.product_subcategory end as product_subcategory
from fintech_timelines_master m left join last on last.company = m.company_name and last.product_name = m.product_name
""")
def rule_overwrite_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategory overwritten by the type last extracted for the product, a null type included."""
    found = table(spark, sf_dir, "extracted_product_info_v2").select(F.col("company").alias("company_name"), "product_name", F.col("product_type").alias("value"), F.col("extract_id").alias("ordinal"))
    one = rules.overwrite(_master(spark, sf_dir), found, ["company_name", "product_name"], "product_subcategory")
    return one.select("row_id", "product_subcategory")


@R.query("""
with pairs as (select distinct company_name, product_name from product_pages where company_name is not null and product_name is not null),
years as (select distinct company_name, product_name, year_launched from product_pages where company_name is not null and product_name is not null and year_launched is not null)
select row_id, p.company_name is not null as has_page, y.company_name is not null as has_page_of_year,
  coalesce(is_variant, false) or p.company_name is not null as is_variant
from fintech_timelines_master m left join pairs p using (company_name, product_name) left join years y using (company_name, product_name, year_launched)
""")
def curation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by rule lists of two and of three keys; a flag that is set stays set."""
    pages = table(spark, sf_dir, "product_pages").select("company_name", "product_name", "year_launched")
    one = _master(spark, sf_dir).select("row_id", "company_name", "product_name", "year_launched", "is_variant")
    for keys, name in ((["company_name", "product_name"], "has_page"), (["company_name", "product_name", "year_launched"], "has_page_of_year"), (["company_name", "product_name"], "is_variant")):
        one = rules.flag(one, pages, keys, name)
    return one.select("row_id", "has_page", "has_page_of_year", "is_variant")


@R.query("""
with bad as (select distinct company_name from fintech_timelines_master where is_excluded)
select extract_id, company, product_name from extracted_product_info_v2 where company is null or company not in (select company_name from bad where company_name is not null)
""")
def entity_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows of companies none of whose products is excluded; rows without company stay."""
    bad = _master(spark, sf_dir).where("is_excluded").select(F.col("company_name").alias("company"))
    return rules.minus(table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", "company", "product_name"), bad, ["company"])


@R.query(r"""
select row_id, company_name, product_name, try_cast(year_launched as double)::integer as year
from fintech_timelines_master
where entry_type = 'Product' and not coalesce(is_rebrand, false) and not coalesce(is_feature, false) and not coalesce(is_variant, false)
  and not coalesce(is_excluded, false) and not coalesce(is_non_us, false)
  and regexp_full_match(year_launched, '\s*\d+(\.\d*)?\s*') and try_cast(year_launched as double) >= 2005
  and not coalesce(regexp_full_match(product_name, '\d{4}'), false) and not coalesce(product_category in ('Extras', 'Protection'), false)
  and product_name is not null and trim(product_name) <> ''
""")
def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without any flag, launched from 2005 on, of no excluded category, with a name that is no bare year."""
    one = rules.without_flags(_master(spark, sf_dir).where("entry_type = 'Product'"), FLAGS)
    year = rules.number(F.col("year_launched"))
    one = one.where((year >= PANEL_FIRST) & ~F.coalesce(F.col("product_name").rlike(r"^\d{4}$"), F.lit(False)) & rules.not_in(F.col("product_category"), ["Extras", "Protection"]) & F.col("product_name").rlike(r"\S"))
    return one.select("row_id", "company_name", "product_name", year.cast("int").alias("year"))


@R.query(rf"""
with {ALIASES}, found as (
  select lower(trim(company)) as c, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')) as p, lower(trim(product_type)) as product_type
  from extracted_product_info_v2 where status = 'OK' and trim(product_type) <> '' and company is not null and product_name is not null
  qualify row_number() over (partition by c, p order by extract_id desc) = 1
), implied as (
  select c, p, product_type, t, product_category as cat from found left join aliases on f = product_type left join subcategory_list on product_subcategory = t
)
select row_id, case when t is not null and m.product_category = 'Deposits' and cat <> 'Deposits' then t
  when t is not null and m.product_category = 'Cards' and cat = 'Credit' then t
  when product_type like '%card%' and m.product_category = 'Credit' then case when lower(product_name) like '%business%' then 'Business Card' else 'Personal Card' end
  else m.product_subcategory end as product_subcategory
from fintech_timelines_master m left join implied on c = lower(trim(company_name)) and p = trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g'))
""")
def conflict_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subcategory replaced where the type extracted for the product is of another tier; three rules in order."""
    info = table(spark, sf_dir, "extracted_product_info_v2").where("status = 'OK'").where(F.trim("product_type") != "").where("company is not null and product_name is not null")
    found = windows.best_value(info.select(F.lower(F.trim("company")).alias("c"), text.normal(F.col("product_name")).alias("p"), F.lower(F.trim("product_type")).alias("kind"), "extract_id"), ["c", "p"], F.col("kind"), F.col("extract_id"))
    listed = table(spark, sf_dir, "subcategory_list").select(F.col("product_subcategory").alias("implied"), F.col("product_category").alias("cat"))
    implied = rules.last_rules(_aliases(spark, sf_dir), ["from"], "to", "ordinal").select(F.col("from").alias("kind"), F.col(rules.NEW).alias("implied"))
    one = found.withColumnRenamed("value", "kind").join(implied, "kind", "left").join(listed, "implied", "left")
    m = _master(spark, sf_dir).withColumn("c", F.lower(F.trim("company_name"))).withColumn("p", text.normal(F.col("product_name"))).join(one, ["c", "p"], "left")
    known = F.col("implied").isNotNull()
    new = rules.tier((known & (F.col("product_category") == "Deposits") & (F.col("cat") != "Deposits"), "implied"), (known & (F.col("product_category") == "Cards") & (F.col("cat") == "Credit"), "implied"), (F.contains("kind", F.lit("card")) & (F.col("product_category") == "Credit"), "card"))
    card = F.when(F.contains(F.lower("product_name"), F.lit("business")), "Business Card").otherwise("Personal Card")
    return m.select("row_id", F.when(new == "implied", F.col("implied")).when(new == "card", card).otherwise(F.col("product_subcategory")).alias("product_subcategory"))


@R.query("""
select row_id, case when product_subcategory ilike '%account%' or product_subcategory ilike '%deposit%' then 'Depository'
  when product_subcategory ilike '%transfer%' or product_subcategory ilike '%payment%' then 'Infrastructure'
  when product_category in ('Cards', 'Credit', 'Investing', 'Payments', 'Deposits') then 'Financial'
  when product_category in ('Extras', 'Protection') then 'Other' end as tier,
  coalesce(product_category in ('Cards', 'Credit'), false) or coalesce(product_broad_category = 'Financial', false) as is_financial
from fintech_timelines_master
""")
def tier_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each product by ordered rules, null where none holds, and a predicate over two sets."""
    sub, cat = F.lower("product_subcategory"), F.col("product_category")
    tier = rules.tier((text.contains_any(sub, ["account", "deposit"]), "Depository"), (text.contains_any(sub, ["transfer", "payment"]), "Infrastructure"), (cat.isin("Cards", "Credit", "Investing", "Payments", "Deposits"), "Financial"), (cat.isin("Extras", "Protection"), "Other"))
    financial = F.coalesce(cat.isin("Cards", "Credit"), F.lit(False)) | F.coalesce(F.col("product_broad_category") == "Financial", F.lit(False))
    return _master(spark, sf_dir).select("row_id", tier.alias("tier"), financial.alias("is_financial"))


@R.query(rf"""
select extract_id, ({' + '.join(rf"(case when regexp_matches({c}, '\S') then 1 else 0 end)" for c in INFO)})::integer as fields_populated, fields_populated > 0 as has_substance
from extracted_product_info_v2 where status = 'OK'
""")
def populated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of nine fields of each good row hold anything."""
    one = table(spark, sf_dir, "extracted_product_info_v2").where("status = 'OK'").select("extract_id", rules.populated(INFO).cast("int").alias("fields_populated"))
    return one.withColumn("has_substance", F.col("fields_populated") > 0)


@R.query("""
with sites as (select company_name, min_by(target_url, page_id) as u, min(page_id) as o from product_pages where company_name is not null and target_url is not null group by 1),
one as (select lower(trim(company_name)) as k, arg_min(u, o) as v from sites group by 1),
two as (select replace(lower(trim(company_name)), ' ', '') as k, arg_min(u, o) as v from sites group by 1)
select distinct company, coalesce(one.v, two.v) as website from extracted_product_info_v2
left join one on one.k = lower(trim(company)) left join two on two.k = replace(lower(trim(company)), ' ', '')
""")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site of each company as typed: by its name in lower case, else without blanks."""
    pages = table(spark, sf_dir, "product_pages").where("company_name is not null and target_url is not null")
    sites = pages.groupBy("company_name").agg(F.min_by("target_url", "page_id").alias("website"), F.min("page_id").alias("ordinal"))
    typed = table(spark, sf_dir, "extracted_product_info_v2").select("company").distinct()
    return rules.lookup_with_fallback(typed, sites, "company", "company_name", "website", "ordinal")


@R.query("""
with found as (select company_name, product_name, count(*) as n_pages, sum(text_length) as chars from product_pages where company_name is not null and product_name is not null group by 1, 2)
select row_id, n_pages, case when n_pages is null then 'no_snapshot' when chars is null or chars = 0 then 'fetch_failed' when chars < 1000 then 'too_short' else 'OK' end as status
from fintech_timelines_master m left join found using (company_name, product_name) where entry_type = 'Product'
""")
def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with a status, those without any page included."""
    pages = table(spark, sf_dir, "product_pages").where("company_name is not null and product_name is not null")
    found = pages.groupBy("company_name", "product_name").agg(F.count("*").alias("n_pages"), F.sum("text_length").alias("chars"))
    grid = _master(spark, sf_dir).where("entry_type = 'Product'").select("row_id", "company_name", "product_name")
    one = rules.with_status(grid, found, ["company_name", "product_name"], "status", "no_snapshot", {"fetch_failed": F.col("chars").isNull() | (F.col("chars") == 0), "too_short": F.col("chars") < 1000})
    return one.select("row_id", "n_pages", "status")


@R.query("""
with new as (select target_url, arg_max(page_title, page_id) filter (true) as t, max(page_id) as page_id from product_pages where target_url is not null group by 1),
latest as (select p.target_url, p.page_id, p.page_title from product_pages p join new using (page_id)),
old as (select target_url, arg_max(page_title, page_id) as page_title from product_pages where page_title is not null group by 1)
select latest.target_url, page_id, coalesce(latest.page_title, old.page_title) as page_title from latest left join old using (target_url)
""")
def combine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest load of each address, its title filled from the last load that had one."""
    pages = table(spark, sf_dir, "product_pages").where("target_url is not null")
    new = pages.groupBy("target_url").agg(F.max_by(F.struct("page_id", "page_title"), "page_id").alias("r")).select("target_url", "r.page_id", "r.page_title")
    old = pages.where("page_title is not null").groupBy("target_url").agg(F.max_by("page_title", "page_id").alias("page_title"))
    return rules.combine_first(new, old, ["target_url"], ["page_title"])


@R.query("""
select page_id, html_path from product_pages p where not exists (select 1 from extracted_product_info_v2 e where e.company = p.company_name and e.product_name = p.product_name)
""")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of products that no extraction has seen: what a restart has left to do."""
    done = table(spark, sf_dir, "extracted_product_info_v2").select(F.col("company").alias("company_name"), "product_name")
    return rules.minus(table(spark, sf_dir, "product_pages").select("page_id", "html_path", "company_name", "product_name"), done, ["company_name", "product_name"]).select("page_id", "html_path")


@R.query("""
select context_id, company, product_name from product_context c where exists (select 1 from fintech_timelines_master m where m.company_name = c.company)
""")
def semi_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of companies that the master has."""
    known = _master(spark, sf_dir).select(F.col("company_name").alias("company"))
    return rules.within(table(spark, sf_dir, "product_context").select("context_id", "company", "product_name"), known, ["company"])


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _master(spark, sf_dir).where("entry_type = 'Product'").select("company_name", "product_name")
    return a, table(spark, sf_dir, "product_pages").where("text_length > 0").select("company_name", "product_name")


PAIRS = "a as (select company_name, product_name from fintech_timelines_master where entry_type = 'Product'), b as (select company_name, product_name from product_pages where text_length > 0)"


@R.query(f"with {PAIRS} select * from a intersect select * from b")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that both the master and the pages have."""
    a, b = _pairs(spark, sf_dir)
    return a.intersect(b)


@R.query(f"with {PAIRS} select * from a except select * from b")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the master without a page."""
    a, b = _pairs(spark, sf_dir)
    return a.subtract(b)


@R.query(f"with {PAIRS} select * from a union select * from b")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that the master or the pages have."""
    a, b = _pairs(spark, sf_dir)
    return a.unionByName(b).distinct()


@R.query("""
with first as (select company_name, product_name, product_category, is_variant, is_excluded from fintech_timelines_master
  qualify row_number() over (partition by company_name, product_name order by row_id) = 1)
select extract_id, product_category, coalesce(is_variant, false) as is_variant, coalesce(is_excluded, false) as is_excluded
from extracted_product_info_v2 e left join first f on f.company_name = e.company and f.product_name = e.product_name
""")
def category_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted rows with category and flags of the first master row of their product; rows never multiply."""
    first = windows.keep_first(_master(spark, sf_dir).select("row_id", F.col("company_name").alias("company"), "product_name", "product_category", "is_variant", "is_excluded"), ["company", "product_name"], F.col("row_id"))
    one = table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", "company", "product_name").join(first.drop("row_id"), ["company", "product_name"], "left")
    return one.select("extract_id", "product_category", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_variant", "is_excluded")])


@R.query("""
select product_category, product_subcategory, count(*)::bigint as n, count(distinct company_name)::bigint as n_companies
from fintech_timelines_master group by all
""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each category occurs, nulls as a value of their own, most frequent first."""
    one = _master(spark, sf_dir).groupBy("product_category", "product_subcategory").agg(F.count("*").alias("n"), F.count_distinct("company_name").alias("n_companies"))
    return one.orderBy(F.desc("n"), F.lower("product_category").asc_nulls_last(), F.lower("product_subcategory").asc_nulls_last())


@R.query(r"""
with names as (select row_id, company_name as entity, product_name as name, regexp_replace(lower(trim(regexp_replace(product_name, '\(.*?\)', '', 'g'))), '\s+', ' ', 'g') as bare,
  lag(product_name) over (partition by company_name, product_category order by row_id) as before from fintech_timelines_master where entry_type = 'Product'),
hints as (select row_id, entity, before, name, regexp_replace(lower(trim(before)), '\s+', ' ', 'g') as hint from names where before is not null and entity is not null),
cand as (select b.row_id, n.name as other, row_number() over (partition by b.row_id order by n.row_id, n.name) as k
  from hints b join names n on n.entity = b.entity and (n.bare = hint or starts_with(n.bare, hint || ' ')
    or (string_split(n.bare, ' ')[1] = string_split(hint, ' ')[1] and contains(n.bare, hint))))
select row_id, other as predecessor from cand where k = 1
""")
def rename_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product that a hint '(rebrand from X)' means within its company; hints are put in from the product listed before."""
    own = _master(spark, sf_dir).where("entry_type = 'Product'").select("row_id", "company_name", "product_category", "product_name")
    before = F.lag("product_name").over(Window.partitionBy("company_name", "product_category").orderBy("row_id"))
    told = own.select(F.col("company_name").alias("entity"), F.col("row_id").alias("ordinal"), F.concat(F.col("product_name"), F.lit(" (rebrand from "), before, F.lit(")")).alias("name"))
    hints = told.withColumn("hint", text.hint(F.col("name"), "from")).where("hint is not null and entity is not null")
    names = own.select(F.col("company_name").alias("entity"), F.col("row_id").alias("ordinal"), F.col("product_name").alias("name"))
    return closure.first_fit(hints, names).select(F.col("ordinal").alias("row_id"), F.col("other").alias("predecessor"))


EDGES = """edges as (
  select company_name as entity, product_name as name, arg_max(nxt, (row_id, nxt)) as nxt from (
    select *, lead(product_name) over (partition by company_name, product_category order by row_id) as nxt
    from fintech_timelines_master where entry_type = 'Product' and company_name is not null and not coalesce(is_excluded, false))
  where product_name is not null and nxt is not null and nxt <> product_name group by all)"""


@R.query(f"""
with recursive {EDGES}, walk as (
  select entity, name, nxt as here, [name] as seen, false as done from edges
  union all
  select w.entity, w.name, e.nxt, list_append(w.seen, w.here), list_contains(w.seen, e.nxt) or e.nxt = w.here from walk w join edges e on e.entity = w.entity and e.name = w.here where not w.done and not list_contains(w.seen, w.here)
), ended as (select entity, name, arg_max(case when list_contains(seen, here) then here else here end, len(seen)) as root from walk group by all)
select entity, name, root as canonical from ended
""")
def recursive_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the rename chain of every product that has a successor; cycles end where they would first repeat."""
    own = _master(spark, sf_dir).where("entry_type = 'Product' and company_name is not null and not coalesce(is_excluded, false)")
    nxt = F.lead("product_name").over(Window.partitionBy("company_name", "product_category").orderBy("row_id"))
    edges = own.select(F.col("company_name").alias("entity"), F.col("product_name").alias("name"), nxt.alias("next"), F.col("row_id").alias("ordinal"))
    return closure.chain_ends(edges).select("entity", "name", F.col("root").alias("canonical"))


@R.query(r"""
with one as (select row_id, product_history_and_description || ' Formerly known as ' || canonical_name || ' Basic, now renamed.' as s from fintech_timelines_master where entry_type = 'Product')
select row_id, unnest(list_filter(list_transform(regexp_extract_all(s, '(?i)formerly (?:known as|called|named) ([^.(,;]+?)(?:\.|\(|,|;|\s+Rebranded|\s+in\s+\d)', 1), lambda x: trim(x)), lambda x: length(x) between 3 and 80)) as former
from one
""")
def former_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Former names told in descriptions; the sentence is put in, as no description here has one."""
    s = F.concat(F.col("product_history_and_description"), F.lit(" Formerly known as "), F.col("canonical_name"), F.lit(" Basic, now renamed."))
    return _master(spark, sf_dir).where("entry_type = 'Product'").select("row_id", F.explode(text.former_names(s)).alias("former"))


_END = " || ".join(rf"regexp_extract_all(product_history_and_description, '(?i){p}[^.]{{0,80}}?(\b(?:19|20)\d{{2}}\b)', 1)" for p in text.ENDINGS)


@R.query(f"""
select row_id, list_min(list_filter(list_transform({_END}, lambda y: y::integer), lambda y: y between 2000 and 2026)) as end_year
from fintech_timelines_master where entry_type = 'Product'
""")
def discontinuation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least year told after a word of ending, per product."""
    return _master(spark, sf_dir).where("entry_type = 'Product'").select("row_id", text.end_year(F.col("product_history_and_description")).alias("end_year"))


@R.query(rf"""
select row_id, company_name, product_name, canonical_name, unnest(range(greatest(trunc(try_cast(year_launched as double))::integer, {PANEL_FIRST}), least(coalesce(end_year::integer, {PANEL_LAST}), {PANEL_LAST}) + 1))::integer as year
from fintech_timelines_master
where entry_type = 'Product' and regexp_full_match(year_launched, '\s*\d+(\.\d*)?\s*')
  and not coalesce(is_rebrand, false) and not coalesce(is_feature, false) and not coalesce(is_variant, false) and not coalesce(is_excluded, false) and not coalesce(is_non_us, false)
""")
def active_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each product of the universe and year it was active."""
    one = rules.without_flags(_master(spark, sf_dir).where("entry_type = 'Product'"), FLAGS)
    one = one.withColumn("start", rules.number(F.col("year_launched")).cast("int")).where("start is not null")
    return generators.active_years(one, "start", "end_year", PANEL_FIRST, PANEL_LAST).select("row_id", "company_name", "product_name", "canonical_name", "year")
