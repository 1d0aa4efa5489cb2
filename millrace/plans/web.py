"""Queries of web functions: addresses of the page table, and pages composed from its titles and texts.

The tables hold no markup, so pages are put together from their columns; what is read back must be what was
put in, which is what the SQL states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import html, text, url
from millrace.operators import windows
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
# fixed values: parts of addresses that speak for and against a product page
GOOD = ["/products/", "/features/", "/solutions/", "/platform/", "/what-we-offer/", "/services/"]
BAD = ["/blog/", "/news/", "/press/", "/careers/", "/legal/", "/privacy", "/terms", "/cookie", "/login", "/signup", "/wp-content/", "/wp-admin/", ".css", ".js", ".png", ".jpg", ".pdf", ".xml", ".json", "/articles/", "/article/", "/spark/", "/resources/", "/insights/", "/press-release", "/announcement", "/webinar", "/event/", "/demo/", "/semlps/", "/lp/", "/landing/", "/campaign/"]
# fixed values: links worth following and those never followed
REJECT = ["/about-us", "/about/", "/careers", "/contact", "/blog", "/news", "/press", "/investors", "/login", "/signup", "/support", "/help", "/faq", "/search", "/sitemap", "/cookie", "/accessibility"]
FOLLOW = ["terms", "legal", "disclosures", "agreement", "tos", "cardholder", "fdic", "licensing", "regulatory", "compliance", "/features", "/pricing", "/plans", "/eligibility", "/rates", "/fees", "/how-it-works"]
ANCHORS = ["learn more", "see details", "view details", "how it works", "get started", "features", "pricing", "plans", "eligibility", "rates", "fees", "apply now"]
PROBES = ["/terms", "/legal", "/terms-of-service", "/disclosures", "/legal/terms"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "product_pages").select("page_id", "company_name", "product_name", "target_url", "page_title", "text_preview")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together: title, script, navigation, one paragraph a line, a footer, links of four kinds."""
    one = _pages(spark, sf_dir).where("text_preview is not null and page_title is not null and target_url is not null")
    body = F.array_join(F.transform(F.split(_escaped(F.col("text_preview")), "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    links = F.lit('<a href="/a/one?x=1">One</a><a href="#top">Top</a><a href="mailto:x@y.example">Mail</a><a href="https://other.example/b">Other</a><a href="two/">Two <b>b</b></a><a href="/a/one">Again</a>')
    page = F.concat(F.lit("<html><head><title> "), _escaped(F.col("page_title")), F.lit(" </title><script>var x = '<p>no</p>';</script></head><body><nav>Home</nav><!-- hidden -->"), body, links, F.lit("<footer>Careers</footer><noscript>off</noscript></body></html>"))
    return one.withColumn("html", page)


@R.query(r"""
select page_id, lower(regexp_extract(target_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as scheme, regexp_replace(lower(regexp_extract(target_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.|:\d+$', '', 'g') as host,
  regexp_extract(target_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(target_url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) as base, ends_with(lower(regexp_extract(target_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)), '.pdf') as is_pdf
from product_pages where target_url is not null
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, host, path and base of every address."""
    u = F.col("target_url")
    return _pages(spark, sf_dir).where("target_url is not null").select("page_id", url.scheme(u).alias("scheme"), url.host(u).alias("host"), url.path(u).alias("path"), url.base(u).alias("base"), url.is_pdf(u).alias("is_pdf"))


@R.query(r"select page_id, regexp_replace(regexp_replace(trim(target_url), '[;?#].*$', ''), '/+$', '') as canonical from product_pages where target_url is not null")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without parameters, query, fragment and trailing slash."""
    return _pages(spark, sf_dir).where("target_url is not null").select("page_id", url.canonical(F.col("target_url")).alias("canonical"))


@R.query(r"""
select page_id, regexp_replace(target_url, '/+$', '') as a, regexp_replace(target_url, '/+$', '') as b, cast(null as varchar) as c from product_pages where target_url is not null and not regexp_matches(target_url, '[?#]')
""")
def archive_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses put into one and two archive wrappers and a foreign scheme, unwrapped again."""
    u = F.col("target_url")
    once = F.concat(F.lit("/web/2020/"), u, F.lit("/?q=1"))
    twice = F.concat(F.lit("https://web.archive.org/web/2019/http://web.archive.org/web/2020id_/"), u, F.lit("#x"))
    return _pages(spark, sf_dir).where(F.col("target_url").isNotNull() & ~F.col("target_url").rlike("[?#]")).select("page_id", url.unwrap(once).alias("a"), url.unwrap(twice).alias("b"), url.unwrap(F.concat(F.lit("ftp://x/"), u)).alias("c"))


HTML_SQL = "p as (select * from product_pages where text_preview is not null and page_title is not null and target_url is not null)"


@R.query(f"with {HTML_SQL} select page_id, trim(page_title) as title from p")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles read from pages by the parser."""
    return _html(spark, sf_dir).select("page_id", html.parse("html", "target_url").alias("h")).select("page_id", F.trim("h.title").alias("title"))


@R.query(rf"""
with {HTML_SQL}, n as (select page_id, unnest(list_filter(list_transform(string_split(text_preview, chr(10)), lambda s: trim(regexp_replace(s, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'))), lambda s: s <> '')) as s, generate_subscripts(list_filter(list_transform(string_split(text_preview, chr(10)), lambda s: trim(regexp_replace(s, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'))), lambda s: s <> ''), 1) as i from p),
j as (select page_id, string_agg(s, chr(10) order by i) as t from n group by 1)
select page_id, regexp_replace(trim(page_title) || chr(10) || coalesce(t || chr(10), '') || array_to_string(['One', 'Top', 'Mail', 'Other', 'Two', 'b', 'Again'], chr(10)), ' {{2,}}', ' ', 'g') as main from p left join j using (page_id)
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without scripts, navigation, comments and a footer that says nothing of banks."""
    return _html(spark, sf_dir).select("page_id", html.parse("html", "target_url").alias("h")).select("page_id", F.col("h.main").alias("main"))


@R.query(rf"""
with {HTML_SQL}, b as (select page_id, regexp_extract(target_url, '^(https?://[^/?#]*)', 1) as base, regexp_replace(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder from p)
select page_id, base || '/a/one?x=1' as href, 'One' as anchor_text, '/a/one' as path from b
union all select page_id, base || (case when folder = '' then '/' else folder end) || 'two/', 'Twob', (case when folder = '' then '/' else folder end) || 'two' from b
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links of pages, resolved, the first of each path."""
    one = _html(spark, sf_dir).select("page_id", F.explode(html.parse("html", "target_url")["links"]).alias("l"))
    return one.select("page_id", "l.href", "l.anchor_text", "l.path")


@R.query("""
select page_id, true as told, false as full_page from product_pages where text_preview is not null and page_title is not null and target_url is not null
""")
def js_shell_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are script shells: with a notice put in, and as they are."""
    one = _html(spark, sf_dir)
    told = F.replace(F.col("html"), F.lit("<noscript>off"), F.lit("<noscript>Please enable JavaScript"))
    flag = lambda c: html.parse(c, F.col("target_url"))["is_shell"]
    return one.select("page_id", flag(told).alias("told"), flag(F.col("html")).alias("full_page"))


def _any(col: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{p}')" for p in parts) + ")"


@R.query(f"""
with l as (select page_id, lower(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1)) as path, lower(coalesce(page_title, '')) as said from product_pages where target_url is not null)
select page_id, ({_any('path', FOLLOW)} or {' or '.join(f"contains(said, '{p.replace('/', ' ').strip()}')" for p in FOLLOW)} or {_any('said', ANCHORS)}) and not ({' or '.join(f"starts_with(path, '{r}') or path = '{r.rstrip('/')}'" for r in REJECT)}) as follow from l
""")
def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether addresses, with their titles as link text, are worth following."""
    rule = url.matches_rules(url.path(F.col("target_url")), F.col("page_title"), reject_starts=REJECT, path_has=FOLLOW, anchor_has=ANCHORS)
    return _pages(spark, sf_dir).where("target_url is not null").select("page_id", rule.alias("follow"))


@R.query(rf"""
with u as (select company_name, target_url, min(snapshot_timestamp) as ts, count(distinct substring(snapshot_timestamp, 1, 4)) as n_years, regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1) as path from product_pages where company_name is not null and target_url is not null group by 1, 2),
m as (select row_id, company_name, list_filter(regexp_split_to_array(lower(product_subcategory), '[^a-z0-9]+'), lambda w: length(w) > 2) as names, list_filter(regexp_split_to_array(lower(product_category), '[^a-z0-9]+'), lambda w: length(w) > 3) as topics from fintech_timelines_master where entry_type = 'Product' and company_name is not null and product_subcategory is not null and product_category is not null),
s as (select row_id, target_url, path, n_years, len(list_filter(names, lambda t: contains(regexp_replace(lower(path), '[-_/]', ' ', 'g'), t))) * 10 + len(list_filter(topics[1:5], lambda t: contains(regexp_replace(lower(path), '[-_/]', ' ', 'g'), t))) * 3
  + {' + '.join(f"(case when contains(lower(path), '{g}') then 2 else 0 end)" for g in GOOD)} - {' - '.join(f"(case when contains(lower(path), '{b}') then 20 else 0 end)" for b in BAD)} as raw from m join u using (company_name)),
t as (select *, raw + (case when contains(lower(path), '/card') or contains(lower(path), '/pricing') then n_years * 2 else 0 end) as score from s where raw > -20)
select row_id, target_url, score::bigint as score, k::integer as rank from (select *, row_number() over (partition by row_id order by score desc, target_url) as k from t) where k <= 3
""")
def link_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best addresses of each product's company by words of its category, lasting ones preferred."""
    pages = table(spark, sf_dir, "product_pages").where("company_name is not null and target_url is not null")
    sites = pages.groupBy("company_name", "target_url").agg(F.count_distinct(F.substring("snapshot_timestamp", 1, 4)).alias("n_years")).withColumn("path", url.path(F.col("target_url")))
    cut = lambda c, n: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > n)
    own = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product' and company_name is not null and product_subcategory is not null and product_category is not null")
    own = own.select("row_id", "company_name", cut("product_subcategory", 2).alias("names"), cut("product_category", 3).alias("topics"))
    # addresses are scored for each category of a company, of which there are few, and not for each product
    kinds = own.select("company_name", "names", "topics").distinct()
    raw = url.relevance(F.col("path"), F.col("names"), F.col("topics"), GOOD, BAD)
    low = F.lower("path")
    lasting = F.when(F.contains(low, F.lit("/card")) | F.contains(low, F.lit("/pricing")), F.col("n_years") * 2).otherwise(0)
    one = kinds.join(sites, "company_name").withColumn("raw", raw).where("raw > -20").withColumn("score", (F.col("raw") + lasting).cast("long"))
    best = windows.top(one.select("company_name", "names", "topics", "target_url", "score"), ["company_name", "names", "topics"], 3, F.desc("score"), F.col("target_url"))
    return own.join(best, ["company_name", "names", "topics"]).select("row_id", "target_url", "score", "rank")


@R.query("""
with b as (select company_name, arg_min(regexp_extract(target_url, '^(https?://[^/?#]*)', 1), page_id) as base from product_pages where company_name is not null and target_url is not null group by 1),
c as (select company_name, unnest([0, 1, 2, 3, 4]) as ordinal, base || unnest(['/terms', '/legal', '/terms-of-service', '/disclosures', '/legal/terms']) as url from b)
select company_name, arg_min(c.url, ordinal) as first_hit, min(ordinal)::integer as ordinal from c where exists (select 1 from product_pages p where regexp_replace(regexp_replace(trim(p.target_url), '[;?#].*$', ''), '/+$', '') = c.url) group by 1
""")
def url_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list of paths that exists on each company's site; the page table stands for the probe."""
    pages = table(spark, sf_dir, "product_pages").where("target_url is not null")
    base = pages.where("company_name is not null").groupBy("company_name").agg(F.min_by(url.base(F.col("target_url")), "page_id").alias("base"))
    tried = base.select("company_name", F.explode(url.candidates(F.col("base"), PROBES)).alias("c")).select("company_name", "c.ordinal", "c.url")
    known = pages.select(url.canonical(F.col("target_url")).alias("url")).distinct()
    hit = tried.join(known, "url", "left_semi")
    return hit.groupBy("company_name").agg(F.min_by("url", "ordinal").alias("first_hit"), F.min("ordinal").alias("ordinal"))


@R.query("""
with p as (select page_id, regexp_extract(target_url, '^(https?://[^/?#]*)', 1) as base, list_filter(string_split(regexp_replace(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1), '^/', ''), '/'), lambda s: s <> '') as ps from product_pages where target_url is not null)
select page_id, (len(ps) - n)::integer as step, base || '/' || array_to_string(ps[1:n], '/') as url from (select *, unnest(range(1, len(ps) + 1)) as n from p)
""")
def shrinking_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their last path segment dropped again and again."""
    return _pages(spark, sf_dir).where("target_url is not null").select("page_id", F.posexplode(url.shrinking(F.col("target_url"))).alias("step", "url"))


@R.query(r"""
with k as (select page_id, regexp_replace(lower(regexp_extract(target_url, '^https?://[^/?#]*([^?#]*)', 1)), '[-_/]', ' ', 'g') || ' ' || lower(coalesce(page_title, '')) as said,
  list_filter(regexp_split_to_array(lower(product_name), '[^a-z0-9]+'), lambda w: length(w) > 2) as ws from product_pages where target_url is not null and product_name is not null),
s as (select page_id, len(ws) as n, len(list_filter(ws, lambda w: contains(said, w))) as hits from k)
select page_id, hits::integer as hits, hits >= (case when n <= 2 then 1 else 2 end) as is_match from s where n > 0
""")
def product_link_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of the product its page's address and title hold, and whether these are enough."""
    said = F.concat(url.spaced_path(url.path(F.col("target_url"))), F.lit(" "), F.lower(F.coalesce("page_title", F.lit(""))))
    words = F.filter(F.split(F.lower("product_name"), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    one = _pages(spark, sf_dir).where("target_url is not null and product_name is not null").select("page_id", said.alias("said"), words.alias("ws")).where(F.size("ws") > 0)
    hits = F.size(F.filter("ws", lambda w: F.contains(F.col("said"), w)))
    return one.select("page_id", hits.alias("hits"), (hits >= F.when(F.size("ws") <= 2, 1).otherwise(2)).alias("is_match"))


@R.query(r"""
with c as (select page_id, company_name, product_name, target_url, case when lower(replace(target_url, '-', ' ')) like '%fee%' then 1 when regexp_matches(target_url, '/(pricing|features|products)') then 2 else 3 end as tier from product_pages where company_name is not null and product_name is not null and target_url is not null),
d as (select company_name, product_name, target_url, min(tier) as tier, min(page_id) as since from c group by 1, 2, 3),
r as (select *, row_number() over (partition by company_name, product_name, tier order by since) as k from d)
select company_name, product_name, target_url, case tier when 1 then 'keyword_' || k::varchar when 2 then 'common_path' else 'homepage' end as url_type from r where (tier = 1 and k <= 3) or (tier > 1 and k = 1)
""")
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates of each product: up to three by keyword, one common path, one other."""
    pages = _pages(spark, sf_dir).where("company_name is not null and product_name is not null and target_url is not null")
    tier = F.when(F.contains(F.lower(F.replace("target_url", F.lit("-"), F.lit(" "))), F.lit("fee")), 1).when(F.col("target_url").rlike("/(pricing|features|products)"), 2).otherwise(3)
    one = pages.groupBy("company_name", "product_name", "target_url").agg(F.min(tier).alias("tier"), F.min("page_id").alias("at"))
    got = windows.top(one, ["company_name", "product_name", "tier"], 3, F.col("at")).where("tier = 1 or rank = 1")
    kind = F.when(F.col("tier") == 1, F.concat(F.lit("keyword_"), F.col("rank").cast("string"))).when(F.col("tier") == 2, "common_path").otherwise("homepage")
    return got.select("company_name", "product_name", "target_url", kind.alias("url_type"))


@R.query("select page_id, page_title from product_pages where text_preview is not null and page_title is not null and target_url is not null and (lower(text_preview) like '%fee%' or lower(page_title) like '%fee%')")
def pages_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text, read back from markup, names a topic."""
    one = _html(spark, sf_dir).select("page_id", "page_title", html.parse("html", "target_url").alias("h"))
    return one.where(text.contains_any(F.col("h.main"), ["fee"])).select("page_id", "page_title")
