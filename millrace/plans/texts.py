"""Queries of text functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, jsons, text
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
TOPICS = ["fee", "rate", "deposit", "insured", "issued by", "fdic", "transfer"]
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"


def _keywords(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '[^a-zA-Z0-9 ]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')), ' +'), lambda w: length(w) > 2 and not list_contains({_STOP}, w))"


def _sentences(c: str, more: str = "") -> str:
    """Sentences in SQL, which has no look-behind: ends are marked, then cut."""
    return rf"regexp_split_to_array(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1){more})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "company_name")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "product_context").select("context_id", "product_name", "combined_context")


@R.query(rf"""
select row_id, trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g')) as normal, regexp_replace(lower(trim(regexp_replace(product_name, '\(.*?\)', '', 'g'))), '\s+', ' ', 'g') as bare,
  substring(regexp_replace(company_name, '[^A-Za-z0-9_\-.]', '_', 'g'), 1, 80) as slug, length(product_name)::integer as n_chars, array_to_string({_keywords('product_name')}, ' ') as keywords,
  trim(regexp_replace(regexp_replace(regexp_replace(company_name, '(?i),?\s*\binc\b\.?', '', 'g'), '(?i)\s+(ltd|llc|corp)\b\.?', '', 'g'), '\s+', ' ', 'g')) as company
from fintech_timelines_master where product_name is not null
""")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of product and company names."""
    n, c = F.col("product_name"), F.col("company_name")
    return table(spark, sf_dir, "fintech_timelines_master").where("product_name is not null").select(
        "row_id", text.normal(n).alias("normal"), text.bare_name(n).alias("bare"), text.slug(c).alias("slug"), F.length(n).alias("n_chars"), F.array_join(text.keywords(n), " ").alias("keywords"),
        text.legal_form_free(c, [r",?\s*\binc\b\.?", r"\s+(ltd|llc|corp)\b\.?"]).alias("company"),
    )


@R.query(r"""
with t as (select row_id, list_filter(regexp_split_to_array(lower(company_name), '\s+'), lambda w: length(w) > 2) as gone, lower(product_name) as p from fintech_timelines_master where product_name is not null),
u as (select row_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(coalesce(list_reduce(list_prepend(p, gone), lambda a, w: replace(a, w, '')), p), '\([^)]*\)', '', 'g'), '[^a-z0-9\s]', '', 'g')), '\s+'), lambda w: length(w) > 2) as toks from t)
select row_id, array_to_string(toks, ' ') as tokens, array_to_string(list_transform(toks, lambda w: regexp_replace(regexp_replace(regexp_replace(w, '^(.{3,}?)(?:ings|ing|tion|sion|ment|ness|able|ible|ous|ive|ers|er|es|s)$', '\1'), '^(.{3,}?)(?:ings|ing|tion|sion|ment|ness|able|ible|ous|ive|ers|er|es|s)$', '\1'), '^(.{3,})e$', '\1')), ' ') as stems from u
""")
def name_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of product names without those of the company, and their stems."""
    toks = text.name_tokens(F.col("product_name"), F.col("company_name"))
    return table(spark, sf_dir, "fintech_timelines_master").where("product_name is not null").select("row_id", F.array_join(toks, " ").alias("tokens"), F.array_join(F.transform(toks, text.stem), " ").alias("stems"))


@R.query(rf"""
with s as (select doc_id, unnest(list_filter(list_transform({_sentences('text', " || '|' || chr(10) || chr(10) || '+'")}, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')) as sent, generate_subscripts(list_filter(list_transform({_sentences('text', " || '|' || chr(10) || chr(10) || '+'")}, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> ''), 1) as i from documents where text is not null),
f as (select doc_id, arg_min(sent, i) as sent, min(i) as i from s group by doc_id, regexp_replace(sent, '\s+', ' ', 'g'))
select d.doc_id, coalesce(string_agg(sent, ' ' order by i), '') as text from documents d left join f using (doc_id) where d.text is not null group by 1
""")
def sentence_split_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with repeated sentences dropped, first spellings kept."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.unique_sentences(F.col("text")).alias("text"))


@R.query(rf"""
with k as (select context_id, combined_context as t, {_keywords('product_name')} as ws, regexp_replace(lower(combined_context), '[^a-z0-9 ]', ' ', 'g') as low from product_context)
select context_id, round(case when len(ws) = 0 then 1.0 else len(list_filter(ws, lambda w: contains(low, w))) / len(ws) end, 6) as share from k where t is not null and ws is not null
""")
def mention_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a product's key words that its context holds."""
    one = _context(spark, sf_dir).where("combined_context is not null and product_name is not null")
    return one.select("context_id", F.round(text.mention_share(F.col("combined_context"), text.keywords(F.col("product_name"))), 6).alias("share"))


_PARAS = r"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n|\n'), lambda p: regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '')), lambda p: length(p) >= 10)"
_HIT = "(" + " or ".join(f"contains(lower(p), '{t}')" for t in TOPICS) + ")"


@R.query(rf"""
with p as (select doc_id, text, list_filter({_PARAS}, lambda p: {_HIT}) as kept from documents where text is not null)
select doc_id, case when length(text) <= 2000 then text when len(kept) > 0 then array_to_string(kept, E'\n\n') else left(text, 2000) || E'\n[...]\n' || right(text, 2000) end as focus from p
""")
def keyword_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts as they are, of long ones the paragraphs on a topic."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.focus(F.col("text"), F.array(*[F.lit(t) for t in TOPICS])).alias("focus"))


@R.query(rf"""
with s as (select doc_id, {_sentences('text')} as ss from documents where text is not null),
h as (select doc_id, ss, list_transform(ss, lambda p: {_HIT}) as hs from s)
select doc_id, array_to_string(list_filter(ss, lambda x, i: coalesce(hs[i - 1] and i > 1, false) or hs[i] or coalesce(hs[i + 1], false)), ' ') as kept from h
""")
def sentence_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on a topic with their neighbours."""
    kept = text.with_neighbours(text.sentences(F.col("text")), lambda s: text.contains_any(s, TOPICS))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.array_join(kept, " ").alias("kept"))


@R.query(rf"""
with recursive s as (select doc_id, text, {_sentences('text')} as ss from documents where text is not null and length(text) > 600),
w as (select doc_id, ss, 2 as i, ss[1] as cur, 0 as chunk, cast(null as varchar) as done from s
  union all
  select doc_id, ss, i + 1, case when i > len(ss) then null when cur <> '' and length(cur) + length(ss[i]) + 1 > 600 then ss[i] when cur <> '' then cur || ' ' || ss[i] else ss[i] end,
    chunk + (case when cur <> '' and (i > len(ss) or length(cur) + length(ss[i]) + 1 > 600) then 1 else 0 end), case when cur <> '' and (i > len(ss) or length(cur) + length(ss[i]) + 1 > 600) then cur end
  from w where i <= len(ss) + 1)
select doc_id, (chunk - 1)::integer as chunk_no, done as chunk from w where done is not null
union all select doc_id, 0, text from documents where length(text) <= 600
""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in chunks of whole sentences of up to 600 characters."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"), 600)).alias("chunk_no", "chunk"))


@R.query(rf"""
with m as (select doc_id, unnest(regexp_extract_all(text, '{text.PAIR.replace("(?=", "(?:")}', 0)) as m from documents),
g as (select distinct doc_id, trim(regexp_extract(m, '(?i)([A-Z][^.]{{0,80}}?)\s+(?:is|are)\s+(?:held\s+with|issued\s+by|backed\s+by|provided\s+by)\s+([^,.]+)', 1)) as product, trim(regexp_extract(m, '(?i)(?:is|are)\s+(?:held\s+with|issued\s+by|backed\s+by|provided\s+by)\s+([^,.)]+)', 1)) as bank from m)
select doc_id, bank, count(*)::bigint as n from g group by 1, 2
""")
def issuer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks that texts name as the one behind a product, with how many products."""
    one = _docs(spark, sf_dir).select("doc_id", F.explode(text.issuer_pairs(F.col("text"))).alias("p")).select("doc_id", "p.product", F.regexp_extract("p.bank", r"^([^)]*)", 1).alias("bank")).distinct()
    return one.groupBy("doc_id", "bank").agg(F.count("*").alias("n"))


@R.query(r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), ' {2,}', ' ', 'g'), '^\s+', ''), '\s+$', '') as tidy,
  regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '^\s+', ''), '\s+$', '') as one_line, len(list_filter(regexp_split_to_array(text, '\n\s*\n|\n'), lambda p: length(regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '')) >= 10))::integer as n_paragraphs
from documents where text is not null
""")
def whitespace_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts tidied and as one line, with the number of their paragraphs."""
    t = F.col("text")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.tidy(t).alias("tidy"), text.one_line(t).alias("one_line"), F.size(text.paragraphs(t)).alias("n_paragraphs"))


@R.query("""
select event_id, (props->>'$.k')::bigint as k, to_json({'k': (props->>'$.k')::bigint, 'type': event_type})::varchar as packed from events
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties read and written again."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type")), {"ignoreNullFields": "false"}).alias("packed"))


@R.query(r"""
with p as (select target_url, '[' || string_agg('''' || snapshot_timestamp || '''', ', ' order by snapshot_timestamp, page_id) || ', bad, 123]' as cell from product_pages where target_url is not null and snapshot_timestamp is not null group by 1),
l as (select target_url, list_filter(regexp_extract_all(cell, '\d+'), lambda t: length(t) = 14) as ts from p)
select target_url, len(ts)::integer as n, ts[1] as first, ts[len(ts)] as last from l
""")
def timestamp_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp lists packed into one cell, read back; what has not 14 digits is none."""
    one = table(spark, sf_dir, "product_pages").where("target_url is not null and snapshot_timestamp is not null")
    quoted = F.transform(F.array_sort(F.collect_list(F.struct("snapshot_timestamp", "page_id"))), lambda x: F.concat(F.lit("'"), x["snapshot_timestamp"], F.lit("'")))
    cells = one.groupBy("target_url").agg(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit(", bad, 123]")).alias("cell"))
    ts = jsons.timestamp_list(F.col("cell"))
    return cells.select("target_url", F.size(ts).alias("n"), F.get(ts, F.lit(0)).alias("first"), F.element_at(ts, -1).alias("last"))


PAGE_TYPES = ["product_page", "sublink", "terms", "deep_terms", "homepage", "disclosure", "keyword_1"]


@R.query(rf"""
with b as (select page_id, html_path, replace(regexp_extract(html_path, '([^/]*)/[^/]*$', 1), '_', ' ') as entity, string_split(regexp_replace(regexp_extract(html_path, '([^/]*)$', 1), '\.[A-Za-z0-9]+$', ''), '__') as ps from product_pages where html_path is not null),
a as (select *, list_position(list_transform(ps, lambda p: list_contains({PAGE_TYPES}, regexp_replace(regexp_replace(trim(p), '^_+', ''), '_+$', ''))), true) as pos from b)
select page_id, entity, array_to_string(list_filter(list_transform(case when pos > 0 then ps[1:pos - 1] else ps[1:1] end, lambda p: trim(replace(p, '_', ' '))), lambda p: p <> ''), ' ') as name,
  case when pos > 0 then regexp_replace(regexp_replace(trim(ps[pos]), '^_+', ''), '_+$', '') else 'unknown' end as page_type, nullif(regexp_extract(array_to_string(ps, '__'), '(\d{{14}})$', 1), '') as ts,
  case when regexp_matches(array_to_string(ps, '__'), '\d{{14}}$') then try_strptime(substring(regexp_extract(array_to_string(ps, '__'), '(\d{{14}})$', 1), 1, 8), '%Y%m%d')::date end as day from a
""")
def file_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity, name, page type and timestamp that file names tell."""
    one = table(spark, sf_dir, "product_pages").where("html_path is not null").select("page_id", jsons.file_parts(F.col("html_path"), PAGE_TYPES).alias("f"))
    return one.select("page_id", "f.entity", "f.name", "f.page_type", F.col("f.timestamp").alias("ts"), dates.snapshot_date(F.col("f.timestamp")).alias("day"))


@R.query("""
select page_id, year(d)::varchar || (case when month(d) <= 6 then '-H1' else '-H2' end) as period, strftime(d, '%m%d%y') as code, year(d)::varchar || ' Q' || quarter(d)::varchar as label, (target_year * 12 + target_month)::integer as month_index,
  date_diff('day', make_date(target_year, target_month, 1), d)::integer as days_off from (select *, try_cast(snapshot_date as date) as d from product_pages where snapshot_date is not null)
""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-year, quarter code, label, month index and distance to the target of every snapshot."""
    d = F.try_to_date("snapshot_date", "yyyy-MM-dd")
    return table(spark, sf_dir, "product_pages").where("snapshot_date is not null").select(
        "page_id", dates.half_year(d).alias("period"), dates.quarter_code(d).alias("code"), dates.quarter_label(d).alias("label"), dates.month_index(F.col("target_year"), F.col("target_month")).alias("month_index"), F.datediff(d, F.make_date("target_year", "target_month", F.lit(1))).alias("days_off")
    )
