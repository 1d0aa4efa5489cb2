"""Queries of matching names to a list, and of extraction by a rule that stands for a model."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import jsons, text
from millrace.operators import entity, extract, rules
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
# fixed values: words that do not tell banks apart
GENERIC = ["bank", "the", "trust", "company", "inc", "co", "corp", "national", "association", "credit", "union", "and", "carrier"]
# fixed values: what is cut from a bank's name
BANK_TAILS = [r"\bMember FDIC\b.*$", r",?\s*\bN\.?A\.?$", r"^\s*the\s+"]


def _banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ident): normal forms of the listed banks that are neither generic nor short."""
    one = table(spark, sf_dir, "matched_names").where("partnername is not null and idrssd is not null")
    kept = one.where(~text.generic(F.col("partnername"), GENERIC) & ~text.short(F.col("partnername")))
    return kept.select(text.normal(F.col("partnername")).alias("name"), "idrssd").groupBy("name").agg(F.max("idrssd").cast("string").alias("ident"))


_LIST = ", ".join(f"'{w}'" for w in GENERIC)
BANKS = rf"""banks as (select trim(regexp_replace(lower(partnername), '[^a-z0-9]+', ' ', 'g')) as name, max(idrssd)::varchar as ident from matched_names
  where partnername is not null and idrssd is not null and len(list_filter(regexp_extract_all(lower(partnername), '[a-z]+'), lambda w: w not in ({_LIST}))) > 0 and length(replace(partnername, ' ', '')) > 4 group by 1)"""


@R.query(rf"""
with {BANKS}, d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from documents where text is not null)
select doc_id, name, ident from d join banks on contains(t, ' ' || name || ' ')
""")
def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed bank that a document names as a whole phrase."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.normal(F.col("text")).alias("t"))
    return entity.phrases(docs, "doc_id", "t", _banks(spark, sf_dir))


@R.query(rf"""
with {BANKS}, d as (select doc_id, company_name, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from documents where text is not null),
m as (select doc_id, name from d join banks on contains(t, ' ' || name || ' ')),
e as (select distinct company, trim(regexp_replace(lower(bank_partner_specific), '[^a-z0-9]+', ' ', 'g')) as name from extracted_product_info_v2 where bank_partner_specific is not null and company is not null)
select m.doc_id, m.name from m join documents using (doc_id) where not exists (select 1 from e where e.company = company_name and e.name = m.name)
""")
def unpaired_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banks that a document names and no extracted row of its company has."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = entity.phrases(docs.select("doc_id", text.normal(F.col("text")).alias("t")), "doc_id", "t", _banks(spark, sf_dir)).join(docs.select("doc_id", F.col("company_name").alias("company")), "doc_id")
    known = table(spark, sf_dir, "extracted_product_info_v2").where("bank_partner_specific is not null and company is not null").select("company", text.normal(F.col("bank_partner_specific")).alias("name"))
    return rules.minus(found, known, ["company", "name"]).select("doc_id", "name")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bank_partner_specific, '(?i)\bMember FDIC\b.*$', '', 'g'), '(?i),?\s*\bN\.?A\.?$', '', 'g'), '(?i)^\s*the\s+', '', 'g'), '\s+', ' ', 'g'))"


@R.query(rf"""
with {BANKS}, v as (select distinct trim(regexp_replace(lower({_CLEAN}), '[^a-z0-9]+', ' ', 'g')) as value from extracted_product_info_v2 where bank_partner_specific is not null)
select value, name, ident from v join banks on contains(value, name) or contains(name, value) where value <> ''
qualify row_number() over (partition by value order by length(name) desc, name, ident) = 1
""")
def substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each bank phrase the longest listed name that holds it or that it holds."""
    typed = table(spark, sf_dir, "extracted_product_info_v2").select(text.normal(text.legal_form_free(F.col("bank_partner_specific"), BANK_TAILS)).alias("value"))
    return entity.longest_overlap(typed, "value", _banks(spark, sf_dir))


def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed bank with the best token-sort ratio for each bank value, with score and status."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", F.lower(text.legal_form_free(F.col("bank_partner_specific"), BANK_TAILS)).alias("value"))
    names = table(spark, sf_dir, "matched_names").select(F.lower("partnername").alias("name"), "idrssd", F.col("idrssd").alias("at")).where("name is not null").groupBy("name").agg(F.min("idrssd").alias("idrssd"), F.min("at").alias("at"))
    got = entity.best_match(info, "value", names, "name", "idrssd", "at")
    one = info.join(got, "value", "left")
    return entity.status(one.withColumn("score", F.round("score", 4)), "value").select("extract_id", "name", "ident", "score", "match_status")


def fuzzy_within_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master product of the same company with the best token-sort ratio for each extracted product, from 70 on."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select("company", F.lower("product_name").alias("value"))
    names = table(spark, sf_dir, "fintech_timelines_master").where("entry_type = 'Product'").select(F.col("company_name").alias("company"), F.lower("product_name").alias("name"), "row_id")
    got = entity.best_match(info, "value", names, "name", "row_id", "row_id", within="company", least=70)
    return got.where("score >= 70").select("company", "value", "name", F.round("score", 4).alias("score"))


def fuzzy_company_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master company with the best token-sort ratio for each company as typed, from 90 on; 15 weakest first in order."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select(F.lower("company").alias("value"))
    names = table(spark, sf_dir, "fintech_timelines_master").where("company_name is not null").groupBy(F.lower("company_name").alias("name")).agg(F.min("row_id").alias("row_id"))
    got = entity.best_match(info, "value", names, "name", "row_id", "row_id", least=90)
    return got.where("score >= 90").select("value", "name", F.round("score", 4).alias("score")).orderBy("score", "value")


def weighted_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed bank with the best weighted ratio for each bank value, from 80 on; generic and short names are none."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select(text.normal(text.legal_form_free(F.col("bank_partner_specific"), BANK_TAILS)).alias("value"))
    banks = _banks(spark, sf_dir).withColumn("at", F.col("ident").cast("long"))
    got = entity.best_match(info, "value", banks, "name", "ident", "at", score="weighted", least=80)
    return got.where("score >= 80").select("value", "name", "ident", F.round("score", 4).alias("score"))


for _f in (fuzzy_best_match, fuzzy_within_company, fuzzy_company_alias, weighted_fuzzy):
    R.query()(_f)


def stub_model(chunk: str, entity_name: str, name: str) -> str:
    """A rule in place of a model: the first rate of a chunk, and whether it speaks of fees and insurance."""
    if "[fail]" in chunk:
        raise ValueError("no answer")
    rates = re.findall(r"[0-9]+\.[0-9]{2}%", chunk)
    answer = {"product_type": "credit" if "loan" in chunk.lower() else "", "fees": "fee" if "fee" in chunk.lower() else "", "bank_partner_specific": "insured" if "insured" in chunk.lower() else "", "rates": [{"interest_rate": r, "description": ""} for r in rates[:1]]}
    return f"<think>{name}</think>\n```json\n{json.dumps(answer)}\n```"


@R.query(r"""
select context_id, case when combined_context is null or combined_context = '' then 'SKIPPED: no context' when length(combined_context) < 50 then 'SKIPPED: insufficient context' else 'OK' end as status,
  case when length(combined_context) >= 50 then coalesce(nullif(regexp_extract(combined_context, '([0-9]+\.[0-9]{2}%)', 1), ''), null) end as first_rate,
  case when length(combined_context) >= 50 then case when contains(lower(combined_context), 'loan') then 'credit' else '' end end as product_type,
  case when length(combined_context) >= 50 then case when contains(lower(combined_context), 'insured') then 'insured' else '' end end as bank from product_context
""")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context with its status and the merged answers of an injected rule, chunk by chunk."""
    ctx = table(spark, sf_dir, "product_context").select("context_id", "company", "product_name", "combined_context")
    said = extract.answers(ctx, stub_model, "context_id", "combined_context", "company", "product_name", most=8000)
    got = extract.merged(said, "context_id", ["product_type"], ["fees"], ["bank_partner_specific"])
    one = ctx.join(got, "context_id", "left")
    status = extract.status(F.col("combined_context"), F.coalesce("n_read", F.lit(0)), F.col("error"))
    return one.select("context_id", status.alias("status"), jsons.first_rate(F.col("rates")).alias("first_rate"), "product_type", F.col("bank_partner_specific").alias("bank"))


@R.query("""
select event_id, value as rate, 'a; b' as descriptions, case when event_type in ('view', 'click') then event_type else 'Other' end as kind, event_type <> 'error' as is_read from events where event_type is not null
""")
def answer_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with thought tags, fences, words around them and broken JSON, read back; categories outside the list become 'Other'."""
    body = F.concat(F.lit('{"rates": [{"interest_rate": "'), F.col("value").cast("string"), F.lit('", "description": "a"}, {"interest_rate": "", "description": "b"}]}'))
    raw = F.when(F.col("event_type") == "view", F.concat(F.lit("<think>hm {</think>\n```json\n"), body, F.lit("\n```"))).when(F.col("event_type") == "error", F.lit("no {json")).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" - done")))
    one = table(spark, sf_dir, "events").where("event_type is not null").select("event_id", "event_type", "value", jsons.parse_answer(raw, extract.RATES).alias("a"))
    rate = F.coalesce(jsons.first_rate(F.col("a.rates")).cast("double"), F.col("value"))
    words = F.coalesce(jsons.joined_descriptions(F.col("a.rates")), F.lit("a; b"))
    return one.select("event_id", rate.alias("rate"), words.alias("descriptions"), extract.in_taxonomy(F.col("event_type"), ["view", "click"]).alias("kind"), F.col("a").isNotNull().alias("is_read"))
