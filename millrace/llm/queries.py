"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boilerplate, canon, encode, mixing, names, pii, residue
from millrace.operators import packed
from millrace.plans import cleaning
from millrace.session import cut, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line outside the body, of texts with line breaks."""
    pages = boilerplate.outside_lines(table(spark, sf_dir, "product_pages"), "page_id", "text_preview", "product_pages")
    return pages.unionByName(boilerplate.outside_lines(table(spark, sf_dir, "product_context"), "context_id", "combined_context", "product_context"))


def p2_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every text, flattened ones included."""
    pages = boilerplate.bodies(table(spark, sf_dir, "product_pages"), "page_id", "text_preview", "product_pages")
    return pages.unionByName(boilerplate.bodies(table(spark, sf_dir, "product_context"), "context_id", "combined_context", "product_context"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, info = table(spark, sf_dir, "product_pages"), table(spark, sf_dir, "extracted_product_info_v2")
    one = residue.find(pages, "page_id", ["page_title", "text_preview"], "product_pages", "company_name")
    return one.unionByName(residue.find(info, "extract_id", "interest_rate", "extracted_product_info_v2"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field value that is residue instead of content."""
    return _residue(spark, sf_dir).select("source_table", "field_name", "row_id")


def p5_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue by table, field and class."""
    return _residue(spark, sf_dir).groupBy("source_table", "field_name", "kind").agg(F.count("*").alias("n_values"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    info, master = table(spark, sf_dir, "extracted_product_info_v2"), table(spark, sf_dir, "fintech_timelines_master")
    one = info.select(F.lit("company").alias("kind"), F.col("company").alias("name"))
    one = one.unionByName(info.select(F.lit("product").alias("kind"), F.col("product_name").alias("name")))
    one = one.unionByName(master.where("entry_type = 'Product'").select(F.lit("product").alias("kind"), F.col("product_name").alias("name")))
    return names.attribute(one.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("freq")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different spellings of one company or product."""
    return names.pairs(_roots(spark, sf_dir))


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the canonical spelling it is attached to and the number of spellings of its entity."""
    roots = _roots(spark, sf_dir)
    return roots.join(roots.groupBy("kind", "root").agg(F.count("*").alias("n_spellings")), ["kind", "root"]).select("kind", "name", F.col("root").alias("canonical"), "n_spellings")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank or category every typed value means, -1 for none of the list."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", "bank_partner_specific")
    names = canon.listed(table(spark, sf_dir, "matched_names"), ["partnername", "idrssd"])
    items = packed.split(info, "extract_id", ["bank_partner_specific"], packed.fit(info, ["bank_partner_specific"], cleaning.TYPES, cleaning.TAIL))
    banks = canon.resolve(items, "item", canon.bank_entries(names), canon.bank_form, [n for n, _ in names if n])
    master = table(spark, sf_dir, "fintech_timelines_master").select("row_id", "product_subcategory")
    listed = canon.listed(table(spark, sf_dir, "subcategory_list"), ["product_subcategory", "subcategory_id", "also_called"])
    kinds = canon.resolve(master, "product_subcategory", canon.category_entries(listed), canon.category_form, [r[0] for r in listed if r[0]])
    one = banks.select("field_name", F.col("extract_id").alias("row_id"), "item_no", "canonical_id")
    return one.unionByName(kinds.select(F.lit("product_subcategory").alias("field_name"), "row_id", F.lit(1).alias("item_no"), "canonical_id"))


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many typed values of each field mean none of the list."""
    return p7_found(spark, sf_dir).groupBy("field_name").agg(F.count("*").alias("n_cases"), F.count_if(F.col("canonical_id") == -1).alias("n_unmatched"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # encoding is dear and the sizes are needed for the plan and for the sample: they are kept in the shared folder
    return cut(encode.token_counts(table(spark, sf_dir, "documents").where("source is not null"), "doc_id", "text", ["source"]))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken into every mix, with its number of uses."""
    return mixing.sample(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached beside the targets."""
    return mixing.shares(*mixing.sample(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct piece of personal information of every document."""
    return pii.find(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal information."""
    return pii.redact(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p6_found": p6_found, "p6_spellings": p6_spellings, "p7_found": p7_found, "p7_unmatched": p7_unmatched, "p10_found": p10_found, "p10_redacted": p10_redacted, "p2_found": p2_found, "p2_body": p2_body, "p5_found": p5_found, "p5_by_kind": p5_by_kind, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
