"""Structured text: tolerant JSON, model answers, packed timestamp lists and file-name grammar.

Defined cases: what cannot be read gives null, never an error; an empty list gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip


def answer_json(c: Column) -> Column:
    """The JSON text of a model's answer: thought tags and fences dropped, else the first brace to the last."""
    s = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    fenced = strip(F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    s = F.when(F.startswith(s, F.lit("```")), fenced).otherwise(s)
    braced = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(s).isNotNull(), s).when(F.json_object_keys(braced).isNotNull(), braced)


def parse_answer(c: Column, schema: str) -> Column:
    """The answer as a struct of the schema; null if it holds no JSON object."""
    return F.from_json(answer_json(c), schema)


def first_rate(rates: Column) -> Column:
    """interest_rate of the first rate; null without rates."""
    return F.get(rates, F.lit(0))["interest_rate"]


def joined_descriptions(rates: Column) -> Column:
    """Non-empty descriptions of all rates, in order."""
    return F.array_join(F.filter(F.transform(rates, lambda r: r["description"]), lambda d: F.length(d) > 0), "; ")


def timestamp_list(c: Column) -> Column:
    """The 14-digit timestamps of a cell that packs them in any way; longer or shorter runs of digits are none."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.filter(runs, lambda t: F.length(t) == 14)


def file_parts(path: Column, page_types: list[str]) -> Column:
    """(entity, name, page_type, timestamp) of '<entity>/<name>__<page_type>__<slug>_<timestamp>.html'.

    The first part that is a known page type ends the name; without one the page type is 'unknown' and the
    name is the first part.
    """
    folder = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), "_", " ")
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    parts = F.split(base, "__")
    at = F.array_position(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"^_+|_+$", "").isin(page_types)), True).cast("int")
    named = F.when(at > 0, F.slice(parts, 1, at - 1)).otherwise(F.slice(parts, 1, 1))
    words = F.filter(F.transform(named, lambda p: F.trim(F.regexp_replace(p, "_", " "))), lambda p: p != "")
    kind = F.when(at > 0, F.regexp_replace(F.trim(F.get(parts, at - 1)), r"^_+|_+$", "")).otherwise("unknown")
    return F.struct(folder.alias("entity"), F.array_join(words, " ").alias("name"), kind.alias("page_type"), F.nullif(F.regexp_extract(base, r"(\d{14})$", 1), F.lit("")).alias("timestamp"))
