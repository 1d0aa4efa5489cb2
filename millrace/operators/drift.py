"""Files whose schema drifts: rescue-column ingestion, replay into typed columns, and a drift report.

`ingest` enforces a target schema: approved fields become typed columns, everything unknown or
uncastable is kept as JSON in `_rescued`. `replay` promotes further fields from `_rescued` later, without
reading the files again; `by_item` brings the fields of one item, under whatever name, into one column.
`report` compares each file with the file of its feed one quarter earlier.

Defined cases: a feed without a file for the quarter before has no changes reported for that file; a
file without loadable values has fields without type, which do not count as type changes; a name that
a header repeats counts once, its first non-blank value being kept; where several gone and several new
fields carry one item they are paired in name order and the rest is removed or added; where a record has
several fields of one item, the item's column has the first in name order that is not null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import records
from millrace.session import cut, small_side

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"
ID = "IDRSSD"


def quarter_index(code: Column) -> Column:
    """Quarters since year 0 of an MMDDYY quarter end; years from 69 on are of the 1900s."""
    yy = F.try_to_number(F.substring(code, 5, 2), F.lit("99")).cast("int")
    mm = F.try_to_number(F.substring(code, 1, 2), F.lit("99")).cast("int")
    return (yy + F.when(yy >= 69, 1900).otherwise(2000)) * 4 + F.floor((mm - 1) / 3).cast("int")


def quarter_end(code: Column) -> Column:
    """Date of an MMDDYY code under the same century rule; null if it is none."""
    yy = F.substring(code, 5, 2)
    year = F.concat(F.when(yy >= "69", F.lit("19")).otherwise(F.lit("20")), yy)
    return F.try_to_date(F.concat(year, F.substring(code, 1, 4)), "yyyyMMdd")


def rescue(names: Column, values: Column) -> Column:
    """Map of field to its non-blank value; unnamed columns are left out, the first of repeated names stays."""
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: (p["k"] != "") & (p["v"] != ""))
    named = F.filter(names, lambda n: n != "")
    # only a header that repeats a name needs the fold, which grows with the square of its columns
    first = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc).otherwise(F.array_append(acc, F.struct(p["k"].alias("k"), p["v"].alias("v")))))
    return F.when(F.size(F.array_distinct(named)) == F.size(named), F.map_from_entries(pairs)).otherwise(F.map_from_entries(first))


def _cast(value: Column, kind: str) -> Column:
    if kind == "long":
        return F.when(value.rlike(INTEGER), value.try_cast("long"))
    if kind == "double":
        return F.when(value.rlike(INTEGER) | value.rlike(DECIMAL), value.try_cast("double"))
    return value


def rescued(raw: DataFrame) -> DataFrame:
    """(record_id, file_name, _m): the map of every loadable record."""
    return records.loaded(raw, "\t", ID).select("record_id", "file_name", rescue(F.col("names"), F.col("values")).alias("_m"))


def ingest(raw: DataFrame, target: dict[str, str], as_json: bool = True) -> DataFrame:
    """One consistent table of all loadable records: file columns, idrssd, the target fields, `_rescued`.

    target: field name -> 'long', 'double' or 'string'. A field the file lacks or that cannot be cast is
    null; unknown fields and uncastable values are kept in `_rescued` (JSON, null when empty; a map where a
    replay follows in the same plan).
    """
    files = small_side(raw.where("line_no = 0").groupBy("file_name").agg(F.min("feed").alias("feed"), F.min("quarter_code").alias("quarter_code")))
    one = rescued(raw).join(files, "file_name", "left").select("feed", "file_name", quarter_end(F.col("quarter_code")).alias("quarter_end"), "record_id", F.try_element_at("_m", F.lit(ID)).try_cast("long").alias("idrssd"), "_m")
    return _promote(one, target, as_json)


def _promote(one: DataFrame, target: dict[str, str], as_json: bool) -> DataFrame:
    typed = [_cast(F.try_element_at("_m", F.lit(f)), k).alias(f) for f, k in target.items()]
    by_kind: dict[str, list[str]] = {}
    for f, k in target.items():
        by_kind.setdefault(k, []).append(f)
    # the cast is asked of each value once, not of every field in every record
    done = lambda k, v: reduce(lambda a, b: a | b, [k.isin(names) & _cast(v, kind).isNotNull() for kind, names in by_kind.items()], k == ID)
    left = F.map_filter("_m", lambda k, v: ~done(k, v))
    kept = [c for c in one.columns if c not in ("_m", *target)]
    return one.select(*kept, *typed, F.when(F.size(left) > 0, F.to_json(left) if as_json else left).alias("_rescued"))


def replay(table: DataFrame, more: dict[str, str]) -> DataFrame:
    """`table` with further fields promoted from `_rescued` into typed columns; `_rescued` is JSON or a map, and JSON after it."""
    kept = F.col("_rescued") if table.schema["_rescued"].dataType.typeName() == "map" else F.from_json("_rescued", "map<string,string>")
    return _promote(table.withColumn("_m", F.coalesce(kept, F.create_map().cast("map<string,string>"))).drop("_rescued"), more, True)


def item_fields(items: DataFrame) -> dict[str, list[str]]:
    """Column name of each item -> its fields in name order; items: (field_name, item), a list of bounded size."""
    rows = items.where("item is not null").groupBy(F.upper(F.trim("field_name")).alias("field")).agg(F.min("item").alias("item")).where("field <> ''").collect()
    out: dict[str, list[str]] = {}
    for field, item in sorted((r.field, r["item"]) for r in rows):
        out.setdefault(re.sub(r"\W+", "_", item.strip().lower()), []).append(field)
    return out


def by_item(table: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """`table` with one column for each item, from its fields' typed columns; `_rescued` stays last."""
    one = [F.coalesce(*[F.col(f"`{f}`") for f in names]).alias(item) for item, names in fields.items()]
    return table.select(*[F.col(f"`{c}`") for c in table.columns if c != "_rescued"], *one, "_rescued")


def profile(raw: DataFrame) -> DataFrame:
    """(feed, q, file_name, field, kind): the type of every field of every file, over its rescued values.

    Castability is folded per file and field before anything is shuffled; kind is null for a field without values.
    """
    wide = rescued(raw).select("file_name", F.explode("_m").alias("field", "v")).where(F.col("field") != ID)
    whole, point = F.col("v").rlike(INTEGER), F.col("v").rlike(DECIMAL)
    # 0: integer, 1: decimal, 2: text; the field has the greatest of its values
    rank = F.when(whole, 0).when(point, 1).otherwise(2)
    kinds = wide.groupBy("file_name", "field").agg(F.max(rank).alias("r"))
    kinds = kinds.select("file_name", "field", F.when(F.col("r") == 0, "integer").when(F.col("r") == 1, "decimal").otherwise("text").alias("kind"))
    head = (
        raw.where("line_no = 0")
        .groupBy("file_name")
        .agg(F.min("feed").alias("feed"), F.min("quarter_code").alias("code"), F.min_by("raw_line", "record_id").alias("line"))
        .select("feed", quarter_index(F.col("code")).alias("q"), "file_name", F.explode(F.array_distinct(records.header_names(F.coalesce("line", F.lit("")), "\\t"))).alias("field"))
        .where((F.col("field") != "") & (F.col("field") != ID))
    )
    return head.join(kinds, ["file_name", "field"], "left")


def report(raw: DataFrame, items: DataFrame) -> DataFrame:
    """(file_name, drift, field_before, field_after): every change against the quarter before.

    items: (field_name, item); two fields with one item are one field under two names.
    """
    # files x fields, which the rest meets several times
    now = cut(profile(raw))
    files = now.select("feed", "q", "file_name").distinct()
    pairs = files.join(files.select("feed", (F.col("q") + 1).alias("q"), F.col("file_name").alias("prior")), ["feed", "q"])
    after = pairs.join(now.select("file_name", "field", F.col("kind").alias("kind_after")), "file_name")
    before = pairs.join(now.select(F.col("file_name").alias("prior"), "field", F.col("kind").alias("kind_before")), "prior")
    both = before.withColumn("had", F.lit(True)).join(after.withColumn("has", F.lit(True)), ["feed", "q", "file_name", "prior", "field"], "full")
    changed = both.where("had and has and kind_before <> kind_after").select("file_name", F.lit("type_changed").alias("drift"), F.col("field").alias("field_before"), F.col("field").alias("field_after"))
    names = small_side(items.groupBy(F.upper(F.trim("field_name")).alias("field")).agg(F.min("item").alias("item")))
    moved = both.where("had is null or has is null").join(names, "field", "left")
    # a running number within file, item and side pairs the gone with the new; items without name pair with none
    w = Window.partitionBy("file_name", "item", "had").orderBy("field")
    moved = moved.withColumn("rank", F.when(F.col("item").isNotNull(), F.row_number().over(w)))
    folded = moved.groupBy("file_name", F.coalesce("item", F.concat(F.lit("\x00"), "field")).alias("item"), "rank").agg(F.max(F.when(F.col("had"), F.col("field"))).alias("b"), F.max(F.when(F.col("has"), F.col("field"))).alias("a"))
    drift = F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), "renamed").when(F.col("b").isNotNull(), "removed").otherwise("added")
    return changed.unionByName(folded.select("file_name", drift.alias("drift"), F.coalesce("b", F.lit("")).alias("field_before"), F.coalesce("a", F.lit("")).alias("field_after")))
