"""Queries of the balance-sheet panel: items by date regime, the identity check, summaries and logs of quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import drift, generators, records, regimes, rules, stats
from millrace.plans.registry import Registry
from millrace.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def cells(source: str, sep: str) -> str:
    """SQL of the table `cells`: the records of a raw table beside their header, values cut and bare, broken quoting told.

    Separators are doubled, so that each field has its own on both sides; a quoted field is then emptied and a
    quote that is left is a broken one. Separators within quotes are stood in for while a record is cut.
    """
    s = {"\t": "chr(9)", ",": "','"}[sep]
    esc = {"\t": r"\t", ",": ","}[sep]
    return rf"""
heads as (select file_name, list_transform(string_split(arg_min(coalesce(raw_line, ''), record_id), {s}), lambda c: upper(regexp_replace(regexp_replace(c, '^[\s"]+', ''), '[\s"]+$', ''))) as names from {source} where line_no = 0 group by 1),
lines as (select r.record_id, r.file_name, coalesce(raw_line, '') as line, names from {source} r left join heads using (file_name) where line_no > 0 or line_no is null),
emptied as (select *, regexp_replace({s} || replace(line, {s}, {s} || {s}) || {s}, '{esc}"(?:[^"]|"")*"{esc}', {s} || {s}, 'g') as bare_line from lines),
cells as (select record_id, file_name, names, contains(bare_line, '"') as broken, length(bare_line) - length(replace(bare_line, {s}, '')) as n_seps,
  list_transform(string_split(array_to_string(list_transform(string_split(line, '"'), lambda p, i: case when i % 2 = 0 then replace(p, {s}, chr(1)) else p end), '"'), {s}), lambda c: replace(replace(regexp_replace(regexp_replace(c, '^[\s"]+', ''), '[\s"]+$', ''), '""', '"'), chr(1), {s})) as vals from emptied)"""


def _loaded_rc() -> str:
    return cells("rc_raw", "\t") + r""",
loaded as (select record_id, file_name, names, vals from cells where not broken and names is not null and n_seps = 2 * len(names) and regexp_full_match(vals[list_position(names, 'IDRSSD')], '0*[1-9][0-9]{0,6}') and length(vals[list_position(names, 'IDRSSD')]) <= 7)"""


def _number(c: str) -> str:
    return rf"(case when regexp_full_match({c}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') then try_cast(trim({c}) as double) end)"


def _sql_field(code: str) -> str:
    a, b = (_number(f"vals[list_position(names, '{side}{code}')]") for side in ("RCFD", "RCON"))
    return f"(case when coalesce({a}, 0) = 0 and coalesce({b}, 0) <> 0 then {b} else {a} end)"


def _sql_item(name: str) -> str:
    parts = []
    for _, first, last, codes in [r for r in regimes.REGIMES if r[0] == name]:
        when = " and ".join([f"qdate >= date '{first}'"] * bool(first) + [f"qdate <= date '{last}'"] * bool(last)) or "true"
        parts += [f"(case when {when} then coalesce({_sql_field(c)}, 0) else 0 end)" for c in codes]
    return " + ".join(parts)


QDATE = "make_date((case when substring(code, 5, 2) >= '69' then 1900 else 2000 end) + substring(code, 5, 2)::integer, substring(code, 1, 2)::integer, substring(code, 3, 2)::integer)"
PANEL_SQL = f"""with {_loaded_rc()},
files as (select file_name, min(quarter_code) as code from rc_raw where line_no = 0 group by 1),
dated as (select l.*, {QDATE} as qdate, code from loaded l join files using (file_name)),
items as (select record_id, file_name, code, qdate, names, vals[list_position(names, 'IDRSSD')]::bigint as idrssd, {_sql_field(regimes.TOTAL)} as assets, {', '.join(f'{_sql_item(i)} as {i}' for i in regimes.ITEMS)} from dated),
panel as (select *, {' + '.join(regimes.ITEMS)} as assetcheck from items where assets is not null)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "rc_raw")
    files = raw.where("line_no = 0").groupBy("file_name").agg(F.min("quarter_code").alias("code"))
    one = records.loaded(raw, "\t", drift.ID)
    named = one.select("record_id", "file_name", "names", drift.rescue(F.col("names"), F.col("values")).alias("m"))
    return named.join(files, "file_name").withColumn("qdate", dates.quarter_end(F.col("code")))


def asset_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loadable record with its items, their sum, the difference to total assets and whether it passes."""
    one = _records(spark, sf_dir)
    items = one.select("record_id", "file_name", "code", "qdate", F.element_at("m", drift.ID).cast("long").alias("idrssd"), regimes.field(F.col("m"), regimes.TOTAL).alias("assets"), *[regimes.item(F.col("m"), i, F.col("qdate")).alias(i) for i in regimes.ITEMS])
    panel = items.where("assets is not null").withColumn("assetcheck", sum((F.col(i) for i in regimes.ITEMS[1:]), F.col(regimes.ITEMS[0])))
    return panel.withColumn("asset_diff", F.col("assetcheck") - F.col("assets")).withColumn("pass_flag", F.abs("asset_diff") <= 1)


@R.query(f"{PANEL_SQL} select record_id, idrssd, qdate, code as quarter_code, assets, round(assetcheck, 4) as assetcheck, round(assetcheck - assets, 4) as asset_diff, abs(assetcheck - assets) <= 1 as pass_flag, assetcheck = assets as exact, {', '.join(f'round({i}, 4) as {i}' for i in regimes.ITEMS)} from panel")
def regime_asset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset panel: items by date regime, the identity check with a tolerance and strictly."""
    one = asset_panel(spark, sf_dir)
    return one.select("record_id", "idrssd", "qdate", F.col("code").alias("quarter_code"), "assets", F.round("assetcheck", 4).alias("assetcheck"), F.round("asset_diff", 4).alias("asset_diff"), "pass_flag", F.coalesce(F.col("assetcheck") == F.col("assets"), F.lit(False)).alias("exact"), *[F.round(i, 4).alias(i) for i in regimes.ITEMS])


@R.query(f"""{PANEL_SQL}
select qdate, year(qdate)::varchar || ' Q' || quarter(qdate)::varchar as label, count(*)::bigint as n, round(avg((abs(assetcheck - assets) <= 1)::integer), 6) as pass_rate, round(avg(abs(assetcheck - assets)), 2) as mean_abs_diff, round(min(assetcheck - assets), 4) as least_diff, round(max(assetcheck - assets), 4) as most_diff
from panel group by qdate""")
def quarter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the identity check by quarter, in order of time (not of the code)."""
    one = asset_panel(spark, sf_dir)
    got = one.groupBy("qdate").agg(F.count("*").alias("n"), F.round(stats.share(F.col("pass_flag")), 6).alias("pass_rate"), F.round(F.avg(F.abs("asset_diff")), 2).alias("mean_abs_diff"), F.round(F.min("asset_diff"), 4).alias("least_diff"), F.round(F.max("asset_diff"), 4).alias("most_diff"))
    return got.withColumn("label", dates.quarter_label(F.col("qdate"))).orderBy("qdate")


@R.query(f"""with {_loaded_rc()}
select record_id, {_number("vals[list_position(names, 'RCFD2170')]")} as consolidated, {_number("vals[list_position(names, 'RCON2170')]")} as domestic, {_sql_field('2170')} as preferred, greatest({_number("vals[list_position(names, 'RCFD2170')]")}, {_number("vals[list_position(names, 'RCON2170')]")}) as largest from loaded""")
def prefer_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total assets of every record: both fields, the preferred one and the larger one."""
    a, b = (rules.number(F.try_element_at("m", F.lit(f"{s}2170"))) for s in ("RCFD", "RCON"))
    return _records(spark, sf_dir).select("record_id", a.alias("consolidated"), b.alias("domestic"), regimes.prefer(a, b).alias("preferred"), regimes.largest(a, b).alias("largest"))


def _sql_wanted() -> str:
    out = []
    for _, first, last, codes in regimes.REGIMES:
        when = " and ".join([f"qdate >= date '{first}'"] * bool(first) + [f"qdate <= date '{last}'"] * bool(last)) or "true"
        out += [f"(case when {when} and not list_contains(names, 'RCFD{c}') and not list_contains(names, 'RCON{c}') then '{c}' end)" for c in codes]
    return f"list_distinct(list_filter([{', '.join(out)}], lambda x: x is not null))"


@R.query(f"""with {cells("rc_raw", chr(9))}, files as (select file_name, min(quarter_code) as code from rc_raw where line_no = 0 group by 1), dated as (select h.*, {QDATE} as qdate from heads h join files using (file_name))
select file_name, qdate, unnest({_sql_wanted()}) as missing_code from dated""")
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that the regime of a file's quarter asks for and its header lacks."""
    raw = table(spark, sf_dir, "rc_raw").where("line_no = 0")
    one = raw.groupBy("file_name").agg(F.min("quarter_code").alias("code"), F.min_by("raw_line", "record_id").alias("line"))
    one = one.select("file_name", dates.quarter_end(F.col("code")).alias("qdate"), records.header_names(F.coalesce("line", F.lit("")), "\\t").alias("names"))
    return one.select("file_name", "qdate", F.explode(regimes.missing_codes(F.col("names"), F.col("qdate"))).alias("missing_code"))


@R.query(f"""
with grid as (select last_day(d)::date as quarter_end from (select unnest(generate_series(date '1999-03-01', date '2024-12-01', interval 3 month)) as d)),
files as (select {QDATE.replace('code', 'quarter_code')} as quarter_end, count(distinct file_name) as n_files, count(*) filter (where line_no > 0) as n_records from rc_raw group by 1)
select quarter_end, strftime(quarter_end, '%m%d%y') as quarter_code, coalesce(n_files, 0)::bigint as n_files, coalesce(n_records, 0)::bigint as n_records, case when n_files is null then 'missing' else 'OK' end as status from grid left join files using (quarter_end)""")
def quarter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter end of a span with the files found for it, the missing ones included."""
    found = table(spark, sf_dir, "rc_raw").groupBy(dates.quarter_end(F.col("quarter_code")).alias("quarter_end")).agg(F.count_distinct("file_name").alias("n_files"), F.count_if(F.col("line_no") > 0).alias("n_records"))
    one = rules.with_status(generators.quarter_ends(spark, "1999-03-31", "2024-12-31"), found, ["quarter_end"], "status", "missing")
    return one.fillna(0, ["n_files", "n_records"]).select("quarter_end", "quarter_code", "n_files", "n_records", "status")
