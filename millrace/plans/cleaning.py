"""Queries of the general data-cleaning operators (packed fields, failing rows, drifting schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import drift, packed, records
from millrace.plans.registry import Registry
from millrace.plans.regulatory import cells
from millrace.session import table

PACKED = ["bank_partner_specific", "snapshot_dates", "source_files", "page_types"]
# fixed values: words that no bank's name consists of alone, and the legal tails that follow a comma but belong to the name
TYPES = packed.TYPES | {"name": r"^(?!(?i:bank|trust|company|co|savings|state|national|community|commercial|federal|na|n\.a\.|fsb|inc\.?|member fdic)\b)\S.*$"}
TAIL = r"(?!\s*(?:(?:N\.?\s?A\.?|F\.?\s?S\.?\s?B\.?|I[nN][cC]\.?)(?=[\s\"'\],;|/]|$)|\(?M\w{3,7}\s+F\w{2,4}\b))"
R = Registry()
QUERIES, SQL = R.queries, R.sql


def _rejects_sql(source: str, sep: str, key: str, valid: str) -> str:
    k = f"vals[list_position(names, '{key}')]"
    return f"""(with {cells(source, sep)} select '{source}' as source_table, record_id, case when broken then 'broken_quote' when names is null or n_seps <> 2 * len(names) then 'column_count' else 'invalid_value' end as reason from cells
  where broken or names is null or n_seps <> 2 * len(names) or not coalesce({valid.replace('?', k)}, false))"""


ID_OK = "(regexp_full_match(?, '0*[1-9][0-9]{0,6}') and length(?) <= 7)"
NAME_OK = r"(regexp_matches(?, '\pL') and lower(?) not in ('nan', 'null', 'none', 'n/a'))"


def _items_sql() -> str:
    """The items in SQL, at the delimiters that the scoring accepts: what stands in quotes and a name's legal tail is stood in for while a value is cut."""
    bare = lambda c: f"regexp_replace(regexp_replace({c}, '^[\\s\"''\\[\\]]+', ''), '[\\s\"''\\[\\]]+$', '')"
    outer = lambda c: f"regexp_replace(regexp_replace({c}, '^[\\s\\[]+', ''), '[\\s\\]]+$', '')"
    shield = lambda c: f"array_to_string(list_transform(string_split({c}, '\"'), lambda p, i: case when i % 2 = 0 and len(string_split({c}, '\"')) % 2 = 1 and not regexp_matches({c}, '^\"[^\"]*[;|\\n][^\"]*\"[\\s;]*$') then translate(p, ';,|/+&', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6)) else p end), '\"')"
    back = lambda c: f"translate({c}, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6), ';,|/+&')"
    tail = r",(\s*(?:(?:N\.?\s?A\.?|F\.?\s?S\.?\s?B\.?|I[nN][cC]\.?)(?:[\s\"'\],;|/]|$)|\(?M\w{3,7}\s+F\w{2,4}\b))".replace("'", "''")
    cuts = {
        "bank_partner_specific": f"regexp_split_to_array(regexp_replace({shield(outer('bank_partner_specific'))}, '{tail}', chr(2) || '\\1', 'g'), '[;|/,\\r\\n]|\\s[Aa][Nn][Dd]\\s')",
        "snapshot_dates": f"regexp_split_to_array({shield(outer('snapshot_dates'))}, '[;,|/\\s]')",
        "page_types": f"regexp_split_to_array({shield(outer('page_types'))}, '[;,|/\\r\\n+&]')",
        "source_files": f"string_split(regexp_replace({outer('source_files')}, '(?i)(\\.html)[\"'']?(?:\\s*[;,|\\r\\n\\t][\\s\"'']*)+', '\\1' || chr(7), 'g'), chr(7))",
    }
    one = " union all ".join(f"select '{f}' as field_name, extract_id, list_filter(list_transform({c}, lambda x: {back(bare('x'))}), lambda x: x <> '') as items from extracted_product_info_v2 where {f} is not null" for f, c in cuts.items())
    return f"with one as ({one}) select field_name, extract_id, generate_subscripts(items, 1)::integer as item_no, unnest(items) as item from one where len(items) >= 2"


@R.query(_items_sql())
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of every packed value that holds two or more."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", *PACKED)
    return packed.split(info, "extract_id", PACKED, packed.fit(info, PACKED, TYPES, TAIL), least=2)


@R.query()
def p1_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each candidate delimiter of each field, and whether it was accepted."""
    info = table(spark, sf_dir, "extracted_product_info_v2").select("extract_id", *PACKED)
    m = packed.fit(info, PACKED, TYPES, TAIL)
    rows = [(f, m.types[f], n, k, r, c, n in m.accepted[f]) for f, n, k, r, c in m.scores]
    return spark.createDataFrame(rows, "field_name string, item_type string, delimiter string, n_values long, regularity double, consistency double, accepted boolean")


@R.query(f"select * from {_rejects_sql('rc_raw', chr(9), 'IDRSSD', ID_OK)} union all select * from {_rejects_sql('timeline_batch_raw', ',', 'COMPANY_NAME', NAME_OK)}")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that does not load, with its first reason."""
    rc = records.rejects(table(spark, sf_dir, "rc_raw"), "\t", "IDRSSD", "rc_raw")
    return rc.unionByName(records.rejects(table(spark, sf_dir, "timeline_batch_raw"), ",", "COMPANY_NAME", "timeline_batch_raw"))


TIMELINE = ["company_name", "product_name", "entry_type", "product_category", "product_subcategory", "year_launched", "product_history_and_description"]


@R.query(f"""with {cells("timeline_batch_raw", ",")} select record_id, file_name, {", ".join(f"vals[list_position(names, '{c.upper()}')] as {c}" for c in TIMELINE)} from cells
where not broken and names is not null and n_seps = 2 * len(names) and {NAME_OK.replace("?", "vals[list_position(names, 'COMPANY_NAME')]")}""")
def p3_loaded_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline records that load, as one table with named columns."""
    one = records.loaded(table(spark, sf_dir, "timeline_batch_raw"), ",", "COMPANY_NAME")
    at = lambda c: F.try_element_at("values", F.array_position("names", c.upper()).cast("int"))
    return one.select("record_id", "file_name", *[F.when(F.array_contains("names", c.upper()), at(c)).alias(c) for c in TIMELINE])


@R.query(rf"""
select * from (with {cells("rc_raw", chr(9))}, l as (select record_id, unnest(names) as field_name, unnest(vals) as value from cells where not broken and names is not null and n_seps = 2 * len(names) and {ID_OK.replace("?", "vals[list_position(names, 'IDRSSD')]")})
select 'rc_raw' as source_table, record_id, field_name, value, 'number' as wanted from l where field_name not in ('', 'IDRSSD') and regexp_matches(value, '\S') and not regexp_full_match(value, '\s*[+-]?(\d+\.?\d*|\.\d+)\s*'))
union all select * from (with {cells("timeline_batch_raw", ",")}, l as (select record_id, unnest(names) as field_name, unnest(vals) as value from cells where not broken and names is not null and n_seps = 2 * len(names) and {NAME_OK.replace("?", "vals[list_position(names, 'COMPANY_NAME')]")})
select 'timeline_batch_raw' as source_table, record_id, field_name, value, 'integer' as wanted from l where field_name = 'YEAR_LAUNCHED' and regexp_matches(value, '\S') and not regexp_full_match(value, '\s*[+-]?\d+\s*'))
""")
def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of loading records that do not cast: amounts that are no numbers, launch years that are no integers."""
    rc = records.failing_cells(table(spark, sf_dir, "rc_raw"), "\t", "IDRSSD", {"*": "number"}, "rc_raw")
    return rc.unionByName(records.failing_cells(table(spark, sf_dir, "timeline_batch_raw"), ",", "COMPANY_NAME", {"YEAR_LAUNCHED": "integer"}, "timeline_batch_raw"))


P4_SQL = rf"""with {cells("rc_raw", chr(9))},
good as (select file_name, names, vals from cells where not broken and names is not null and n_seps = 2 * len(names) and {ID_OK.replace("?", "vals[list_position(names, 'IDRSSD')]")}),
v as (select file_name, unnest(names) as field, unnest(vals) as v from good),
kinds as (select file_name, field, max(case when regexp_full_match(v, '[+-]?[0-9]+') then 0 when regexp_full_match(v, '[+-]?([0-9]+\.[0-9]*|\.[0-9]+)') then 1 else 2 end) as kind from v where v <> '' group by all),
meta as (select file_name, min(feed) as feed, min(quarter_code) as code from rc_raw where line_no = 0 group by 1),
files as (select file_name, feed, ((case when substring(code, 5, 2) >= '69' then 1900 else 2000 end) + substring(code, 5, 2)::integer) * 4 + (substring(code, 1, 2)::integer - 1) // 3 as q from meta),
fields as (select distinct file_name, field from (select file_name, unnest(names) as field from heads) where field not in ('', 'IDRSSD')),
now as (select * from fields join files using (file_name) left join kinds using (file_name, field)),
pairs as (select a.file_name, b.file_name as prior from files a join files b on a.feed = b.feed and b.q = a.q - 1 where a.file_name in (select file_name from fields) and b.file_name in (select file_name from fields)),
names_of as (select upper(trim(field_name)) as field, min(item) as item from rc_items group by 1),
gone as (select p.file_name, n.field, item, row_number() over (partition by p.file_name, item order by n.field) as k from pairs p join now n on n.file_name = p.prior left join names_of using (field) where not exists (select 1 from now x where x.file_name = p.file_name and x.field = n.field)),
new as (select p.file_name, n.field, item, row_number() over (partition by p.file_name, item order by n.field) as k from pairs p join now n on n.file_name = p.file_name left join names_of using (field) where not exists (select 1 from now x where x.file_name = p.prior and x.field = n.field))
select p.file_name, 'type_changed' as drift, a.field as field_before, a.field as field_after from pairs p join now a on a.file_name = p.file_name join now b on b.file_name = p.prior and b.field = a.field where a.kind <> b.kind
union all select coalesce(g.file_name, n.file_name), case when g.field is not null and n.field is not null then 'renamed' when g.field is not null then 'removed' else 'added' end, coalesce(g.field, ''), coalesce(n.field, '')
from gone g full join new n on g.file_name = n.file_name and g.item = n.item and g.k = n.k"""


@R.query(P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schema change of a file against the quarter before."""
    return drift.report(table(spark, sf_dir, "rc_raw"), table(spark, sf_dir, "rc_items"))


@R.query()
def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadable Schedule RC records as one table; total assets enforced, the other listed fields replayed from the rescue, and one column for each item."""
    fields = drift.item_fields(table(spark, sf_dir, "rc_items"))
    enforced = ["RCFD2170", "RCON2170"]
    # amounts drift between whole numbers and decimals
    one = drift.ingest(table(spark, sf_dir, "rc_raw"), {f: "double" for f in enforced}, as_json=False)
    one = drift.replay(one, {f: "double" for f in sorted(f for names in fields.values() for f in names) if f not in enforced})
    return drift.by_item(one, fields)
