"""One table of drifting files: all listed fields, wide types, one column for each item."""

import json

import pytest

from millrace.plans import cleaning
from millrace.session import build_session


@pytest.fixture(scope="module")
def spark():
    return build_session("local[2]", 2)


def test_fields_of_one_item_meet_and_decimals_are_typed(spark, tmp_path):
    lines = [
        (1, "f", "a", "033117", 0, "IDRSSD\tRCFD1754\tRCFD2170\tRCFD9999"),
        (2, "f", "a", "033117", 1, "11\t5\t70.5\t3"),
        (3, "f", "b", "063017", 0, "IDRSSD\tRCFDJJ34\tRCON2170\tRCFD9999"),
        (4, "f", "b", "063017", 1, "11\t6.25\t80\tx"),
        (5, "f", "b", "063017", 2, "12\tCONF\t\t"),
    ]
    spark.createDataFrame(lines, "record_id long, feed string, file_name string, quarter_code string, line_no int, raw_line string").write.parquet(f"{tmp_path}/rc_raw.parquet")
    items = [("RCFD1754", "held to maturity securities"), ("rcfdjj34 ", "held to maturity securities"), ("RCFD2170", "total assets"), ("RCON2170", "total assets")]
    spark.createDataFrame(items, "field_name string, item string").write.parquet(f"{tmp_path}/rc_items.parquet")
    rows = {r.record_id: r for r in cleaning.p4_table(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [2, 4, 5]
    assert [(rows[i].held_to_maturity_securities, rows[i].total_assets) for i in (2, 4, 5)] == [(5.0, 70.5), (6.25, 80.0), (None, None)]
    assert (rows[2].RCFD2170, rows[4].RCFDJJ34, rows[4].RCFD1754) == (70.5, 6.25, None)
    assert [json.loads(rows[i]["_rescued"]) for i in (2, 4, 5)] == [{"RCFD9999": "3"}, {"RCFD9999": "x"}, {"RCFDJJ34": "CONF"}]
