"""Files, snapshot index, injected fetchers, sinks and streams, on folders made for the test."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.sources import files, sinks, snapshots
from millrace.streaming import incremental


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,year,\n"x, y",2001,\nz\nq,1,2,3\n"two\nlines",5,\n')
    (tmp_path / "b.csv").write_bytes(b"YEAR,Name\n2005,b\0c\n")
    (tmp_path / "c.csv").write_text("")
    got = files.delimited(spark, str(tmp_path), ["name", "year", "file"])
    assert rows(got, "name", "year", "file") == sorted([("x, y", "2001", None), ("z", None, None), ("two\nlines", "5", None), ("bc", "2005", None)], key=str)
    with pytest.raises(Exception, match="lacks"):
        files.delimited(spark, str(tmp_path), ["name", "nothing"], required=["nothing"]).collect()
    assert files.rows_of('a\tb\n"1\t2\n', "\t", True) == (["a", "b"], [['"1', "2"]], 0)


def test_folders_and_quarters(spark, tmp_path):
    for folder, name in (("033199", "b rc.txt"), ("033199", "a rc.txt"), ("093099", "c rc.txt"), ("x", "d rc.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("one\ntwo")
    got = rows(files.quarters(spark, str(tmp_path), "*rc.txt", "1999-03-31", "1999-12-31"), "quarter_code", "status")
    assert got == [("033199", "OK"), ("063099", "missing"), ("093099", "OK"), ("123199", "missing")]
    assert rows(files.first_in_folder(spark, str(tmp_path), "*.txt"), "folder")[0] == ("033199",)
    assert files.lines(spark, str(tmp_path / "x")).count() == 2
    assert rows(files.documents(spark, str(tmp_path), "*.txt"), "entity", "name")[0] == ("033199", "a rc.txt")


def test_pdf_reader(spark):
    df = spark.createDataFrame([(bytearray(b"good"),), (bytearray(b"bad"),), (None,)], "content binary")
    got = files.pdf_text(df, "content", lambda b: "t" * 200 if b == b"good" else 1 / 0)
    assert rows(got, "pdf_status") == [("OK",), ("corrupted_pdf",), ("pdf_error",)]


def test_snapshot_index(spark, tmp_path):
    data = [("http://a/t", "20200105000000", "200", "text/html"), ("http://a/t", "20200110000000", "200", "text/html"), ("http://a/t2", "20200601000000", "200", "text/html"), ("http://a/t", "20190101000000", "404", "text/html")]
    spark.createDataFrame(data, "url string, timestamp string, statuscode string, mimetype string").write.parquet(str(tmp_path / "index"))
    snapshots.register(spark)
    ix = spark.read.format("snapshot_index").option("path", str(tmp_path / "index")).option("from", "2019").option("to", "2020").load()
    assert ix.count() == 3
    assert rows(snapshots.collapsed(ix), "timestamp") == [("20200105000000",), ("20200601000000",)]
    want = spark.createDataFrame([("http://a/t", "2020-06-30"), ("http://b", "2020-01-01")], "url string, date string").withColumn("date", F.to_date("date"))
    assert rows(snapshots.closest(want, ix), "url", "timestamp") == [("http://a/t", "20200110000000"), ("http://b", None)]
    assert rows(snapshots.closest_by_prefix(want, ix), "url", "timestamp") == [("http://a/t", "20200601000000"), ("http://b", None)]


def test_injected_functions(spark):
    df = spark.createDataFrame([("u1",), ("u2",), (None,), ("u3",)], "url string")

    def fetch(u):
        if u == "u3":
            raise ValueError(u)
        return "page" if u == "u1" else None

    assert rows(snapshots.fetched(df, "url", fetch), "url", "status") == sorted([("u1", "OK"), ("u2", "fetch_failed"), (None, "no_url"), ("u3", "error")], key=str)
    q = spark.createDataFrame([("pay", "a"), (None, "a"), ("card", None)], "q string, s string")
    assert rows(snapshots.searched(q, "q", "s", lambda x: [] if x.startswith("site:") else [x + "1", x + "2"]), "q", "rank", "found_url") == [("card", 1, "card1"), ("card", 2, "card2"), ("pay", 1, "pay1"), ("pay", 2, "pay2")]
    tried = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y"), ("c", 2, "z"), ("d", 0, "x")], "c string, ordinal int, url string")
    assert rows(snapshots.first_hit(tried, ["c"], "url", "ordinal", lambda u: u in ("y", "z")), "c", "url", "ordinal") == [("c", "y", 1)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_batch(spark.range(3), path, "one")
    sinks.append_batch(spark.range(5), path, "two")
    sinks.append_batch(spark.range(2), path, "one")
    assert sinks.done_keys(spark, path, "id long").count() == 7
    assert sinks.done_keys(spark, str(tmp_path / "none"), "id long").count() == 0
    kept = str(tmp_path / "k")
    spark.range(4).write.parquet(kept)
    sinks.swap(spark.read.parquet(kept).where("id > 1"), kept)
    assert rows(spark.read.parquet(kept)) == [(2,), (3,)]
    sinks.overwrite_csv(spark.createDataFrame([('a "b"\nc', 1)], "s string, i int"), str(tmp_path / "csv"), one_file=True)
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).first().s == 'a "b"\nc'
    said = []
    assert sinks.run_stages({"a": lambda: said.append(1), "b": lambda: said.append(2)}, start="b") == ["b"] and said == [2]
    with pytest.raises(RuntimeError, match="stage b"):
        sinks.run_stages({"a": lambda: None, "b": lambda: 1 / 0})


def test_streams(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "company string, product_name string, target_url string, day string, page_id long"
    write = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def handle(df, n):
        seen.extend((r.target_url, r.day, r.page_id, r.is_news) for r in df.collect())

    write([("c", "p", "u", "2020-01-02", 1), ("c", "p", "u", "2020-01-02", 0), ("c", "p", "w", None, 3)])
    incremental.process(incremental.latest_pages(incremental.new_files(spark, source, schema)), check, handle)
    assert seen == [("u", "2020-01-02", 0, True)]
    write([("c", "p", "u", "2019-01-02", 5), ("c", "p", "x", "2021-01-02", 6)])
    incremental.process(incremental.latest_pages(incremental.new_files(spark, source, schema)), check, handle)
    assert sorted(seen[1:]) == [("u", "2020-01-02", 0, False), ("x", "2021-01-02", 6, True)]


def test_half_year_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    pd.DataFrame({"k": ["a", "a", "b"], "ts": pd.to_datetime(["2020-01-02", "2020-07-02", "2020-01-02"])})
    spark.sql("select * from values ('a', timestamp'2020-01-02'), ('a', timestamp'2020-07-02'), ('b', timestamp'2020-01-02') t(k, ts)").write.parquet(source)
    q = incremental.half_year_counts(incremental.new_files(spark, source, "k string, ts timestamp"), "ts", ["k"]).writeStream.outputMode("complete").format("memory").queryName("hy").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("hy"), "k", "period", "n") == [("a", "2020-H1", 1), ("a", "2020-H2", 1), ("b", "2020-H1", 1)]
