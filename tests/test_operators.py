"""Defined cases of the operators: nulls, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import closure, drift, entity, extract, generators, packed, records, regimes, rules, stats, temporal, windows


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_keep_first_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, None), ("a", 1, "b")], "k string, o int, rank string")
    assert rows(windows.keep_first(df, ["k"], F.col("o"), F.col("rank"))) == [("a", 1, "b"), (None, 3, "z")]
    assert windows.keep_first(df.where("false"), ["k"], F.col("o")).count() == 0


def test_thinned_takes_even_steps(spark):
    df = spark.range(25).withColumn("k", F.lit("a")).unionByName(spark.range(3).withColumn("k", F.lit("b")))
    got = windows.thinned(df, ["k"], 10, F.col("id"))
    assert rows(got.where("k = 'a'"), "id") == sorted([(i,) for i in range(0, 20, 2)], key=str)
    assert got.where("k = 'b'").count() == 3


def test_state_is_carried_over_blocks(spark):
    data = [(i, i // 3, "s" + str(i) if i in (1, 7) else None) for i in range(12)]
    df = spark.createDataFrame(data, "i int, b int, v string")
    got = windows.carried_in_blocks(df, "i", F.col("b"), last=F.col("v"))
    assert [r[1] for r in sorted(rows(got, "i", "last"))] == [None] + ["s1"] * 6 + ["s7"] * 5
    assert windows.carried_in_blocks(df.where("false"), "i", F.col("b"), last=F.col("v")).count() == 0


def test_last_rule_wins_and_null_is_a_rule(spark):
    df = spark.createDataFrame([("a", "old", 1), ("b", "old", 2), ("c", "old", 3), (None, "old", 4), ("a", "old", 1)], "k string, v string, ordinal int")
    table = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("b", "x", 1), ("b", None, 5), (None, "never", 9)], "k string, value string, ordinal int")
    got = rules.overwrite(df, table, ["k"], "v")
    assert got.columns == df.columns
    assert rows(got, "k", "v") == sorted([("a", "two"), ("a", "two"), ("b", None), ("c", "old"), (None, "old")], key=str)
    assert rows(rules.overwrite(df, table.where("false"), ["k"], "v")) == rows(df)


def test_remap_keeps_or_drops_the_unmapped(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    table = spark.createDataFrame([("a", "A", 1)], "from string, to string, ordinal int")
    assert rows(rules.remap(df, table, "v")) == sorted([("A",), ("b",), (None,)], key=str)
    assert rows(rules.remap(df, table, "v", keep=False)) == sorted([("A",), (None,), (None,)], key=str)


def test_flags_and_lookup(spark):
    df = spark.createDataFrame([("A b", None), ("ab", True), (None, False)], "name string, hit boolean")
    assert rows(rules.flag(df, spark.createDataFrame([("A b",), ("A b",)], "name string"), ["name"], "hit")) == sorted([("A b", True), ("ab", True), (None, False)], key=str)
    names = spark.createDataFrame([("a b", "one", 1), ("AB", "two", 2), ("ab", "three", 3)], "n string, site string, o int")
    got = rules.lookup_with_fallback(df.select("name"), names, "name", "n", "site", "o")
    assert rows(got) == sorted([("A b", "one"), ("ab", "two"), (None, None)], key=str)


def test_chain_ends_with_cycles(spark):
    edges = [("e", "a", "b", 1), ("e", "b", "c", 2), ("e", "c", "d", 3), ("e", "x", "y", 4), ("e", "y", "z", 5), ("e", "z", "y", 6), ("e", "w", "x", 7), ("f", "a", "q", 8), ("e", "b", "old", 0), ("e", None, "k", 9), ("e", "s", "s", 10)]
    got = {(e, n): r for e, n, r in rows(closure.chain_ends(spark.createDataFrame(edges, "entity string, name string, next string, ordinal int")), "entity", "name", "root")}
    assert got == {("e", "a"): "d", ("e", "b"): "d", ("e", "c"): "d", ("e", "x"): "y", ("e", "w"): "y", ("e", "y"): "y", ("e", "z"): "z", ("f", "a"): "q"}
    long = [("e", str(i), str(i + 1), i) for i in range(100)]
    assert {r for _, _, r in rows(closure.chain_ends(spark.createDataFrame(long, "entity string, name string, next string, ordinal int")), "entity", "name", "root")} == {"100"}


def test_spans_do_not_count_down(spark):
    df = spark.createDataFrame([(1, 2010, 2012), (2, 2012, 2010), (3, None, 2011), (4, 2020, None)], "id int, a int, b int")
    assert rows(generators.active_years(df, "a", "b", 2005, 2021), "id", "year") == [(1, 2010), (1, 2011), (1, 2012), (4, 2020), (4, 2021)]


def test_nearest_against_brute_force(spark):
    rng = random.Random(4)
    snaps = [(rng.choice("ab"), rng.randint(0, 60), f"v{i:03d}") for i in range(60)] + [("a", None, "n")]
    targets = [(k, t) for k in "abc" for t in range(-5, 70, 3)]
    got = temporal.nearest(spark.createDataFrame(targets, "k string, t int"), spark.createDataFrame(snaps, "k string, s int, value string"), "k", "t", "s", "value")
    for k, t, v, d in rows(got, "k", "t", "value", "distance"):
        own = sorted((abs(s - t), s, x) for kk, s, x in snaps if kk == k and s is not None)
        assert (d, v) == ((own[0][0], own[0][2]) if own else (None, None))
    assert got.count() == len(targets)


def test_validity_is_strict_and_null_years_meet_all(spark):
    df = spark.createDataFrame([(1, "k", 2010), (2, "k", 2011), (3, "k", None), (4, None, 2011)], "id int, k string, y int")
    spans = spark.createDataFrame([("k", "s1", 2010, 2013), ("k", "s2", None, 2013), ("k", "s3", 2013, 2010)], "k string, s string, a int, b int")
    assert rows(temporal.valid_at(df, spans, ["k"], "y", "a", "b", ["s"]), "id", "s") == [(2, "s1"), (3, "s1"), (3, "s2"), (3, "s3")]


def test_stale_pages_need_a_fresh_one_that_names_them(spark):
    pages = [("c", "u1", "2020-02-01", 1), ("c", "u2", "2020-08-01", 2), ("c", "u3", "2020-03-01", 3), ("c", "u2", "2020-09-01", 4), ("c", "u2", None, 5)]
    df = spark.createDataFrame(pages, "c string, u string, d string, id long").withColumn("d", F.to_date("d"))
    got = temporal.carried_pages(df, ["c"], "u", "d", "id", F.lit(2020 * 2 + 1))
    assert rows(got, "h", "u", "id", "fresh") == [(4040, "u1", 1, True), (4040, "u3", 3, True), (4041, "u1", 1, False), (4041, "u2", 4, True), (4041, "u3", 3, False)]
    says = spark.createDataFrame([(4, "u1"), (1, "u3")], "id long, named string")
    kept = temporal.reachable(got, says, ["c"], "u", "id")
    assert rows(kept.where("h = 4041"), "u") == [("u1",), ("u2",)]


def test_statistics_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (None,), (9.0,)], "v double")
    assert [r.n_values for r in stats.histogram(df, "v", 4).orderBy("bin").collect()] == [3, 0, 0, 1]
    assert rows(stats.bins_by_quantile(df, "v", 10), "v", "bin") == sorted([(1.0, 1)] * 3 + [(9.0, 10), (None, None)], key=str)
    assert stats.histogram(df.where("v = 1"), "v", 4).where("n_values > 0").count() == 1
    assert stats.histogram(df.where("false"), "v").count() == 0
    assert stats.trim(df.where("false"), "v", 0.1, 0.9).count() == 0


def test_preferred_field(spark):
    data = [(1.0, 2.0), (0.0, 2.0), (None, 2.0), (0.0, 0.0), (None, None), (3.0, None), (0.0, None)]
    df = spark.createDataFrame(data, "a double, b double").select(regimes.prefer(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == [1.0, 2.0, 2.0, 0.0, None, 3.0, 0.0]


def test_items_by_regime(spark):
    df = spark.createDataFrame([("1999-03-31",), ("2019-03-31",)], "d string").select(F.to_date("d").alias("d"), F.create_map(F.lit("RCFD1754"), F.lit("5"), F.lit("RCONJJ34"), F.lit("7"), F.lit("RCFD1773"), F.lit("x")).alias("m"))
    got = [(r.s, r.n) for r in df.select(regimes.item(F.col("m"), "securities", F.col("d")).alias("s"), regimes.item(F.col("m"), "securities", F.col("d"), skip_nulls=False).alias("n")).collect()]
    assert got == [(5.0, None), (7.0, None)]


@pytest.mark.parametrize("score", ["token_sort", "weighted"])
def test_best_match_against_brute_force(spark, monkeypatch, score):
    from millrace.functions.fuzzy import SCORES

    rng = random.Random(2)
    name = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))
    ref = [(name(), f"i{i}", i) for i in range(40)] + [(None, "n", 99), ("  ", "b", 98)]
    values = [(name(),) for _ in range(30)] + [(None,), ("",), ("a b",), ("a b",)]
    r, v = spark.createDataFrame(ref, "name string, ident string, at int"), spark.createDataFrame(values, "value string")
    want = {}
    for (x,) in values:
        if x and x.strip():
            want[x] = max((SCORES[score](x, n), -at, i) for n, i, at in ref if n and n.strip())
    for size in (20_000, 15):
        monkeypatch.setattr(entity.blocks, "__defaults__", (size,))
        got = {g.value: (g.score, g.ident) for g in entity.best_match(v, "value", r, "name", "ident", "at", score=score).collect()}
        assert got == {k: (s, i) for k, (s, _, i) in want.items()}


def test_phrases_and_overlaps(spark):
    ref = spark.createDataFrame([("first bank", "1"), ("bank", "2"), ("first bank of x", "3"), (None, "4"), ("", "5")], "name string, ident string")
    texts = spark.createDataFrame([(1, "the first bank of x and bankers"), (2, None), (3, ""), (4, "banks")], "id long, t string")
    assert rows(entity.phrases(texts, "id", "t", ref)) == sorted([(1, "bank", "2"), (1, "first bank", "1"), (1, "first bank of x", "3")], key=str)
    got = entity.longest_overlap(spark.createDataFrame([("my first bank",), ("irst",), ("zzz",), (None,)], "v string"), "v", ref)
    assert rows(got) == [("irst", "first bank of x", "3"), ("my first bank", "first bank", "1")]
    assert entity.phrases(texts, "id", "t", ref.where("false")).count() == 0


def test_extraction_statuses(spark):
    good = "A loan of 4.25% and a fee. " * 4

    def model(chunk, entity_name, name):
        if "bad" in chunk:
            raise ValueError("x")
        return "nothing" if "none" in chunk else '{"product_type": "loan", "rates": [{"interest_rate": "4.25%", "description": "d"}, {"interest_rate": "4.25%", "description": "d"}]}'

    df = spark.createDataFrame([(1, good, "e", "n"), (2, None, "e", "n"), (3, "short", "e", None), (4, "bad " * 20, None, "n"), (5, "none " * 20, "e", "n")], "id long, t string, e string, n string")
    said = extract.answers(df, model, "id", "t", "e", "n", most=60)
    got = df.join(extract.merged(said, "id", ["product_type"], [], []), "id", "left")
    status = {r.id: (r.s, r.k) for r in got.select("id", extract.status(F.col("t"), F.coalesce("n_read", F.lit(0)), F.col("error")).alias("s"), F.size("rates").alias("k")).collect()}
    assert status[1] == ("OK", 1)
    assert status[2][0] == "SKIPPED: no context" and status[3][0] == "SKIPPED: insufficient context"
    assert status[4][0] == "ERROR: ValueError: x" and status[5][0] == "ERROR: no JSON in answer"


def test_packed_items(spark):
    values = ["a; b", "a;b;c", "x", "y", "", None, "; ;", '"a; b"', "[a; b]", "c ;  d"] + [f"p{i}; q{i}" for i in range(30)] + [f"r{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, item string")
    m = packed.fit(df, ["item"])
    assert m.accepted == {"item": ["semicolon"]}
    got = {}
    for f, i, n, x in rows(packed.split(df, "id", ["item"], m), "field_name", "id", "item_no", "item"):
        got.setdefault(i, []).append((n, x))
    assert got[0] == [(1, "a"), (2, "b")] and got[8] == [(1, "a"), (2, "b")] and got[9] == [(1, "c"), (2, "d")]
    assert 4 not in got and 5 not in got and 6 not in got
    assert packed.fit(df.where("false"), ["item"]).accepted == {"item": []}


RAW = [
    (1, "f", 0, 'IDRSSD\tRCFD1\t"RCFD2"\t', "q", "033101"),
    (2, "f", 1, "12\t5\t1.5\t", "q", "033101"),
    (3, "f", 2, "12\t5", "q", "033101"),
    (4, "f", 3, '12\t"5\t6\t', "q", "033101"),
    (5, "f", 4, "0\t5\t6\t", "q", "033101"),
    (6, "f", 5, None, "q", "033101"),
    (7, "g", 1, "12\t5\t6\t", "q", "063001"),
    (8, "f", 6, '13\t"a\t""b"""\tx\t', "q", "033101"),
]


def test_rejects_and_cells(spark):
    raw = spark.createDataFrame(RAW, "record_id long, file_name string, line_no int, raw_line string, feed string, quarter_code string")
    assert rows(records.rejects(raw, "\t", "IDRSSD", "t"), "record_id", "reason") == [(3, "column_count"), (4, "broken_quote"), (5, "invalid_value"), (6, "column_count"), (7, "column_count")]
    assert rows(records.loaded(raw, "\t", "IDRSSD"), "record_id") == [(2,), (8,)]
    assert rows(records.failing_cells(raw, "\t", "IDRSSD", {"*": "number"}, "t"), "record_id", "field_name", "value") == [(8, "RCFD1", 'a\t"b'), (8, "RCFD2", "x")]
    assert records.rejects(raw.where("false"), "\t", "IDRSSD", "t").count() == 0


def test_drift_between_quarters(spark):
    raw = spark.createDataFrame(
        [(1, "f", 0, "IDRSSD\tA\tB\tC\tA", "q", "033101"), (2, "f", 1, "1\t5\t1.5\tx\t", "q", "033101"), (3, "g", 0, "IDRSSD\tA\tD\tE", "q", "063001"), (4, "g", 1, "1\t5.5\t1\ty", "q", "063001"), (5, "h", 0, "IDRSSD\tA", "q", "123101")],
        "record_id long, file_name string, line_no int, raw_line string, feed string, quarter_code string",
    )
    items = spark.createDataFrame([("B", "i"), ("D", "i")], "field_name string, item string")
    assert rows(drift.report(raw, items)) == sorted([("g", "type_changed", "A", "A"), ("g", "renamed", "B", "D"), ("g", "removed", "C", ""), ("g", "added", "", "E")], key=str)
    one = drift.ingest(raw, {"A": "long"}).orderBy("record_id").collect()
    assert [(r.A, r._rescued) for r in one] == [(5, '{"B":"1.5","C":"x"}'), (None, '{"A":"5.5","D":"1","E":"y"}')]
    assert drift.report(raw.where("false"), items).count() == 0
