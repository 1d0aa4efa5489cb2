"""Water-filling and sampling: shares, caps, shortfalls, seeds."""

import random

from pyspark.sql import functions as F

from millrace.llm import mixing


def test_water_fill_against_small_steps():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randint(1, 5)
        w, most = [rng.random() for _ in range(n)], [rng.random() * 10 for _ in range(n)]
        total = rng.random() * 20
        got = mixing.water_fill(w, most, total)
        assert abs(sum(got) - min(total, sum(most))) < 1e-6
        assert all(g <= m + 1e-9 for g, m in zip(got, most))
        open_ = [g / x for g, x, m in zip(got, w, most) if g < m - 1e-9]
        assert not open_ or max(open_) - min(open_) < 1e-6


def test_shares_and_caps(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").when(F.col("id") < 3900, "b").otherwise("c").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    docs = docs.unionByName(spark.createDataFrame([(9000, None, 5), (9001, "zz", 5)], "doc_id long, source string, n_tokens long"))
    targets = spark.createDataFrame([("m", "a", 0.2, 1), ("m", "b", 0.5, 3), ("m", "c", 0.2, 2), ("m", "none", 0.1, 4)], "mix_name string, source string, target_share double, max_repeats int")
    taken, plan = mixing.sample(docs, targets, total=6000)
    rows = taken.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    assert max(r.repeats for r in rows if r.source == "c") <= 2 and {r.source for r in rows} == {"a", "b", "c"}
    got = {r.source: r for r in mixing.shares(taken, plan).collect()}
    assert got["none"].reached_tokens == 0 and got["none"].shortfall == 0.1
    assert abs(got["b"].reached_tokens - got["b"].granted_tokens) / got["b"].granted_tokens < 0.02
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.sample(docs, targets, total=6000)[0].collect()))
    assert mixing.sample(docs.where("false"), targets)[0].count() == 0
