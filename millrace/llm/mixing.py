"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Defined cases: documents without source or of a source the mix does not list take no part; a listed
source without documents (or with empty ones only) reaches nothing and its weight goes to the others; a
null or negative share counts as zero; a null max_repeats as one use; an unset total is the size of all
listed documents; if even full use of every source falls short of the total, all are used in full. Empty
documents have no size and are taken with the whole repetitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # slices of a source by hash; the fractional repetition is cut to a slice


def water_fill(weights: list[float], most: list[float], total: float) -> list[float]:
    """Sizes that follow the weights up to each one's most, the excess of full ones going to the others in proportion."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    left = min(total, sum(most[i] for i in open_))
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole >= most[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = most[i]
        left -= sum(most[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def _slice(seed: int, mix: Column, doc: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), mix, doc), F.lit(BUCKETS)).cast("int")


def allocate(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """The filled mix: one entry per row of `targets`, which bounds what comes to the driver.

    sizes: (source, n_tokens) of all documents, aggregated here; targets: (mix_name, source, target_share, max_repeats).
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_docs"))
    rows = [r.asDict() for r in targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").orderBy("mix_name", "source").collect()]
    for mix in sorted({r["mix_name"] for r in rows}):
        own = [r for r in rows if r["mix_name"] == mix]
        size = [float(r["available"] or 0) for r in own]
        want = sum(size) if total is None else total
        share = [max(0.0, r["target_share"] or 0.0) for r in own]
        got = water_fill(share, [s * max(0, 1 if r["max_repeats"] is None else r["max_repeats"]) for s, r in zip(size, own)], want)
        for r, s, g, w in zip(own, size, got, share):
            r |= {"available": int(s), "n_docs": r["n_docs"] or 0, "target_tokens": w * want, "granted": g, "epochs": g / s if s else 0.0}
    return rows


def sample(docs: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix_name, source, doc_id, n_tokens, repeats) of the documents taken, and the filled plan.

    docs: (doc_id, source, n_tokens). Every document is used the whole number of epochs of its source; one
    use more goes to those whose hash slice lies below the source's cut, which is set from the sizes of
    the slices, so that the fraction is met to within one slice. Sizes are folded by (mix, source, slice)
    before they are shuffled: a source with a third of the rows is no hot key.
    """
    spark = docs.sparkSession
    rows = allocate(docs.select("source", "n_tokens"), targets, total)
    plan = spark.createDataFrame(
        [(r["mix_name"], r["source"], float(r["target_share"] or 0), r["max_repeats"], r["n_docs"], r["available"], float(r["target_tokens"]), float(r["granted"]), int(r["epochs"] + 1e-9), float(r["granted"] - int(r["epochs"] + 1e-9) * r["available"])) for r in rows],
        "mix_name string, source string, target_share double, max_repeats int, n_docs long, available long, target_tokens double, granted double, whole int, rest double",
    )
    # the plan has as many rows as the target table
    one = docs.join(F.broadcast(plan.where("whole > 0 or rest > 0").select("mix_name", "source", "whole", "rest")), "source").withColumn("slice", _slice(seed, F.col("mix_name"), F.col("doc_id")))
    by = one.where("rest > 0").groupBy("mix_name", "source", "rest", "slice").agg(F.sum("n_tokens").alias("size"))
    run = F.sum("size").over(Window.partitionBy("mix_name", "source").orderBy("slice"))
    # the last slice is taken if that comes nearer to the rest than leaving it
    cuts = by.withColumn("upto", run).where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("mix_name", "source").agg(F.max("slice").alias("cut"))
    taken = one.join(F.broadcast(cuts), ["mix_name", "source"], "left")
    repeats = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("n_tokens") > 0) & (F.col("slice") <= F.col("cut")), 1).otherwise(0)
    return taken.select("mix_name", "source", "doc_id", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0"), plan


def shares(taken: DataFrame, plan: DataFrame) -> DataFrame:
    """Shares reached beside the targets, one row per mix and source."""
    got = taken.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached_tokens"), F.count("*").alias("docs_used"), F.max("repeats").alias("most_repeats"))
    whole = F.sum("reached_tokens").over(Window.partitionBy("mix_name"))
    one = plan.join(got, ["mix_name", "source"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    one = one.withColumn("reached_share", F.try_divide(F.col("reached_tokens"), whole))
    return one.select(
        "mix_name", "source", "target_share", "max_repeats", "n_docs", F.col("available").alias("available_tokens"), F.round("target_tokens", 2).alias("target_tokens"), F.round("granted", 2).alias("granted_tokens"),
        "reached_tokens", F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round("reached_share", 6).alias("reached_share"),
        F.round(F.greatest(F.col("target_share") - F.col("reached_share"), F.lit(0.0)), 6).alias("shortfall"),
    )
