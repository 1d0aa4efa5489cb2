"""Incremental forms: files taken as they come, periods with late data, and pages carried forward by state.

The batch operators give the same results over all files; these keep up with new ones. Restart is by the
checkpoint folder of the query, so nothing is done twice and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import dates


def new_files(spark: SparkSession, path: str, schema: str, at_once: int = 1000) -> DataFrame:
    """Stream of the parquet files of a folder, up to `at_once` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def process(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Hands every micro-batch that is new since the checkpoint to `handle`, then ends; run again for what came since."""
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def half_year_counts(stream: DataFrame, ts: str, keys: list[str], late: str = "200 days") -> DataFrame:
    """Rows by keys and half-year, as a stream with a watermark.

    `window` takes no calendar periods, so the half-year is a key of its own beside windows of a day, whose ends let
    finished state go: a count is emitted by day and half-year, and sums of its days are the half-year's.
    """
    day = F.window(ts, "1 day")
    return stream.withWatermark(ts, late).groupBy(*keys, dates.half_year(F.col(ts)).alias("period"), day.alias("day")).agg(F.count("*").alias("n")).select(*keys, "period", F.col("day.start").alias("day"), "n")


STATE = "last_day string, last_id long"
OUT = "company string, product_name string, target_url string, day string, page_id long, is_news boolean"


def latest_pages(stream: DataFrame) -> DataFrame:
    """For each product and address the latest page so far, emitted when a batch brings a later one.

    stream: (company, product_name, target_url, day, page_id). An address is one group, so a hot company is many
    groups; state is two values each. Of pages of one day the first by id stays.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for f in frames:
            for day, ident in zip(f["day"], f["page_id"]):
                if day is not None and (best is None or day > best[0] or day == best[0] and ident < best[1]):
                    best = (day, int(ident))
        if best is not None:
            state.update(best)
            yield pd.DataFrame([[*key, *best, best != before]], columns=["company", "product_name", "target_url", "day", "page_id", "is_news"])

    return stream.groupBy("company", "product_name", "target_url").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
