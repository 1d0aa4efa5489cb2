"""Snapshot index of archived pages as a data source, and adapters for what is fetched, searched or probed.

The network is not this engine's matter: an index is read from files laid down by a crawler, and fetching,
searching and probing are functions that the caller injects; they run beside the data in Arrow batches and every
miss leaves a row with its status.

Defined cases: an index without rows for an address gives none; a function that raises gives its row the status
'error'; null addresses are not fetched and have the status 'no_url'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions import dates
from millrace.operators import temporal
from millrace.operators.windows import keep_first


class SnapshotIndex(DataSource):
    """`spark.read.format("snapshot_index")` with options path, from, to, status ('200'), mimetype; one partition a year."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_index"

    def schema(self) -> str:
        return "url string, timestamp string, statuscode string, mimetype string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options)


class _IndexReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.status, self.mime = options["path"], options.get("status", "200"), options.get("mimetype", "")
        self.years = range(int(options.get("from", "1996")), int(options.get("to", "2035")) + 1)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in self.years]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        y = partition.value
        f = pads.field
        keep = (f("timestamp") >= f"{y}0101000000") & (f("timestamp") <= f"{y}1231235959")
        if self.status:
            keep = keep & (f("statuscode") == self.status)
        if self.mime:
            keep = keep & (f("mimetype") == self.mime)
        yield from pads.dataset(self.path).to_table(columns=["url", "timestamp", "statuscode", "mimetype"], filter=keep).to_batches()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotIndex)


def collapsed(index: DataFrame, digits: int = 6) -> DataFrame:
    """The first snapshot of each address and stretch of time: 6 digits for a month, 8 for a day."""
    return keep_first(index, ["url", F.substring("timestamp", 1, digits)], F.col("timestamp"))


def closest(targets: DataFrame, index: DataFrame, url: str = "url", date: str = "date") -> DataFrame:
    """`targets` with the timestamp nearest to their date and the distance in days."""
    t = targets.withColumn("__n", F.unix_date(F.col(date)))
    s = index.select("url", "timestamp", F.unix_date(dates.snapshot_date(F.col("timestamp"))).alias("__n"))
    return temporal.nearest(t, s.withColumnRenamed("url", url), url, "__n", "__n", "timestamp").drop("__n")


def closest_by_prefix(targets: DataFrame, index: DataFrame, url: str = "url", date: str = "date", years: int = 2) -> DataFrame:
    """As `closest`, over all addresses that begin with the target's and lie within some years of its date.

    Addresses meet their targets by equality on each of their own prefixes that end at a path sign or a digit run,
    so that no target is compared with every address.
    """
    known = targets.select(F.col(url).alias("prefix")).distinct()
    sizes = known.select(F.length("prefix").alias("n")).distinct()
    got = index.select("url", "timestamp").join(F.broadcast(sizes), F.length("url") >= F.col("n")).withColumn("prefix", F.left("url", F.col("n")))
    met = got.join(known, "prefix").select(F.col("prefix").alias("url"), "timestamp")
    one = closest(targets, met, url, date)
    near = F.col("distance") <= years * 366
    return one.withColumn("timestamp", F.when(near, F.col("timestamp"))).withColumn("distance", F.when(near, F.col("distance")))


def fetched(df: DataFrame, url: str, fetch: Callable[[str], str | None], attempts: int = 3) -> DataFrame:
    """`df` with content and status: 'OK', 'fetch_failed' for no content, 'error' or 'no_url'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, status = [], []
            for u in b.column(url).to_pylist():
                text, s = None, "no_url"
                for _ in range(attempts if u else 0):
                    try:
                        text = fetch(u)
                        s = "fetch_failed" if text is None else "OK"
                    except Exception:  # noqa: BLE001 - a fetcher may fail in any way
                        s = "error"
                        continue
                    break
                got.append(text)
                status.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(status, pa.string())], names=[*b.schema.names, "content", "status"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "content string", "status string"])
    return df.mapInArrow(run, schema)


def searched(df: DataFrame, query: str, site: str, search: Callable[[str], list[str]], most: int = 5) -> DataFrame:
    """`df` with a row for each result of a search, restricted to the site first and broad where that gives nothing; `rank` from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ranks, found = [], [], []
            for i, (q, s) in enumerate(zip(b.column(query).to_pylist(), b.column(site).to_pylist())):
                hits = ((search(f"site:{s} {q}") if s else []) or search(q))[:most] if q else []
                at += [i] * len(hits)
                ranks += range(1, len(hits) + 1)
                found += hits
            took = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(ranks, pa.int32()), pa.array(found, pa.string())], names=[*b.schema.names, "rank", "found_url"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "rank int", "found_url string"])
    return df.mapInArrow(run, schema)


def first_hit(tried: DataFrame, keys: list[str], url: str, ordinal: str, exists: Callable[[str], bool]) -> DataFrame:
    """(keys, url, ordinal): the first candidate of each group that exists; each distinct address is probed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([u for u in urls if exists(u)], pa.string())], names=[url])

    there = tried.select(url).where(F.col(url).isNotNull()).distinct().mapInArrow(run, f"`{url}` string")
    hit = tried.join(there, url, "left_semi")
    return hit.groupBy(*keys).agg(F.min_by(url, ordinal).alias(url), F.min(ordinal).alias(ordinal))
