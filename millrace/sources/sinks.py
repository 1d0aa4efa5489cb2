"""Sinks: whole tables, idempotent batches, swapped rewrites, done-tables, document tables, staged runs.

Spark commits a job's files together, so a reader never meets a truncated last line, and a batch that is written
again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def overwrite_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """The table as CSV with header; one_file only for results known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """The rows as one batch of a parquet table; the same batch again takes the place of its first writing."""
    df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def without(df: DataFrame, columns: list[str], path: str) -> None:
    """A copy of the table without some columns."""
    df.drop(*columns).write.mode("overwrite").parquet(path)


def documents(df: DataFrame, path: str, entity: str) -> None:
    """Documents as rows of a table split by entity, in place of a file each."""
    df.write.mode("overwrite").partitionBy(entity).parquet(path)


def _exists(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap(df: DataFrame, path: str) -> None:
    """`df` in place of the table at the path, which `df` may have been read from: written beside it, then renamed.

    The old table is kept as <path>.old until the new one is in place.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs, at = _exists(spark, path)
    _, new = _exists(spark, f"{path}.new")
    _, old = _exists(spark, f"{path}.old")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise RuntimeError(f"could not put the new table at {path}")
    fs.delete(old, True)


def done_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The keys a done-table holds; an empty table where there is none yet."""
    fs, at = _exists(spark, path)
    return spark.read.parquet(path).drop(BATCH) if fs.exists(at) else spark.createDataFrame([], schema)


def run_stages(stages: dict[str, Callable[[], None]], start: str | None = None) -> list[str]:
    """Runs named stages in order, from `start` on; the first that fails ends the run with its name in the error."""
    names = list(stages)
    if start is not None and start not in stages:
        raise KeyError(start)
    done = []
    for name in names[names.index(start) if start else 0 :]:
        try:
            stages[name]()
        except Exception as e:
            raise RuntimeError(f"stage {name} failed after {', '.join(done) or 'none'}") from e
        done.append(name)
    return done
