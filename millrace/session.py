"""Session defaults, table access and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A session with the settings the operators are tested under (a cluster brings its own)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only on a local master without setting.

    On a cluster a folder of one machine would be lost with it, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return found or ""


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SMALL = 64 << 20  # bytes up to which a side is broadcast


def small_side(df: DataFrame, most: int = SMALL) -> DataFrame:
    """`df`, written to the shared folder once and marked for broadcast if what was written is small.

    The size is that of the rows as text, counted on what was written; a larger side is left to the
    optimizer, whose join then shuffles and splits skewed keys.
    """
    kept = cut(df)
    size = kept.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(kept) if size <= most else kept
