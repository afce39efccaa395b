"""Session helpers: a tuned builder and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for checkpoints and working tables, deleted when it ends.

    It lies in ``spark.checkpoint.dir``, or in the warehouse, which is shared too, where that is
    unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/larder-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as the session shuffles into, before work that costs much per row.

    Adaptive execution joins shuffle partitions by their bytes, so that millions of short keys would
    be parsed or spelled out in one task; it leaves a number that was asked for alone. The keys are hashed
    first: rows that an aggregate has dealt by the bare keys already would not be dealt again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a table that is written inside go when it is written.

    Nothing reads them after that, but Spark keeps them until the driver happens to collect garbage.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder in packed columns and goes on from there.

    Takes a fraction of a checkpoint's disk, and readers read only the columns they use; rows may
    come back in other partitions.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and continue from there.

    Used where two consumers must see the very same partitioning or the same
    sampled bounds even if an executor is lost in between.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
