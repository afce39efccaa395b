"""Streaming forms of the daily batch: append, latest price, catalog upsert, validate and route.

None of them uses a watermark: a row that comes late is late, not wrong. What a batch writes bears
the batch's number, so a batch that is run again after a failure replaces its own output only.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from larder.operators.quality import route_validated, validate_nutrition
from larder.operators.upserts import UpsertPolicy


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_batches(rows: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Replaces those partitions of the table that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def price_append(observations: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends observations, in any order of time, without those that were delivered before.

    A replay carries the time of the original, so only the months that a batch touches are read.
    """
    added = [StructField("captured_month", DateType()), StructField("batch_id", LongType())]
    schema = StructType([*observations.schema.fields, *added])
    spark = observations.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("captured_month", "batch_id").parquet(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        dated = batch.dropDuplicates(key).withColumn("captured_month", F.trunc("captured_at", "month"))
        months = dated.select("captured_month").distinct()
        before = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch_id") < batch_id)
        known = before.join(months, "captured_month", "left_semi").select(*key)
        fresh = dated.join(known, key, "left_anti").withColumn("batch_id", F.lit(batch_id).cast("long"))
        spread = fresh.repartitionByRange("captured_month", F.xxhash64(*key))
        _replace(spread, path, "captured_month", "batch_id")

    return run_batches(observations, run, checkpoint)


def changes(rows: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes what each batch says of its keys, one row a key, to the batch's own folder.

    ``fold`` gives the same whatever order and portions its rows come in, so that readers fold the
    folders once more. No state is held between batches: a batch costs what it brings, however many
    keys came before, and one that is run again replaces its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return run_batches(rows, write, checkpoint)


def fold_latest(rows: DataFrame, key: str) -> DataFrame:
    """The last observation per key, whatever order its rows came in."""
    rest = [c for c in rows.columns if c not in (key, "captured_at", "seq")]
    return rows.groupBy(key).agg(F.max(F.struct("captured_at", "seq", *rest)).alias("last")).select(key, "last.*")


def latest_price(observations: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last observation per key; :func:`read_latest` reads it."""
    return changes(observations, lambda rows: fold_latest(rows, key), path, checkpoint)


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that batches wrote, folded once more: the last of a key's rows is the greatest."""
    return fold_latest(spark.read.parquet(path).drop("batch"), key)


def upsert_states(incoming: DataFrame, policy: UpsertPolicy, seq: str = "seq") -> DataFrame:
    """Rows with the places in the order of arrival of the newest update and of the first insert."""
    return incoming.select(*policy.columns, F.col(seq).alias("updated_seq"), F.col(seq).alias("inserted_seq"))


def fold_states(rows: DataFrame, policy: UpsertPolicy) -> DataFrame:
    """One row per key, whatever order its rows came in."""
    folded = rows.groupBy(*policy.key).agg(
        F.max(F.struct("updated_seq", *policy.update)).alias("_new"),
        F.min(F.struct("inserted_seq", *policy.keep)).alias("_first"),
        *[F.max(c).alias(c) for c in policy.latest], *[F.min(c).alias(c) for c in policy.earliest],
    )
    return folded.select(*policy.key, "_new.*", "_first.*", *policy.latest, *policy.earliest)


def catalog_upsert(incoming: DataFrame, policy: UpsertPolicy, path: str, checkpoint: str) -> StreamingQuery:
    """Merges by natural key; :func:`read_upserted` reads the table."""
    return changes(upsert_states(incoming, policy), lambda rows: fold_states(rows, policy), path, checkpoint)


def read_upserted(spark: SparkSession, path: str, policy: UpsertPolicy) -> DataFrame:
    return fold_states(spark.read.parquet(path).drop("batch"), policy)


def validate_route(candidates: DataFrame, accepted_path: str, issues_path: str,
                   checkpoint: str) -> StreamingQuery:
    """Accepted nutrition and issues from one stream. Each batch writes its own folder in both
    sinks, so a replayed batch overwrites itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        accepted, issues = route_validated(validate_nutrition(batch))
        accepted.write.mode("overwrite").parquet(os.path.join(accepted_path, f"batch={batch_id}"))
        issues.write.mode("overwrite").parquet(os.path.join(issues_path, f"batch={batch_id}"))

    return run_batches(candidates, run, checkpoint)
