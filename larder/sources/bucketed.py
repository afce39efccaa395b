"""Price history and variant tables laid out by variant, so that work per variant needs no shuffle.

Tables are bucketed by ``variant_id`` and sorted inside each bucket, through Spark's catalog, which
remembers the layout. An aggregate by variant or a join of two such tables with the same number
of buckets then reads matching buckets in one task; nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "variant_id"


def save(rows: DataFrame, table: str, path: str, buckets: int, order: tuple[str, ...] = (), key: str = KEY) -> DataFrame:
    """Writes ``rows`` as a table at ``path``, bucketed by ``key``, and registers it. Rows are dealt by the bucketing hash
    first, so that every bucket is one file."""
    (
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
        .option("path", path).mode("overwrite").saveAsTable(table)
    )
    return rows.sparkSession.table(table)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session deals a shuffle into; all tables of a catalog share it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class BucketedCatalog:
    """The variant-keyed tables of a catalog, stored once and read by bucket afterwards."""

    def __init__(self, cat, prefix: str, folder: str) -> None:
        buckets = bucket_count(cat.spark)
        self.prices = save(cat.prices, f"{prefix}_prices", f"{folder}/prices", buckets, ("captured_at",))
        self.variants = save(cat.variants, f"{prefix}_variants", f"{folder}/variants", buckets)
        self.nutrition = save(cat.nutrition, f"{prefix}_nutrition", f"{folder}/nutrition", buckets)
