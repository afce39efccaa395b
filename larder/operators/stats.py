"""Counters of an ingestion run, per source and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ["sources", "products", "variants", "prices", "nutrition_ok", "issues"]


def run_stats(parts: dict[str, DataFrame]) -> DataFrame:
    """``parts`` maps a counter to rows with ``source_id``. Every part is counted per source
    first, so the rollup sees a handful of rows per source."""
    counted = None
    for name in COUNTERS:
        if name not in parts:
            continue
        rows = parts[name].groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(
            "source_id",
            *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in COUNTERS],
        )
        counted = rows if counted is None else counted.unionByName(rows)
    return counted.rollup("source_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
