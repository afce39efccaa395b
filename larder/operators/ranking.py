"""Total orders, top-k, pages and exact ranks that no single task has to hold."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.filters import FilterSpec
from larder.session import cut_lineage, kept

PAGE_SIZE = 50
HUGE = 1_000_000  # a group with fewer rows is sorted by one task
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def rank_order(spec: FilterSpec) -> list[Column]:
    """Metric first with nulls last either way, then the cheaper offer, then the variant id."""
    value = F.col(spec.metric_def.column)
    first = value.desc_nulls_last() if spec.descending else value.asc_nulls_last()
    return [first, F.col("price_cents").asc_nulls_last(), F.col("variant_id").asc_nulls_last()]


def rank_by_metric(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.orderBy(*rank_order(spec))


def top_listings(df: DataFrame, spec: FilterSpec, take: int) -> DataFrame:
    return rank_by_metric(df, spec).limit(take)


def page_listings(df: DataFrame, spec: FilterSpec, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page near the front: each task keeps at most ``page * size`` rows. For deep pages use
    :func:`global_rank` and filter on the rank."""
    return rank_by_metric(df, spec).offset((max(page, 1) - 1) * size).limit(size)


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions, sorted, each with its place as (partition, row).

    The place is written to reliable storage: sampling the ranges again after a lost
    executor could move rows between partitions and break the counts.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table under a total order.

    Every range partition counts its own rows; a partition's offset is the sum of the counts
    before it. The offset table has one row per partition, so broadcasting it is bounded.
    """
    placed = _placed(df, order).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row + 1)
        .drop("_part", "_place", "_before")
    )


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "pos", sizes: DataFrame | None = None) -> DataFrame:
    """1-based position inside each group under a total order, for groups of any size.

    Groups that a task can sort are numbered in one shuffle by group. Those with more rows than an
    even partition are range partitioned by (group, order), so that a huge group spans several
    partitions and each is numbered on its own; there are fewer of them than shuffle partitions, so
    their table is broadcast. ``sizes`` (the group, ``_n``) saves storing ``df`` to count its groups.
    """
    if sizes is None:
        df = kept(df, "ranked")
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = kept(sizes, "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    even = max(HUGE, total // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    huge = sizes.filter(F.col("_n") > even).select(*[F.col(g).alias(f"_{g}") for g in group])
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if huge.isEmpty():
        return df.withColumn(name, local)
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    light = df.join(F.broadcast(huge), same, "left_anti").withColumn(name, local)
    return light.unionByName(_rank_across(df.join(F.broadcast(huge), same, "left_semi"), group, order, name))


def _rank_across(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The same where groups span range partitions. Only groups that cross a border need an offset; there
    is at most one such (group, partition) pair per partition, so that table is bounded by the
    number of partitions and is broadcast.
    """
    placed = _placed(df, [*[F.col(g).asc_nulls_last() for g in group], *order])
    placed = placed.withColumn("_part", F.shiftright("_place", _ROW_BITS))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        counts.withColumn("_before", F.sum("_n").over(before))
        .filter(F.col("_before") > 0)
        .select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_at"), "_before")
    )
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_part") == F.col("_at"))
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_place")).cast("long")
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(crossing), same, "left")
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def page_row_number(rank: Column, size: int = PAGE_SIZE) -> Column:
    return (rank - 1) % size + 1


def page_number(rank: Column, size: int = PAGE_SIZE) -> Column:
    return F.floor((rank - 1) / size) + 1


def page_bounds(total: Column, page: Column, size: int = PAGE_SIZE) -> dict[str, Column]:
    """How many pages there are and which absolute positions one of them shows."""
    return {
        "total_pages": F.greatest(F.lit(1), F.ceil(total / size)).cast("long"),
        "first_shown": F.when(total == 0, 0).otherwise((page - 1) * size + 1).cast("long"),
        "last_shown": F.least(page * size, total).cast("long"),
    }
