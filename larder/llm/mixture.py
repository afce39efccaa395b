"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. A source whose target is ``k`` whole sizes and a rest takes each
document ``k`` times, and once more those whose hash lies below the source's threshold. The
threshold is found from the top: sizes are summed by source and 12-bit hash bucket, all buckets
that fit the rest are taken, and only the documents of the one boundary bucket are looked at again
by their next 12 bits. Nothing is sorted but the at most 4,096 sums of a source.

Edge cases: a null or empty text has size 0; null sources form one source, last in order; a source
of size 0 has target 0 and takes nothing; of rows with the boundary hash (same id and text) as many
are taken as come nearest to the target; an empty table gives an empty result. Columns whose names
clash are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import documents, fresh, stored, word_count

BITS = 12
LEVELS = 5
WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3


def draw(doc_id: Column, text: Column) -> Column:
    """The document's place in 0 .. 2^60 - 1, the same on every run."""
    return F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1))


def bucket(h: Column, level: int) -> Column:
    """The hash's bits down to ``level`` (1: the top 12 bits)."""
    return F.shiftright(h, BITS * (LEVELS - level))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with ``target``; one row per source.

    Water filling in closed form: in order of cap per weight, a source is stopped at its cap while
    that cap is below its share of what the sources before it have left.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
    )
    rows = sizes.withColumn("w", weight).withColumn("top", F.col("source_size") * cap)
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select(
        "source", "source_size", "w", "top",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("top").over(before), F.lit(0)).alias("used"),
        F.sum("w").over(rest).alias("w_rest"),
    ).withColumn("stopped", F.col("top") * F.col("w_rest") < (F.col("total") - F.col("used")) * F.col("w"))
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("top"))).over(whole), F.lit(0)))
    rows = rows.withColumn("w_open", F.sum(F.when(~F.col("stopped"), F.col("w"))).over(whole))
    share = F.col("left") * F.col("w") / F.col("w_open")
    return rows.select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .when(F.col("stopped"), F.col("top").cast("double"))
        .otherwise(F.least(share, F.col("top").cast("double"))).alias("target"),
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, h) rows and targets -> per source ``copies``, the hash limit ``below`` and
    ``edge``, the words that rows of just that hash have to bring (null: none has it).

    Each level writes its small table, so the next one reads a table instead of a growing plan.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = stored(
        targets.withColumn("copies", whole.cast("long"))
        .withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("at", F.lit(0).cast("long")).withColumn("open", F.lit(True)),
        "mix-state",
    )
    near = rows
    for level in range(1, LEVELS + 1):
        # ``at`` is the boundary bucket of the level before; only its documents are refined
        live = state.filter("open").select(F.col("source").alias("s"), "at")
        inside = near.join(live, F.col("source").eqNullSafe(F.col("s")) & (bucket(F.col("h"), level - 1) == F.col("at")))
        near = inside.select("source", "size", "h")
        if level == 2:
            near = stored(near, "mix-boundary")
        sums = (
            near.groupBy("source", bucket(F.col("h"), level).alias("b"))
            .agg(F.sum("size").alias("bucket_size"))
            .withColumnRenamed("source", "s")
        )
        run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("bucket_size").over(run))
        known = state.select(F.col("source").alias("ks"), "need")
        edge = (
            sums.join(known, F.col("s").eqNullSafe(F.col("ks")))
            .filter(F.col("upto") > F.col("need"))
            .groupBy("s").agg(F.min(F.struct("b", "upto", "bucket_size")).alias("e"))
            .withColumnRenamed("s", "es")
        )
        found = F.col("e").isNotNull() & F.col("open")
        state = stored(
            state.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").select(
                "source", "source_size", "target", "copies",
                F.when(found, F.col("need") - (F.col("e.upto") - F.col("e.bucket_size"))).otherwise(F.col("need")).alias("need"),
                # no bucket goes over the rest: all that is left of the boundary fits
                F.when(found, F.col("e.b"))
                .when(F.col("open"), (F.col("at") + 1) * (1 << BITS))
                .otherwise(F.col("at") * (1 << BITS)).alias("at"),
                found.alias("open"),
                F.when(found, F.col("e.bucket_size")).otherwise(F.lit(0)).alias("last"),
            ),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "copies", F.col("at").alias("below"), F.when(F.col("open"), F.col("need")).alias("edge"))


def _nearest(held: DataFrame, work: dict[str, str]) -> DataFrame:
    """``held``, all rows of their sources' boundary hashes, with the column ``more``: 1 for the first rows
    of each source that come nearest to its ``edge`` words. Rows are summed up task by task, so that
    very many equal rows don't meet."""
    source, part = work["source"], F.shiftright(work["place"], 33).alias(work["part"])
    held = stored(held.withColumn(work["place"], F.monotonically_increasing_id()), "mix-edge")
    sums = held.groupBy(source, part).agg(F.sum("size").alias(work["sum"]))
    before = Window.partitionBy(source).orderBy(work["part"]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(source).alias(work["of"]), work["part"], F.coalesce(F.sum(work["sum"]).over(before), F.lit(0)).alias(work["sum"]))
    inside = Window.partitionBy(source, work["part"]).orderBy(work["place"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumn(work["part"], part).withColumn(work["upto"], F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col(source).eqNullSafe(F.col(work["of"])) & (rows[work["part"]] == sums[work["part"]]))
    upto = F.col(work["upto"]) + F.col(work["sum"])
    return rows.withColumn(work["more"], F.when(2 * upto + F.col("size") < 2 * F.col(work["edge"]), 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies, taken``."""
    size, h = word_count(F.col(text_col)), draw(F.col(id_col), F.col(text_col))
    rows = stored(docs.select(F.col(source_col).alias("source"), size.alias("size"), h.alias("h")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = stored(thresholds(rows, source_targets(totals, weights, cap)), "mix-limits")
    at_edge = rows.join(limits.select(F.col("source").alias("s"), "below", "edge"),
                        F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("below")) & F.col("edge").isNotNull())
    several = not at_edge.groupBy("s").count().filter("count > 1").isEmpty()
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in made]
    work = fresh(docs, "source", "ss", "target", "k", "below", "edge", "draw", "more", "place", "part", "sum", "upto", "of")
    limits = limits.select(*[F.col(c).alias(work[w]) for c, w in zip(
        ("source", "source_size", "target", "copies", "below", "edge"), ("source", "ss", "target", "k", "below", "edge"), strict=True)])
    out = docs.select(*kept, size.alias("size"), h.alias(work["draw"]))
    out = out.join(limits, F.col(source_col).eqNullSafe(F.col(work["source"])), "left")
    edge = F.coalesce((F.col(work["draw"]) == F.col(work["below"])) & F.col(work["edge"]).isNotNull(), F.lit(False))
    # a row at the edge joins when that comes nearer to the target
    more = F.when(F.col(work["draw"]) < F.col(work["below"]), 1).when(edge & (F.col("size") < 2 * F.col(work["edge"])), 1).otherwise(0)
    plain = out.filter(~edge) if several else out
    columns = [*out.columns, work["more"]]
    out = plain.withColumn(work["more"], more).select(columns)
    if several:
        held = docs.select(*kept, size.alias("size"), h.alias(work["draw"])).join(limits, F.col(source_col).eqNullSafe(F.col(work["source"])), "left")
        out = out.union(_nearest(held.filter(edge), work).select(columns))
    copies = F.col(work["k"]) + F.col(work["more"])
    return out.select(
        *kept, "size", F.col(work["ss"]).alias("source_size"), F.col(work["target"]).alias("target"), copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, **options).filter(F.col("copies") > 0)
    again = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
