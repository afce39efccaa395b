"""Idempotent writers: merge a batch into a table by natural key, with a policy per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UpsertPolicy:
    """``update`` columns take the newest incoming value, nulls included. ``keep`` columns are set
    on insert and never touched again. ``latest`` and ``earliest`` take the max / min."""

    key: tuple[str, ...]
    update: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    latest: tuple[str, ...] = ()
    earliest: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.key, *self.update, *self.keep, *self.latest, *self.earliest]


POLICIES = {
    "sources": UpsertPolicy(("slug",), ("name", "base_url", "market", "enabled"), ("type",)),
    "brands": UpsertPolicy(("slug",), ("name",)),
    "products": UpsertPolicy(("dedup_key",), ("name", "category"), ("brand_id",)),
    "listings": UpsertPolicy(
        ("source_id", "source_sku"), ("url", "title", "raw_payload", "product_id"),
        latest=("last_seen_at",), earliest=("first_seen_at",),
    ),
    "variants": UpsertPolicy(
        ("listing_id", "source_variant_id"),
        ("flavor", "size_g", "size_label", "upc", "compare_at_price_cents"),
    ),
    "nutrition": UpsertPolicy(
        ("variant_id",),
        ("serving_size_g", "servings_per_container", "protein_g", "fat_g", "carb_g", "sugar_g",
         "calories_kcal", "confidence", "extraction_method"),
    ),
    "facts": UpsertPolicy(
        ("variant_id",), ("ingredients_text", "dietary_labels", "allergens", "sweeteners")
    ),
}


def fold_batch(incoming: DataFrame, policy: UpsertPolicy, seq: str = "seq") -> DataFrame:
    """One row per key: the newest update values and the first insert values of the batch.

    All of it is one aggregate with map-side combine, so many copies of one key cost one
    row per task in the shuffle.
    """
    aggs = []
    if policy.update:
        aggs.append(F.max(F.struct(seq, *policy.update)).alias("_new"))
    if policy.keep:
        aggs.append(F.min(F.struct(seq, *policy.keep)).alias("_first"))
    aggs += [F.max(c).alias(c) for c in policy.latest] + [F.min(c).alias(c) for c in policy.earliest]
    folded = incoming.groupBy(*policy.key).agg(*aggs)
    return folded.select(
        *policy.key,
        *[F.col(f"_new.{c}").alias(c) for c in policy.update],
        *[F.col(f"_first.{c}").alias(c) for c in policy.keep],
        *policy.latest,
        *policy.earliest,
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, policy: UpsertPolicy, seq: str = "seq"
) -> DataFrame:
    """The table after the batch. Running the same batch twice changes nothing more."""
    old = existing.select(*policy.columns).withColumn("_old", F.lit(True)).alias("o")
    new = fold_batch(incoming, policy, seq).withColumn("_in", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in policy.key]
    joined = old.join(new, on, "full_outer")
    arrived, known = F.col("n._in").isNotNull(), F.col("o._old").isNotNull()
    pick = lambda c, cond, a, b: F.when(cond, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(c)
    return joined.select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in policy.key],
        *[pick(c, arrived, "n", "o") for c in policy.update],
        *[pick(c, known, "o", "n") for c in policy.keep],
        *[F.greatest(f"o.{c}", f"n.{c}").alias(c) for c in policy.latest],
        *[F.least(f"o.{c}", f"n.{c}").alias(c) for c in policy.earliest],
    )


def append_price_observations(observations: DataFrame, path: str) -> None:
    """Append to the history, one folder per capture month so that readers can prune by time.

    Rows are range partitioned by (month, key) first: each task writes few folders, and a busy
    month is spread over several tasks.
    """
    dated = observations.withColumn("captured_month", F.trunc("captured_at", "month"))
    spread = dated.repartitionByRange("captured_month", F.xxhash64("variant_id"))
    spread.write.mode("append").partitionBy("captured_month").parquet(path)


def append_issues(issues: DataFrame, path: str, run: str) -> None:
    """Append the issues of one run, by stage; a run that is written again replaces its own."""
    issues.write.mode("overwrite").partitionBy("stage").parquet(f"{path}/run={run}")


def expire_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent still exists (a cascading delete)."""
    return child.join(parent.select(key).distinct(), key, "left_semi")


def forget_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keep every row, but forget a parent that no longer exists (set null on delete)."""
    alive = parent.select(key).distinct().withColumn("_alive", F.lit(True))
    return (
        child.join(alive, key, "left")
        .withColumn(key, F.when(F.col("_alive"), F.col(key)))
        .drop("_alive")
    )
