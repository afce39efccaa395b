"""Which product a listing belongs to: by barcode first, else by the canonical name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.components import connected


def upc_to_product(variants: DataFrame, listings: DataFrame) -> DataFrame:
    """Smallest product id per barcode."""
    coded = variants.filter(F.col("upc").isNotNull()).select("listing_id", "upc")
    return (
        coded.join(listings.select("listing_id", "product_id"), "listing_id")
        .groupBy("upc")
        .agg(F.min("product_id").alias("product_id"))
    )


def resolve_products(offers: DataFrame, known_upcs: DataFrame) -> DataFrame:
    """Adds ``product_key`` and ``by_existing_upc`` to incoming offers (columns ``listing_id``,
    ``position``, ``upc``, ``dedup_key`` and any others); a listing's offers all get the same.

    The first of a listing's barcodes, by position, that an existing product has decides. Without
    one, listings that share a barcode take the smallest name key among them, by their first
    barcode, and the rest their own: the ``dedup_key`` of their first offer. One pass: chains of
    barcodes are not followed.

    Barcodes are reduced to one row before they meet the offers again; of a barcode that many
    offers carry only that side is heavy, and adaptive execution splits it. Offers without one never enter the join.
    """
    names = offers.groupBy("listing_id").agg(F.min_by("dedup_key", "position").alias("_own"))
    coded = offers.filter(F.col("upc").isNotNull() & (F.col("upc") != "")).select("listing_id", "position", "upc")
    coded = coded.join(names, "listing_id")
    shared = coded.groupBy("upc").agg(F.min("_own").alias("_shared"))
    existing = known_upcs.groupBy("upc").agg(F.min("product_key").alias("_known"))
    hits = coded.join(shared.join(existing, "upc", "left"), "upc")
    known_at = F.when(F.col("_known").isNotNull(), F.col("position"))
    picked = hits.groupBy("listing_id").agg(
        F.min_by("_known", known_at).alias("_known"), F.min_by("_shared", "position").alias("_shared")
    )
    decided = names.join(picked, "listing_id", "left")
    return offers.join(decided, "listing_id", "left").select(
        *offers.columns, F.coalesce("_known", "_shared", "_own", "dedup_key").alias("product_key"),
        F.col("_known").isNotNull().alias("by_existing_upc"),
    )


def resolve_chains(offers: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``product_key`` and ``existing`` to incoming offers (columns ``listing_id``,
    ``position``, ``upc``, ``dedup_key`` and any others), following chains of any length.

    Barcodes and name keys are the two sides of a graph. A listing, named by its first offer's
    ``dedup_key``, ties that name to each of its barcodes; ``known`` (``product_key``, ``upc``, null
    for a product without one) ties existing products to theirs. A component is one product: its
    least existing product, else its least name. Listings enter the graph as distinct pairs, so
    a barcode or name that very many offers carry is one edge.
    """
    names = offers.groupBy("listing_id").agg(F.min_by("dedup_key", "position").alias("_own"))
    coded = offers.filter(F.col("upc").isNotNull() & (F.col("upc") != "")).select("listing_id", "upc").distinct()
    pairs = coded.join(names, "listing_id").select("upc", F.col("_own").alias("key"))
    tied = known.filter(F.col("upc").isNotNull() & (F.col("upc") != "")).select("upc", F.col("product_key").alias("key"))
    edges = pairs.union(tied).distinct()
    # the two kinds of node never meet: one letter before each
    node = connected(edges.select(F.concat(F.lit("k"), "key").alias("a"), F.concat(F.lit("u"), "upc").alias("b")))
    roots = node.filter(F.col("node").startswith("k")).select(F.expr("substring(node, 2)").alias("_own"), "root")
    old = known.select(F.col("product_key").alias("_own")).distinct().withColumn("_old", F.lit(True))
    keys = names.select("_own").union(old.select("_own")).distinct().join(roots, "_own", "left").join(old, "_own", "left")
    keys = keys.select("_own", F.coalesce("root", F.concat(F.lit("k"), "_own")).alias("root"), F.col("_old").isNull().alias("_new"))
    best = keys.groupBy("root").agg(F.min(F.struct("_new", "_own")).alias("_best"))
    named = keys.join(best, "root").select("_own", F.col("_best._own").alias("product_key"), (~F.col("_best._new")).alias("existing"))
    decided = names.join(named, "_own").select("listing_id", "product_key", "existing")
    return offers.join(decided, "listing_id").select(*offers.columns, "product_key", "existing")
