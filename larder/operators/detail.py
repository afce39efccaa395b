"""Product page: offers, price history, sparkline geometry and united facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.facets import bits_to_tags, tag_bits
from larder.operators.ranking import rank_within
from larder.session import kept

TAG_TABLES = {
    "dietary_labels": vocab.DIETARY, "allergens": vocab.ALLERGENS, "sweeteners": vocab.SWEETENERS,
}


def detail_order():
    return [F.col("protein_per_dollar").desc_nulls_last(), F.col("variant_id").asc()]


def product_detail(view: DataFrame, product_id) -> DataFrame:
    """Offers of one product, best first. Markets are shown together here."""
    return view.filter(F.col("product_id") == product_id).orderBy(*detail_order())


def product_detail_rows(view: DataFrame) -> DataFrame:
    """The same for every product at once: ``pos`` is the row's place on its product's page."""
    return rank_within(view, ["product_id"], detail_order())


def history_for_variants(prices: DataFrame, variants: DataFrame) -> DataFrame:
    return prices.join(variants.select("variant_id"), "variant_id", "left_semi")


def product_history(prices: DataFrame, variants: DataFrame, listings: DataFrame) -> DataFrame:
    """Price points with their product: only the two columns a chart needs and the tie-breaks."""
    owners = variants.select("variant_id", "listing_id").join(
        listings.select("listing_id", "product_id"), "listing_id"
    )
    points = prices.select("variant_id", "price_cents", "captured_at", "seq")
    return points.join(owners.drop("listing_id"), "variant_id")


def price_history(history: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Every product's observations in time order, ``pos`` from 1."""
    order = [F.col("captured_at").asc(), F.col("seq").asc(), F.col("variant_id").asc()]
    return rank_within(history, ["product_id"], order, sizes=sizes)


def price_range(history: DataFrame) -> DataFrame:
    return history.groupBy("product_id").agg(
        F.min("price_cents").alias("min_cents"),
        F.max("price_cents").alias("max_cents"),
        F.max(F.struct("captured_at", "seq", "variant_id", "price_cents")).alias("_last"),
        F.count(F.lit(1)).alias("observations"),
    ).select("product_id", "min_cents", "max_cents", F.col("_last.price_cents").alias("latest_cents"),
             "observations")


def series_points(history: DataFrame) -> DataFrame:
    """Sparkline geometry: x in 0..1 by position (0.5 for a single point), y in 0..1 by price
    (0 for a flat series).

    The history is stored once, for its spans and its points. Spans meet the points before these are
    numbered, both by product, so that one shuffle serves the join and the numbering.
    """
    history = kept(history, "history")
    spans = kept(price_range(history).select("product_id", "min_cents", "max_cents", "observations"), "spans")
    sizes = spans.select("product_id", F.col("observations").alias("_n"))
    placed = price_history(history.join(spans, "product_id"), sizes)
    n, low, high = F.col("observations"), F.col("min_cents"), F.col("max_cents")
    span = F.coalesce(F.nullif(high - low, F.lit(0)), F.lit(1))
    return placed.select(
        "product_id", "variant_id", "captured_at", "price_cents", "pos",
        F.when(n == 1, 0.5).otherwise(F.try_divide(F.col("pos") - 1, n - 1)).alias("x"),
        ((F.col("price_cents") - low) / span).alias("y"),
    )


def product_facet_union(view: DataFrame) -> DataFrame:
    """Distinct tags over a product's offers. Tags travel as bit masks, so the aggregate keeps
    three integers per product instead of growing lists."""
    masked = view.select(
        "product_id",
        *[tag_bits(F.col(c), table).alias(c) for c, table in TAG_TABLES.items()],
    )
    united = masked.groupBy("product_id").agg(*[F.bit_or(c).alias(c) for c in TAG_TABLES])
    return united.select(
        "product_id", *[bits_to_tags(F.col(c), table).alias(c) for c, table in TAG_TABLES.items()]
    )


def first_ingredients_text(view: DataFrame) -> DataFrame:
    """First non-empty ingredient text in best-first order, per product."""
    told = view.filter(F.col("ingredients_text").isNotNull() & (F.col("ingredients_text") != ""))
    value = F.col("protein_per_dollar")
    place = F.struct(value.isNull().alias("u"), (-value).alias("k"), "variant_id", "ingredients_text")
    return told.groupBy("product_id").agg(F.min(place).alias("b")).select(
        "product_id", F.col("b.ingredients_text").alias("ingredients_text")
    )


def facet_values(view: DataFrame, column: str) -> DataFrame:
    """Distinct values for a filter bar, per market and sorted."""
    return view.select("market", column).distinct().orderBy("market", column)


def facet_counts(view: DataFrame, column: str) -> DataFrame:
    """Offers per market and tag."""
    return (
        view.select("market", F.explode(column).alias("tag"))
        .groupBy("market", "tag")
        .agg(F.count(F.lit(1)).alias("offers"))
    )
