"""One row per product: its best offer and how many offers and retailers carry it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import filters
from larder.operators.filters import FilterSpec
from larder.operators.metrics import (
    NUTRITION_COLUMNS, OFFER_COLUMNS, VIEW_COLUMNS, attach_product, join_latest_price, listing_metrics, metric_columns, offer_rows,
)
from larder.session import kept
from larder.sources.adapter import Catalog


def rank_struct(spec: FilterSpec, payload: list[str]) -> Column:
    """A struct whose smallest value is the best-ranked row.

    A descending metric is negated; a missing metric sorts last through the leading flag.
    """
    value = F.col(spec.metric_def.column)
    key = -value if spec.descending else value
    return F.struct(
        value.isNull().alias("unknown"), key.alias("key"), "price_cents", "variant_id",
        *[c for c in payload if c not in ("price_cents", "variant_id")],
    )


def best_offer_per_product(offers: DataFrame, spec: FilterSpec) -> DataFrame:
    """Best offer, ``offer_count`` and ``retailer_count`` per product.

    Two aggregates: per (product, retailer), then per product. Both combine on the map side,
    and the first spreads a product that holds a third of all offers over its retailers,
    so no task ever sees a whole product and no distinct set is collected.
    """
    payload = [c for c in offers.columns if c != "product_id"]
    per_retailer = offers.groupBy("product_id", "source_slug").agg(
        F.min(rank_struct(spec, payload)).alias("best"), F.count(F.lit(1)).alias("offers")
    )
    grouped = per_retailer.groupBy("product_id").agg(
        F.min("best").alias("best"),
        F.count(F.lit(1)).alias("retailer_count"),
        F.sum("offers").alias("offer_count"),
    )
    return grouped.select(
        "product_id", *[F.col(f"best.{c}").alias(c) for c in payload], "retailer_count", "offer_count"
    )


def offer_keys(cat, spec: FilterSpec) -> DataFrame:
    """The matching offers with what ranking and counting need and nothing else.

    Nutrition is joined only for a metric made of it, facts only when a filter asks for tags; no
    text, url or name is read. Extra predicates may ask for any column and get the whole offer.
    """
    value = spec.metric_def.column
    keys = list(dict.fromkeys(["product_id", "source_slug", "variant_id", "price_cents", value]))
    if spec.extra:
        return filters.apply(offer_rows(cat), filters.offer_predicates(spec)).select(*keys)
    prices = cat.prices.select("variant_id", "price_cents", "in_stock", "captured_at", "seq")
    offers = join_latest_price(cat.variants.select("variant_id", "listing_id"), prices)
    made = metric_columns()
    if value in made:
        offers = offers.join(cat.nutrition.select("variant_id", *NUTRITION_COLUMNS), "variant_id", "left")
        offers = offers.withColumn(value, made[value])
    asked = {"dietary_labels": spec.dietary, "allergens": spec.allergen_free, "sweeteners": spec.no_artificial}
    tags = [name for name, wanted in asked.items() if wanted]
    if tags:
        offers = offers.join(cat.facts.select("variant_id", *tags), "variant_id", "left")
        offers = offers.withColumns({t: F.coalesce(F.col(t), F.array().cast("array<string>")) for t in tags})
    owners = cat.listings.select("listing_id", "product_id", "source_id")
    sources = cat.sources.select("source_id", F.col("slug").alias("source_slug"), "market")
    joined = offers.join(owners, "listing_id").join(sources, "source_id")
    return filters.apply(joined, filters.offer_predicates(spec)).select(*keys)


def with_names(rows: DataFrame, cat) -> DataFrame:
    """Product and brand names beside rows of one product each."""
    return attach_product(rows, cat).drop("category")


def grid_keys(cat, spec: FilterSpec) -> DataFrame:
    """One row per matching product: its best offer's key, metric and price, and the counts."""
    best = best_offer_per_product(offer_keys(cat, spec), spec)
    wanted = filters.product_predicates(spec)
    return filters.apply(with_names(best, cat), wanted).select(*best.columns) if wanted else best


class _Part(Catalog):
    """A catalog cut down to a few variants, before anything is derived from them."""

    def __init__(self, cat, keys: DataFrame) -> None:
        self.cat, self.keys = cat, keys.select("variant_id")

    def __getattr__(self, name: str) -> DataFrame:
        rows = getattr(self.cat, name)
        if name == "listings":
            return rows.join(F.broadcast(self.variants.select("listing_id")), "listing_id", "left_semi")
        return rows.join(F.broadcast(self.keys), "variant_id", "left_semi") if "variant_id" in rows.columns else rows


def fetch_offers(cat, keys: DataFrame) -> DataFrame:
    """The whole view rows of ``keys`` (``variant_id`` and columns of its own), which are no more than a page.

    The page is stored first: every table is cut down to it, and none of them ranks the offers again.
    """
    keys = kept(keys, "page")
    view = listing_metrics(_Part(cat, keys))
    return view.join(F.broadcast(keys.select("variant_id", *[c for c in keys.columns if c not in view.columns])), "variant_id")


def grouped_listings(cat, spec: FilterSpec) -> DataFrame:
    """The comparison grid, unpaged and unordered.

    Offer-level filters run before grouping. Product-level filters keep or drop whole
    products, so the product and brand tables are joined at product grain, after the data has
    shrunk from offers to products.
    """
    offers = filters.apply(offer_rows(cat), filters.offer_predicates(spec))
    best = attach_product(best_offer_per_product(offers, spec), cat)
    shown = filters.apply(best, filters.product_predicates(spec))
    return shown.select(*VIEW_COLUMNS, "retailer_count", "offer_count")


def product_counts(offers: DataFrame) -> DataFrame:
    """Offers and retailers per product, without the offers themselves."""
    per_retailer = offers.groupBy("product_id", "source_slug").agg(F.count(F.lit(1)).alias("offers"))
    return per_retailer.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("retailer_count"), F.sum("offers").alias("offer_count")
    )


def product_total(offers: DataFrame) -> DataFrame:
    return offers.select("product_id").distinct().agg(F.count(F.lit(1)).alias("total"))


__all__ = ["OFFER_COLUMNS", "best_offer_per_product", "fetch_offers", "grid_keys", "grouped_listings", "offer_keys",
           "product_counts", "product_total", "with_names"]
