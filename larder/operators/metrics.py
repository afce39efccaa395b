"""Derived metrics and the listing view: one row per variant that has a price."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.facets import empty_tags


@dataclass(frozen=True)
class MetricDef:
    """A rankable column. ``needs_nutrition`` drops rows without the value before ranking."""

    key: str
    column: str
    higher_is_better: bool
    needs_nutrition: bool = True


METRICS: dict[str, MetricDef] = {}


def register_metric(metric: MetricDef) -> None:
    METRICS[metric.key] = metric


# The metrics and which direction is better.
for _metric in [
    MetricDef("proteinPerDollar", "protein_per_dollar", True),
    MetricDef("costPer30gProtein", "cost_per_30g_protein", False),
    MetricDef("pricePerServing", "price_per_serving", False),
    MetricDef("proteinPctWeight", "protein_pct_weight", True),
    MetricDef("fatPerProtein", "fat_per_protein", False),
    MetricDef("caloriesPerProtein", "calories_per_protein", False),
    MetricDef("totalProteinG", "total_protein_g", True),
    MetricDef("priceCents", "price_cents", False, needs_nutrition=False),
]:
    register_metric(_metric)
DEFAULT_METRIC = "proteinPerDollar"


def metric(key: str | None) -> MetricDef:
    """The metric by key; unknown keys mean the default one."""
    return METRICS.get(key or "", METRICS[DEFAULT_METRIC])


def total_protein(servings: Column, protein: Column) -> Column:
    return servings * protein


def price(cents: Column) -> Column:
    return cents / F.lit(100.0)


def protein_per_dollar(total: Column, cents: Column) -> Column:
    return F.when(cents > 0, total / price(cents))


def cost_per_30g(total: Column, cents: Column) -> Column:
    return F.when(total > 0, price(cents) / (total / F.lit(30.0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def protein_per_calorie(protein: Column, calories: Column) -> Column:
    return F.when(calories != 0, protein / calories)


def sale_percent(cents: Column, compare_at: Column) -> Column:
    """Whole percent off a genuine markdown; halves round up."""
    off = (F.lit(1.0) - cents / compare_at.cast("double")) * 100.0
    return F.when(compare_at > cents, F.floor(off + 0.5).cast("int"))


def genuine_markdown(compare_at: Column, cents: Column) -> Column:
    return F.when(compare_at > cents, compare_at)


def metric_columns() -> dict[str, Column]:
    servings, protein = F.col("servings_per_container"), F.col("protein_g")
    total = total_protein(servings, protein)
    cents = F.col("price_cents")
    return {
        "total_protein_g": total,
        "protein_per_dollar": protein_per_dollar(total, cents),
        "cost_per_30g_protein": cost_per_30g(total, cents),
        "protein_pct_weight": ratio(protein, F.col("serving_size_g")),
        "fat_per_protein": ratio(F.col("fat_g"), protein),
        "calories_per_protein": ratio(F.col("calories_kcal"), protein),
        "price_per_serving": ratio(price(cents), servings),
    }


def latest_price(observations: DataFrame, key: str = "variant_id") -> DataFrame:
    """The last observation per key.

    One aggregate of the greatest (time, sequence, row): map tasks keep a single candidate per key,
    so a key with a third of all rows sends one row per task through the shuffle.
    """
    rest = [c for c in observations.columns if c not in (key, "captured_at", "seq")]
    return (
        observations.groupBy(key)
        .agg(F.max(F.struct("captured_at", "seq", *rest)).alias("last"))
        .select(key, *[F.col(f"last.{c}").alias(c) for c in [*rest, "captured_at"]])
    )


NUTRITION_COLUMNS = [
    "serving_size_g", "servings_per_container", "protein_g", "fat_g", "carb_g", "calories_kcal",
]
OFFER_COLUMNS = [
    "variant_id", "listing_id", "product_id", "source_id", "source_slug", "source_type", "market",
    "flavor", "size_g", "url", "price_cents", "currency", "in_stock", "captured_at",
    "compare_at_price_cents", *NUTRITION_COLUMNS, "confidence", "ingredients_text",
    "dietary_labels", "allergens", "sweeteners", "total_protein_g", "protein_per_dollar",
    "cost_per_30g_protein", "protein_pct_weight", "fat_per_protein", "calories_per_protein",
    "price_per_serving",
]
VIEW_COLUMNS = [
    *OFFER_COLUMNS[:7], "brand_name", "product_name", "category", *OFFER_COLUMNS[7:],
]


def coalesce_defaults(df: DataFrame) -> DataFrame:
    """Unknown confidence is 0; unknown tags are empty lists."""
    return df.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            **{
                name: F.coalesce(F.col(name), empty_tags())
                for name in ("dietary_labels", "allergens", "sweeteners")
            },
        }
    )


def join_latest_price(variants: DataFrame, prices: DataFrame) -> DataFrame:
    return variants.join(latest_price(prices), "variant_id")


def join_optional_nutrition(df: DataFrame, nutrition: DataFrame) -> DataFrame:
    kept = nutrition.select("variant_id", *NUTRITION_COLUMNS, "confidence")
    return df.join(kept, "variant_id", "left")


def join_optional_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    return df.join(facts, "variant_id", "left")


def offer_rows(cat) -> DataFrame:
    """Offers with every offer-level column, before product and brand names are attached.

    Variant-keyed sides are joined first while they share one partitioning. Ranking works on
    these rows and meets the product tables only after grouping to one row per product.
    """
    return _offers(cat, cat.listings.select("listing_id", "product_id", "source_id", "url")).select(*OFFER_COLUMNS)


def _offers(cat, listings: DataFrame) -> DataFrame:
    offers = join_latest_price(cat.variants, cat.prices)
    offers = join_optional_facts(join_optional_nutrition(offers, cat.nutrition), cat.facts)
    sources = cat.sources.select(
        "source_id", F.col("slug").alias("source_slug"), F.col("type").alias("source_type"), "market"
    )
    joined = offers.join(listings, "listing_id").join(sources, "source_id")
    return coalesce_defaults(joined).withColumns(metric_columns())


def attach_product(df: DataFrame, cat) -> DataFrame:
    """Product and brand names; both are inner joins on foreign keys."""
    products = cat.products.select(
        "product_id", "brand_id", F.col("name").alias("product_name"), "category"
    )
    brands = cat.brands.select("brand_id", F.col("name").alias("brand_name"))
    return df.join(products.join(brands, "brand_id").drop("brand_id"), "product_id")


def listing_metrics(cat) -> DataFrame:
    """The view. Names meet the listings, a few keys a row, and these meet the offers: no whole offer is shuffled by product."""
    named = attach_product(cat.listings.select("listing_id", "product_id", "source_id", "url"), cat)
    return _offers(cat, named).select(*VIEW_COLUMNS)


def join_catalog_dims(cat) -> DataFrame:
    """Variants with their listing, product, brand and source."""
    variants = cat.variants.select("variant_id", "listing_id", "flavor", "size_g")
    listings = cat.listings.select("listing_id", "product_id", "source_id", "url")
    sources = cat.sources.select("source_id", F.col("slug").alias("source_slug"), "market")
    joined = variants.join(listings, "listing_id").join(sources, "source_id")
    return attach_product(joined, cat)
