"""Metrics and validation rules as SQL functions, and the catalog as views, for queries in plain SQL.

The functions are SQL expressions that the optimizer inlines, so a query written with them has the
plan of one written with the columns they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.functions import vocab
from larder.operators.filters import FilterSpec
from larder.operators.ranking import PAGE_SIZE
from larder.sources.adapter import StarCatalog

# name: (arguments, result, expression)
METRIC_FUNCTIONS = {
    "total_protein": ("servings DOUBLE, protein DOUBLE", "DOUBLE", "servings * protein"),
    "protein_per_dollar": ("total DOUBLE, cents INT", "DOUBLE", "CASE WHEN cents > 0 THEN total / (cents / 100.0D) END"),
    "cost_per_30g": ("total DOUBLE, cents INT", "DOUBLE", "CASE WHEN total > 0 THEN (cents / 100.0D) / (total / 30.0D) END"),
    "ratio": ("numerator DOUBLE, denominator DOUBLE", "DOUBLE", "CASE WHEN denominator > 0 THEN numerator / denominator END"),
    "price_per_serving": ("cents INT, servings DOUBLE", "DOUBLE", "CASE WHEN servings > 0 THEN (cents / 100.0D) / servings END"),
    "sale_percent": (
        "cents INT, compare_at INT", "INT",
        "CASE WHEN compare_at > cents THEN CAST(floor((1.0D - cents / CAST(compare_at AS DOUBLE)) * 100.0D + 0.5D) AS INT) END"),
}
RULE_FUNCTIONS = {
    "rule_required": ("protein DOUBLE, servings DOUBLE", "BOOLEAN", "protein IS NULL OR servings IS NULL"),
    "rule_protein_le_serving": ("protein DOUBLE, serving_size DOUBLE", "BOOLEAN", "protein > serving_size"),
    "rule_min_servings": ("servings DOUBLE", "BOOLEAN", f"servings < {vocab.MIN_SERVINGS}"),
    "rule_implied_serving": (
        "size DOUBLE, servings DOUBLE", "BOOLEAN", f"servings > 0 AND try_divide(size, servings) > {vocab.MAX_IMPLIED_SERVING_G}"),
    "rule_serving_range": (
        "serving_size DOUBLE", "BOOLEAN", f"serving_size NOT BETWEEN {vocab.SERVING_SIZE_MIN_G} AND {vocab.SERVING_SIZE_MAX_G}"),
    "rule_servings_range": ("servings DOUBLE", "BOOLEAN", f"servings NOT BETWEEN {vocab.SERVINGS_MIN} AND {vocab.SERVINGS_MAX}"),
    "rule_atwater": (
        "kcal DOUBLE, protein DOUBLE, carb DOUBLE, fat DOUBLE", "BOOLEAN",
        f"kcal > 0 AND try_divide(abs(kcal - (4.0D * protein + 4.0D * carb + 9.0D * fat)), kcal) > {vocab.CALORIE_TOLERANCE}"),
    "rule_container_math": (
        "size DOUBLE, serving_size DOUBLE, servings DOUBLE", "BOOLEAN",
        f"size > 0 AND try_divide(abs(serving_size * servings - size), size) > {vocab.CONTAINER_TOLERANCE}"),
}
TABLES = ("sources", "brands", "products", "listings", "variants", "nutrition", "facts", "prices")


def register(spark: SparkSession, cat=None, prefix: str = "") -> None:
    """Creates the functions for the session, and a view per catalog table where one is given."""
    for name, (arguments, result, body) in (METRIC_FUNCTIONS | RULE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    if cat is not None:
        for name in TABLES:
            getattr(cat, name).createOrReplaceTempView(f"{prefix}{name}")


# The first page of the grid: latest price, metric, best offer per product, rank.
GRID_PAGE = """
WITH latest AS (
  SELECT variant_id, max(struct(captured_at, seq, price_cents)).price_cents AS price_cents
  FROM {p}prices GROUP BY variant_id),
offers AS (
  SELECT l.product_id, s.slug AS source_slug, v.variant_id, lp.price_cents,
         protein_per_dollar(total_protein(n.servings_per_container, n.protein_g), lp.price_cents) AS protein_per_dollar
  FROM {p}variants v JOIN latest lp ON lp.variant_id = v.variant_id LEFT JOIN {p}nutrition n ON n.variant_id = v.variant_id
  JOIN {p}listings l ON l.listing_id = v.listing_id JOIN {p}sources s ON s.source_id = l.source_id
  WHERE s.market = '{market}'),
per_retailer AS (
  SELECT product_id, source_slug, count(*) AS offers,
         min(struct(-protein_per_dollar AS worth, price_cents, variant_id, protein_per_dollar)) AS best
  FROM offers WHERE protein_per_dollar IS NOT NULL GROUP BY product_id, source_slug),
grid AS (
  SELECT product_id, min(best) AS best, count(*) AS retailer_count, sum(offers) AS offer_count
  FROM per_retailer GROUP BY product_id),
page AS (
  SELECT product_id, best.*, retailer_count, offer_count FROM grid
  ORDER BY best.protein_per_dollar DESC, best.price_cents, best.variant_id LIMIT {size})
SELECT g.product_id, g.variant_id, b.name AS brand_name, p.name AS product_name, g.price_cents, g.retailer_count, g.offer_count,
       g.protein_per_dollar
FROM page g JOIN {p}products p ON p.product_id = g.product_id JOIN {p}brands b ON b.brand_id = p.brand_id
"""

RULES = """
SELECT variant_id, rule_required(protein_g, servings_per_container) AS missing,
       coalesce(rule_protein_le_serving(protein_g, serving_size_g), false) AS protein_over,
       coalesce(rule_min_servings(servings_per_container), false) AS few_servings,
       coalesce(rule_implied_serving(size_g, servings_per_container), false) AS implied,
       coalesce(rule_serving_range(serving_size_g), false) AS serving_odd,
       coalesce(rule_servings_range(servings_per_container), false) AS servings_odd,
       coalesce(rule_atwater(calories_kcal, protein_g, carb_g, fat_g), false) AS calories_off,
       coalesce(rule_container_math(size_g, serving_size_g, servings_per_container), false) AS container_off
FROM {p}candidates
"""


def grid_page_sql(cat: StarCatalog, spec: FilterSpec) -> DataFrame:
    register(cat.spark, cat, "shop_")
    return cat.spark.sql(GRID_PAGE.format(p="shop_", market=spec.market, size=PAGE_SIZE))


def rules_sql(cat: StarCatalog) -> DataFrame:
    register(cat.spark)
    cat.nutrition_candidates.createOrReplaceTempView("shop_candidates")
    return cat.spark.sql(RULES.format(p="shop_"))


def sale_sql(cat: StarCatalog) -> DataFrame:
    register(cat.spark, cat, "shop_")
    return cat.spark.sql(
        "SELECT v.variant_id, lp.price_cents, v.compare_at_price_cents, sale_percent(lp.price_cents, v.compare_at_price_cents) AS sale_percent "
        "FROM shop_variants v JOIN (SELECT variant_id, max(struct(captured_at, seq, price_cents)).price_cents AS price_cents FROM shop_prices GROUP BY variant_id) lp "
        "ON lp.variant_id = v.variant_id")


QUERIES = {
    "page_listings_sql": lambda cat: grid_page_sql(cat, FilterSpec(market="UK")),
    "validate_rules_sql": rules_sql,
    "sale_percent_sql": sale_sql,
}

