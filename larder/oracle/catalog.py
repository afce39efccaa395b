"""Checking SQL for the catalog queries."""

from __future__ import annotations

from larder.oracle.prefix import joined, with_catalog

# Metric column, higher is better, needs nutrition.
METRICS = [
    ("protein_per_dollar", True, True), ("cost_per_30g_protein", False, True),
    ("price_per_serving", False, True), ("protein_pct_weight", True, True),
    ("fat_per_protein", False, True), ("calories_per_protein", False, True),
    ("total_protein_g", True, True), ("price_cents", False, False),
]
TAGS = ("dietary_labels", "allergens", "sweeteners")
TAG_TEXT = ", ".join(f"{joined(c)} AS {c}" for c in TAGS)
SEQ = "l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax"


def metric(column: str) -> str:
    return with_catalog(f"SELECT variant_id, {column} FROM offers")


def filtered(condition: str, *columns: str) -> str:
    picked = ", ".join(f"{joined(c)} AS {c}" if c in TAGS else c for c in columns)
    return with_catalog(f"SELECT variant_id, {picked} FROM offers WHERE {condition}")


def grid(market: str, column: str, descending: bool, needs: bool) -> str:
    known = f" AND {column} IS NOT NULL" if needs else ""
    order = f"{column} {'DESC' if descending else 'ASC'} NULLS LAST, price_cents, variant_id"
    return (
        f"matching AS (SELECT * FROM offers WHERE market = '{market}'{known}),\n"
        f"counts AS (SELECT product_id, count(DISTINCT source_slug) AS retailer_count, count(*) AS offer_count FROM matching GROUP BY 1),\n"
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS rn FROM matching) WHERE rn = 1),\n"
        f"grid AS (SELECT b.*, c.retailer_count, c.offer_count, row_number() OVER (ORDER BY {order}) AS rank FROM best b JOIN counts c USING (product_id))"
    )


PAGE = "product_id, variant_id, brand_name, product_name, price_cents, retailer_count, offer_count"
FULL_MATCH = (
    "market = 'US' AND in_stock AND price_cents <= 8000 AND protein_per_dollar IS NOT NULL AND NOT list_has_any(allergens, ['soy']) "
    "AND NOT list_has_any(sweeteners, ['sucralose', 'aspartame', 'acesulfame_k', 'saccharin']) "
    "AND brand_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') "
    "AND (contains(lower(product_name), 'ring') OR contains(lower(brand_name), 'ring'))"
)
FULL = (
    f"matching AS (SELECT * FROM offers WHERE {FULL_MATCH}),\n"
    "counts AS (SELECT product_id, count(DISTINCT source_slug) AS retailer_count, count(*) AS offer_count FROM matching GROUP BY 1),\n"
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY protein_per_dollar DESC, price_cents, variant_id) AS rn FROM matching) WHERE rn = 1),\n"
    "grid AS (SELECT b.*, c.retailer_count, c.offer_count, row_number() OVER (ORDER BY protein_per_dollar DESC, price_cents, variant_id) AS rank FROM best b JOIN counts c USING (product_id))"
)
US = grid("US", "protein_per_dollar", True, True)
UK = grid("UK", "protein_per_dollar", True, True)
US_MATCH = "SELECT * FROM offers WHERE market = 'US' AND protein_per_dollar IS NOT NULL"


def rank_all(column: str, better: bool, needs: bool, order: str) -> str:
    descending = better if order == "best" else not better
    extra = "" if column == "price_cents" else f", {column}"
    return with_catalog(
        f"SELECT {PAGE}{extra}, rank FROM grid", grid("US", column, descending, needs)
    )


POSITIONED = (
    "placed AS (SELECT product_id, variant_id, captured_at, price_cents, "
    f"row_number() OVER (PARTITION BY product_id ORDER BY captured_at, {SEQ}, variant_id) AS pos, "
    "count(*) OVER (PARTITION BY product_id) AS n, min(price_cents) OVER (PARTITION BY product_id) AS lo, "
    "max(price_cents) OVER (PARTITION BY product_id) AS hi FROM prices)"
)

ORACLE: dict[str, str] = {
    "listing_metrics": with_catalog(
        f"SELECT * REPLACE ({TAG_TEXT}) FROM offers"
    ),
    "listing_metrics_refresh": with_catalog(f"SELECT * REPLACE ({TAG_TEXT}) FROM offers"),
    "search_trigrams": with_catalog(
        "SELECT product_id, p.name AS product_name, b.name AS brand_name FROM products p JOIN brands b USING (brand_id) WHERE contains(lower(p.name), 'ring') OR contains(lower(b.name), 'ring')"
    ),
    "search_trigram_candidates": with_catalog(
        "SELECT count(*) FILTER (WHERE (contains(lower(p.name), 'rin') OR contains(lower(b.name), 'rin')) AND (contains(lower(p.name), 'ing') OR contains(lower(b.name), 'ing'))) AS candidates, "
        "count(*) AS products FROM products p JOIN brands b USING (brand_id)"
    ),
    "read_catalog_table": with_catalog(
        "SELECT DISTINCT brand_id, category FROM products WHERE contains(name, 'ring')"
    ),
    "metric_total_protein": metric("total_protein_g"),
    "metric_protein_per_dollar": metric("protein_per_dollar"),
    "metric_cost_per_30g": metric("cost_per_30g_protein"),
    "metric_protein_pct_weight": metric("protein_pct_weight"),
    "metric_fat_per_protein": metric("fat_per_protein"),
    "metric_calories_per_protein": metric("calories_per_protein"),
    "metric_price_per_serving": metric("price_per_serving"),
    "metric_protein_per_cal": with_catalog(
        "SELECT variant_id, CASE WHEN calories_kcal <> 0 THEN protein_g / calories_kcal END AS protein_per_cal FROM nutrition"
    ),
    "sale_percent": with_catalog(
        "SELECT variant_id, price_cents, compare_at_price_cents, CASE WHEN compare_at_price_cents > price_cents THEN "
        "CAST(floor((1.0::double - price_cents / compare_at_price_cents::double) * 100.0::double + 0.5::double) AS INTEGER) END AS sale_percent FROM offers"
    ),
    "genuine_markdown": with_catalog(
        "SELECT variant_id, CASE WHEN compare_at_price_cents > price_cents THEN compare_at_price_cents END AS markdown_from_cents FROM offers"
    ),
    "coalesce_defaults": with_catalog(f"SELECT variant_id, confidence, {TAG_TEXT} FROM offers"),
    "column_pruned_history": with_catalog("SELECT price_cents, captured_at FROM prices"),
    "filter_market": filtered("market = 'US'", "market"),
    "filter_market_uk": filtered("market = 'UK'", "market"),
    "filter_market_in": filtered("market = 'IN'", "market"),
    "filter_in_stock": filtered("in_stock", "in_stock"),
    "filter_brands": filtered("brand_name IN ('Brand#2', 'Brand#17')", "brand_name"),
    "filter_sources": filtered(
        "source_slug IN ('supplier-000000001', 'supplier-000000002', 'supplier-000000007')", "source_slug"
    ),
    "filter_max_price": filtered("price_cents <= 5000", "price_cents"),
    "search_text": filtered(
        "contains(lower(product_name), 'ring') OR contains(lower(brand_name), 'ring')", "product_name", "brand_name"
    ),
    "filter_metric_known": filtered("protein_per_dollar IS NOT NULL", "protein_per_dollar"),
    "filter_has_every": filtered("list_has_all(dietary_labels, ['vegan', 'keto'])", "dietary_labels"),
    "filter_allergen_free": filtered("NOT list_has_any(allergens, ['soy'])", "allergens"),
    "filter_no_artificial": filtered(
        "NOT list_has_any(sweeteners, ['sucralose', 'aspartame', 'acesulfame_k', 'saccharin'])", "sweeteners"
    ),
    "compose_filters": with_catalog(
        "SELECT variant_id, product_id, brand_name, product_name, price_cents, protein_per_dollar FROM offers "
        "WHERE market = 'US' AND in_stock AND brand_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') "
        "AND price_cents <= 8000 AND (contains(lower(product_name), 'ring') OR contains(lower(brand_name), 'ring')) "
        "AND protein_per_dollar IS NOT NULL AND NOT list_has_any(allergens, ['soy']) "
        "AND NOT list_has_any(sweeteners, ['sucralose', 'aspartame', 'acesulfame_k', 'saccharin'])"
    ),
    "join_catalog_dims": with_catalog(
        "SELECT variant_id, listing_id, flavor, size_g, product_id, source_id, url, source_slug, market, brand_name, product_name, category FROM offers"
    ),
    "join_latest_price": with_catalog(
        "SELECT variant_id, flavor, size_g, price_cents, currency, in_stock, captured_at FROM offers"
    ),
    "join_optional_nutrition": with_catalog(
        "SELECT v.variant_id, serving_size_g, servings_per_container, protein_g, fat_g, carb_g, calories_kcal, confidence FROM variants v LEFT JOIN nutrition n ON n.variant_id = v.variant_id"
    ),
    "join_optional_facts": with_catalog(
        "SELECT v.variant_id, ingredients_text_ AS ingredients_text, array_to_string(dietary_labels, ',') AS dietary_labels, "
        "array_to_string(allergens, ',') AS allergens, array_to_string(sweeteners, ',') AS sweeteners FROM variants v LEFT JOIN facts f ON f.variant_id = v.variant_id"
    ),
    "upc_to_product": with_catalog(
        "SELECT upc, min(product_id) AS product_id FROM variants JOIN listings USING (listing_id) WHERE upc IS NOT NULL GROUP BY upc"
    ),
    "variants_missing_nutrition": with_catalog(
        "SELECT variant_id, upc, size_g FROM variants WHERE upc IS NOT NULL AND variant_id NOT IN (SELECT variant_id FROM nutrition)"
    ),
    "variants_missing_facts": with_catalog(
        "SELECT variant_id, upc FROM variants WHERE upc IS NOT NULL AND variant_id NOT IN (SELECT variant_id FROM facts)"
    ),
    "enrichment_batch": with_catalog(
        "SELECT variant_id, upc, size_g FROM variants WHERE upc IS NOT NULL AND variant_id NOT IN (SELECT variant_id FROM nutrition)"
    ),
    "history_for_variants": with_catalog(
        "SELECT variant_id, price_cents, captured_at FROM prices WHERE variant_id IN (SELECT variant_id FROM variants WHERE flavor = 'Vanilla')"
    ),
    "latest_price": with_catalog("SELECT * FROM latest"),
    "best_offer_per_product": with_catalog(f"SELECT {PAGE}, protein_per_dollar FROM grid", US),
    "retailer_count": with_catalog(
        f"SELECT product_id, count(DISTINCT source_slug) AS retailer_count FROM ({US_MATCH}) GROUP BY 1"
    ),
    "offer_count": with_catalog(f"SELECT product_id, count(*) AS offer_count FROM ({US_MATCH}) GROUP BY 1"),
    "product_total": with_catalog(f"SELECT count(DISTINCT product_id) AS total FROM ({US_MATCH})"),
    "facet_brands": with_catalog("SELECT DISTINCT market, brand_name FROM offers"),
    "facet_sources": with_catalog("SELECT DISTINCT market, source_slug FROM offers"),
    "facet_counts": with_catalog(
        "SELECT market, tag, count(*) AS offers FROM (SELECT market, unnest(dietary_labels) AS tag FROM offers) GROUP BY 1, 2"
    ),
    "product_facet_union": with_catalog(
        "SELECT product_id, "
        + ", ".join(
            f"coalesce(array_to_string(list_sort(list_distinct(flatten(list({c})))), ','), '') AS {c}" for c in TAGS
        )
        + " FROM offers GROUP BY product_id"
    ),
    "first_ingredients_text": with_catalog(
        "SELECT product_id, ingredients_text FROM (SELECT product_id, ingredients_text, row_number() OVER "
        "(PARTITION BY product_id ORDER BY protein_per_dollar DESC NULLS LAST, variant_id) AS rn FROM offers "
        "WHERE ingredients_text <> '') WHERE rn = 1"
    ),
    "price_range": with_catalog(
        "SELECT product_id, min(price_cents) AS min_cents, max(price_cents) AS max_cents, "
        f"max(CASE WHEN rn = 1 THEN price_cents END) AS latest_cents, count(*) AS observations FROM (SELECT *, row_number() OVER "
        "(PARTITION BY product_id ORDER BY captured_at DESC, " + ", ".join(f"{c} DESC" for c in SEQ.split(", "))
        + ", variant_id DESC) AS rn FROM prices) GROUP BY product_id"
    ),
    "run_stats": with_catalog(
        "SELECT source_id, CAST(sum(a) AS BIGINT) AS sources, CAST(sum(b) AS BIGINT) AS products, CAST(sum(c) AS BIGINT) AS variants, "
        "CAST(sum(d) AS BIGINT) AS prices, CAST(sum(e) AS BIGINT) AS nutrition_ok, CAST(sum(f) AS BIGINT) AS issues FROM ("
        "SELECT source_id, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS f FROM sources WHERE coalesce(enabled, true) "
        "UNION ALL SELECT sk, 0, 1, 1, 0, 0, 0 FROM keys UNION ALL SELECT l_suppkey, 0, 0, 0, 1, 0, 0 FROM lineitem "
        "UNION ALL SELECT sk, 0, 0, 0, 0, CAST(ok AS INT), CAST(len(errors) + len(warnings) > 0 AS INT) FROM checked) "
        "GROUP BY GROUPING SETS ((source_id), ())"
    ),
    "rank_offers": with_catalog("SELECT product_id, variant_id, rank FROM grid", US),
    "page_row_number": with_catalog(
        "SELECT product_id, (rank - 1) // 50 + 1 AS page, (rank - 1) % 50 + 1 AS row FROM grid", US
    ),
    "series_position": with_catalog(
        "SELECT product_id, variant_id, captured_at, price_cents, pos, CASE WHEN n = 1 THEN 0.5::double ELSE (pos - 1)::double / (n - 1)::double END AS x FROM placed",
        POSITIONED,
    ),
    "series_minmax_scale": with_catalog(
        "SELECT product_id, variant_id, captured_at, price_cents, (price_cents - lo)::double / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)::double AS y FROM placed",
        POSITIONED,
    ),
    **{
        f"rank_by_metric_{c}_{order}": rank_all(c, better, needs, order)
        for c, better, needs in METRICS
        for order in ("best", "worst")
    },
    "top_listings": with_catalog(
        f"SELECT variant_id, product_id, price_cents, protein_per_dollar FROM ({US_MATCH}) ORDER BY protein_per_dollar DESC, price_cents, variant_id LIMIT 200"
    ),
    "page_listings": with_catalog(f"SELECT {PAGE}, protein_per_dollar FROM grid WHERE rank <= 50", UK),
    "page_listings_rows": with_catalog(f"SELECT * EXCLUDE (rn, rank) REPLACE ({TAG_TEXT}) FROM grid WHERE rank <= 50", FULL),
    "grouped_listings": with_catalog(f"SELECT * EXCLUDE (rn, rank) REPLACE ({TAG_TEXT}) FROM grid", FULL),
    "page_listings_2": with_catalog(f"SELECT {PAGE}, protein_per_dollar FROM grid WHERE rank BETWEEN 51 AND 100", UK),
    "page_listings_last": with_catalog(
        f"SELECT {PAGE}, rank, (rank - 1) % 50 + 1 AS row FROM grid WHERE (rank - 1) // 50 = (SELECT (max(rank) - 1) // 50 FROM grid)", UK
    ),
    "page_bounds": with_catalog(
        "SELECT page, total, greatest(1, (total + 49) // 50) AS total_pages, CASE WHEN total = 0 THEN 0 ELSE (page - 1) * 50 + 1 END AS first_shown, "
        f"least(page * 50, total) AS last_shown FROM (SELECT total, unnest(range(1, greatest(1, (total + 49) // 50) + 1)) AS page FROM (SELECT count(DISTINCT product_id) AS total FROM ({US_MATCH})))"
    ),
    "product_detail_rows": with_catalog(
        "SELECT product_id, variant_id, market, protein_per_dollar, row_number() OVER (PARTITION BY product_id ORDER BY protein_per_dollar DESC NULLS LAST, variant_id) AS pos FROM offers"
    ),
    "price_history": with_catalog("SELECT product_id, variant_id, captured_at, price_cents, pos FROM placed", POSITIONED),
}
