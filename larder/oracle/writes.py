"""Checking SQL for the writer and streaming queries."""

from __future__ import annotations

from larder.oracle import payloads
from larder.oracle import prefix as p
from larder.oracle.prefix import TIES, joined, with_catalog, with_keys

ARRIVALS = (
    "arrivals AS (SELECT l_suppkey AS source_id, CAST(l_partkey AS STRING) AS source_sku, 'https://shop.example/' || CAST(l_orderkey AS STRING) AS url, "
    "'line ' || CAST(l_linenumber AS STRING) AS title, CASE WHEN l_linenumber % 3 <> 0 THEN '{\"l_orderkey\":' || CAST(l_orderkey AS STRING) || '}' END AS raw_payload, "
    "l_partkey AS product_id, min(l_shipdate) OVER w AS first_seen_at, max(l_shipdate) OVER w AS last_seen_at, "
    f"row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, {TIES}) AS rn FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey))"
)
LISTINGS = f"WITH {ARRIVALS} SELECT source_id, source_sku, url, title, raw_payload, product_id, last_seen_at, first_seen_at FROM arrivals WHERE rn = 1"
PARTS = (
    f"parts AS (SELECT {p.dedup_key('p_brand', 'p_name')} AS dedup_key, p_name AS name, CASE WHEN p_size % 10 <> 0 THEN lower(p_type) END AS category, p_brand AS brand_id, p_partkey AS seq, p_size > 25 AS late FROM part),\n"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY late DESC, seq DESC) AS newest, row_number() OVER (PARTITION BY dedup_key ORDER BY late, seq) AS oldest FROM parts)"
)
ALL_PRICES = (
    "SELECT variant_id, price_cents, currency, in_stock, captured_at FROM prices UNION ALL "
    "SELECT variant_id, price_cents, currency, in_stock, TIMESTAMP '2030-01-01 00:00:00' FROM latest"
)
ISSUES = "SELECT variant_id, sk, CASE WHEN ok THEN 'warning' ELSE 'error' END AS severity, array_to_string(CASE WHEN ok THEN warnings ELSE errors END, ',') AS codes FROM checked WHERE len(errors) + len(warnings) > 0"
FIELDS = "serving_size_g, servings_per_container, protein_g, fat_g, carb_g, sugar_g, calories_kcal, confidence, extraction_method"

# ---- ingestion runs: the offers of all families, without what arrived cut off
BROKEN = "(pk + sk) % 61 = 0"
ON = "sk IN (SELECT source_id FROM sources WHERE coalesce(enabled, true))"
MACROS = ["serving_size_g", "servings_per_container", "protein_g", "fat_g", "carb_g", "sugar_g", "calories_kcal"]


def taken(tag: str, nutri: str, fields: dict[str, str]) -> str:
    columns = ", ".join(f"CAST({fields.get(f, 'NULL')} AS DOUBLE) AS {f}" for f in MACROS)
    return (
        "SELECT sk AS source_id, source_slug, market, source_sku, source_variant_id, url, price_cents, currency, in_stock, compare_at_price_cents, size_g, "
        f"{nutri} AS nutri, {columns}, 'html_parse' AS extraction_method FROM {tag}_shop WHERE NOT ({BROKEN}) AND {ON}"
    )


TOLD = {f: f for f in MACROS}
TAKEN = [
    *payloads.UNION_CTES[:-1],
    "taken AS (" + " UNION ALL ".join([
        taken("feed", "text <> ''", {f: payloads.FILLED if f == "servings_per_container" else f"p_{f}" for f in MACROS}),
        taken("market", "protein_g IS NOT NULL OR servings_per_container IS NOT NULL", TOLD),
        taken("page", "protein_g IS NOT NULL OR serving_size_g IS NOT NULL", TOLD),
        *[taken(tag, "false", {}) for tag in ("affiliate", "grocer", "auction")],
    ]) + ")",
    "told AS (SELECT * FROM taken WHERE nutri)",
    p.validate_cte("judged", "told"),
    f"lost AS (SELECT sk AS source_id, type, CASE WHEN NOT ({BROKEN}) THEN 'payload has no handle' WHEN type = 'jsonld' THEN 'page has no readable product data' "
    f"ELSE 'payload is not valid JSON' END AS reason FROM keys JOIN sources ON source_id = sk WHERE {ON} AND ({BROKEN} OR (type = 'shopify' AND pk % 23 = 0)))",
    "troubles AS (SELECT source_id, 'extract' AS stage, 'error' AS severity, reason, type = 'jsonld' AS has_url FROM lost UNION ALL "
    "SELECT source_id, 'validate', CASE WHEN ok THEN 'warning' ELSE 'error' END, NULL, true FROM judged WHERE len(errors) + len(warnings) > 0)",
]
RUN_ROWS = (
    "SELECT source_id, 1 AS a, 0 AS b, 0 AS c, 0 AS e, 0 AS f FROM sources WHERE coalesce(enabled, true) "
    "UNION ALL SELECT DISTINCT ON (source_id, source_sku) source_id, 0, 1, 0, 0, 0 FROM taken UNION ALL SELECT source_id, 0, 0, 1, 0, 0 FROM taken "
    "UNION ALL SELECT source_id, 0, 0, 0, 1, 0 FROM judged WHERE ok UNION ALL SELECT source_id, 0, 0, 0, 0, 1 FROM troubles"
)

ORACLE = {
    "ingest_run": with_keys(
        "SELECT source_id, CAST(sum(a) AS BIGINT) AS sources, CAST(sum(b) AS BIGINT) AS products, CAST(sum(c) AS BIGINT) AS variants, CAST(sum(c) AS BIGINT) AS prices, "
        f"CAST(sum(e) AS BIGINT) AS nutrition_ok, CAST(sum(f) AS BIGINT) AS issues FROM ({RUN_ROWS}) GROUP BY GROUPING SETS ((source_id), ())", *TAKEN
    ),
    "ingest_catalog": with_keys(
        "SELECT t.source_slug, t.market, t.url, t.price_cents, t.currency, t.in_stock, t.compare_at_price_cents, t.size_g, CASE WHEN j.ok THEN j.protein_g END AS protein_g, "
        "CASE WHEN j.ok THEN j.servings_per_container END AS servings_per_container, CASE WHEN j.ok THEN j.confidence ELSE 0.0::double END AS confidence "
        "FROM taken t LEFT JOIN judged j USING (source_id, source_sku, source_variant_id)", *TAKEN
    ),
    "ingest_issues": with_keys(
        "SELECT source_id, stage, severity, reason, count(*) AS issues, count(*) FILTER (WHERE has_url) AS with_url FROM troubles GROUP BY ALL", *TAKEN
    ),
    "ingest_replay": with_keys(
        "SELECT 'listings' AS \"table\", count(DISTINCT source_id || '/' || source_sku) AS n FROM taken UNION ALL SELECT 'variants', count(*) FROM taken "
        "UNION ALL SELECT 'price_observations', 2 * count(*) FROM taken UNION ALL SELECT 'issues', 2 * count(*) FROM troubles", *TAKEN
    ),
    "upsert_sources": with_keys(
        "SELECT slug, name || ' v2' AS name, base_url, market, coalesce(enabled, true) AS enabled, type FROM sources UNION ALL "
        f"SELECT {p.slug('n_name')}, n_name, 'https://new.example', 'US', true, 'shopify' FROM nation"
    ),
    "upsert_brands": f"SELECT slug, name FROM (SELECT {p.slug(p.brand('p_brand'))} AS slug, CASE WHEN p_partkey % 2 = 1 THEN upper(p_brand) ELSE p_brand END AS name, row_number() OVER (PARTITION BY {p.slug(p.brand('p_brand'))} ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1",
    "upsert_products": f"WITH {PARTS} SELECT n.dedup_key, n.name, n.category, o.brand_id FROM ranked n JOIN ranked o ON o.dedup_key = n.dedup_key AND o.oldest = 1 WHERE n.newest = 1",
    "upsert_listings": LISTINGS,
    "stream_catalog_upsert": LISTINGS,
    "upsert_variants": with_catalog(
        "SELECT listing_id, 'default' AS source_variant_id, flavor, size_g + 1.0::double AS size_g, CAST(NULL AS STRING) AS size_label, CASE WHEN length(variant_id) % 2 = 0 THEN upc END AS upc, compare_at_price_cents FROM variants"
    ),
    "upsert_nutrition": with_catalog(
        f"SELECT variant_id, {FIELDS} FROM again WHERE ok UNION ALL SELECT variant_id, {FIELDS} FROM nutrition WHERE variant_id NOT IN (SELECT variant_id FROM again WHERE ok)",
        "second AS (SELECT * REPLACE (protein_g + 3.0::double AS protein_g) FROM candidates)", p.validate_cte("again", "second"),
    ),
    "upsert_facts": with_catalog(
        "SELECT variant_id, ingredients_text_ || ', Salt' AS ingredients_text, " + ", ".join(f"{joined(t)} AS {t}" for t in ("dietary_labels", "allergens", "sweeteners")) + " FROM facts"
    ),
    "append_price_observations": with_catalog(ALL_PRICES),
    "append_price_sink": with_catalog(
        f"SELECT CAST(date_trunc('month', captured_at) AS DATE) AS captured_month, count(*) AS observations, CAST(sum(price_cents) AS BIGINT) AS cents FROM ({ALL_PRICES}) GROUP BY 1"
    ),
    "append_issues": with_catalog(f"SELECT 'validate' AS stage, severity, codes, count(*) AS issues FROM ({ISSUES}) GROUP BY ALL"),
    "expire_orphans": with_catalog("SELECT variant_id FROM keys JOIN sources ON source_id = sk WHERE coalesce(enabled, true)"),
    "expire_orphans_issues": with_catalog(
        f"SELECT variant_id, codes, CASE WHEN sk IN (SELECT source_id FROM sources WHERE coalesce(enabled, true)) THEN sk END AS source_id FROM ({ISSUES})"
    ),
    "delete_cascade": with_catalog(
        "SELECT 'sources' AS \"table\", CAST(source_id AS STRING) AS id, 1::BIGINT AS n FROM live_sources UNION ALL SELECT 'brands', brand_id, 1 FROM brands WHERE brand_id <> 'brand-3' "
        "UNION ALL SELECT 'products', CAST(product_id AS STRING), 1 FROM live_products UNION ALL SELECT 'listings', listing_id, 1 FROM live_listings "
        "UNION ALL SELECT 'variants', listing_id, 1 FROM live_listings UNION ALL SELECT 'nutrition', variant_id, 1 FROM nutrition WHERE variant_id IN (SELECT listing_id FROM live_listings) "
        "UNION ALL SELECT 'facts', variant_id, 1 FROM facts WHERE variant_id IN (SELECT listing_id FROM live_listings) "
        "UNION ALL SELECT 'prices', variant_id, count(*) FROM prices WHERE variant_id IN (SELECT listing_id FROM live_listings) GROUP BY 2 "
        f"UNION ALL SELECT 'issues', CAST(CASE WHEN sk IN (SELECT source_id FROM live_sources) THEN sk END AS STRING), count(*) FROM ({ISSUES}) GROUP BY 2",
        "live_sources AS (SELECT * FROM sources WHERE coalesce(enabled, true))",
        "live_products AS (SELECT * FROM products WHERE product_id % 50 <> 0 AND brand_id <> 'brand-3')",
        "live_listings AS (SELECT * FROM listings WHERE (product_id + source_id) % 90 <> 0 AND source_id IN (SELECT source_id FROM live_sources) AND product_id IN (SELECT product_id FROM live_products))",
    ),
    "latest_price_bucketed": with_catalog(
        "SELECT v.variant_id, flavor, price_cents, captured_at, protein_g FROM variants v JOIN latest USING (variant_id) LEFT JOIN nutrition n ON n.variant_id = v.variant_id"
    ),
    "history_for_variants_bucketed": with_catalog(
        "SELECT variant_id, price_cents, captured_at FROM prices WHERE variant_id IN (SELECT variant_id FROM variants WHERE flavor = 'Vanilla')"
    ),
    "stream_price_append": "SELECT event_id, event_type || '-' || CAST(user_id AS STRING) AS variant_id, CAST(floor(value * 100) AS BIGINT) AS price_cents FROM events",
    "stream_latest_price": with_catalog("SELECT * FROM latest"),
    "stream_validate_route": with_catalog(
        f"SELECT 'issues' AS sink, variant_id, severity, codes FROM ({ISSUES}) UNION ALL "
        "SELECT 'accepted', variant_id, NULL, NULL FROM checked WHERE ok"
    ),
}
