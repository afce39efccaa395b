"""Checking SQL for the text, enrichment and quality queries."""

from __future__ import annotations

from larder.functions import vocab
from larder.oracle import prefix as p
from larder.oracle.payloads import BARCODES
from larder.oracle.prefix import joined, q, with_catalog, with_keys
from larder.sources import fixtures as fx

TITLES = f"titles AS (SELECT *, {fx.TITLE} AS title, {fx.TITLE_BRAND} AS brand, {fx.PRICE_TEXT} AS price_text, {fx.FLAVOR_TEXT} AS flavor_text FROM keys)"
DOCS = f"docs AS (SELECT doc_id, text || {fx.FACTS_TEXT} || chr(10) || chr(10) || {fx.INGREDIENT_TEXT} AS body FROM (SELECT *, doc_id AS n FROM documents)), low AS (SELECT *, lower(body) AS low FROM docs)"
PAGES = f"markup AS (SELECT page_id, url, replace(html, '</body>', '<div><b>' || {fx.FACTS_TEXT} || '</b></div></body>') AS markup FROM (SELECT *, page_id AS n FROM pages)), texts AS (SELECT *, {p.html_text('markup')} AS text FROM markup)"
PAGE_FACTS = "parsed AS (SELECT page_id, url, " + ", ".join(f"{sql} AS {k}" for k, sql in p.facts_fields("text").items()) + " FROM texts)"


def title(name: str, expr: str) -> str:
    return with_keys(f"SELECT variant_id, {expr} AS {name} FROM titles", TITLES)


def doc(name: str, expr: str) -> str:
    return f"WITH {DOCS} SELECT doc_id, {expr} AS {name} FROM low"


def page(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([PAGES, *ctes]) + " " + body


OTHER = {
    "serving_size_g": "30.0::double", "servings_per_container": "CAST(NULL AS DOUBLE)",
    "protein_g": "CASE WHEN length(url) % 2 = 0 THEN 21.0::double END", "fat_g": "2.0::double",
    "carb_g": "3.0::double", "sugar_g": "1.0::double", "calories_kcal": "100.0::double",
}
HIT_G = f"coalesce(nullif(serving_quantity, 0), {p.weight('serving_size')})"


def scaled(direct: str, base: str, grams: str = "g") -> str:
    return f"coalesce({p.rounded(direct, 2)}, CASE WHEN {grams} <> 0 THEN {p.rounded(f'{base} * {grams} / 100.0::double', 2)} END)"


OFF = (
    f"missing AS (SELECT variant_id, upc, size_g FROM variants WHERE upc IS NOT NULL AND variant_id NOT IN (SELECT variant_id FROM nutrition)),\n{BARCODES},\n"
    f"hits AS (SELECT *, {HIT_G} AS g FROM missing JOIN barcodes USING (upc)),\n"
    f"off AS (SELECT variant_id, size_g, g AS serving_size_g, CASE WHEN product_quantity <> 0 AND g <> 0 THEN {p.rounded('product_quantity / g', 1)} WHEN size_g >= 300 AND g <> 0 THEN {p.rounded('size_g / g', 1)} END AS servings_per_container, "
    f"{scaled('protein_serving', 'protein_100g')} AS protein_g, {scaled('CAST(NULL AS DOUBLE)', 'fat_100g')} AS fat_g, {scaled('CAST(NULL AS DOUBLE)', 'carb_100g')} AS carb_g, "
    f"{scaled('sugar_serving', 'CAST(NULL AS DOUBLE)')} AS sugar_g, {scaled('CAST(NULL AS DOUBLE)', 'kcal_100g')} AS calories_kcal, 'open_food_facts' AS extraction_method FROM hits),\n"
    "known AS (SELECT * FROM off WHERE protein_g IS NOT NULL OR serving_size_g IS NOT NULL)"
)


def leaf(column: str, table: dict[str, str]) -> str:
    return f"list_filter([{p.case({k: q(v) for k, v in table.items()}, f'split_part({column}, chr(58), -1)', 'NULL')}], lambda m: m IS NOT NULL)"


LIST_TEXT = "coalesce(nullif(ingredients_text, ''), ingredients_text_en)"
OFF_FACTS = p.facts_ctes(
    "told", "barcodes", LIST_TEXT, "''", "''",
    leaf("label_tag", vocab.BARCODE_LABEL_TAGS), leaf("allergen_tag", vocab.BARCODE_ALLERGEN_TAGS),
)
TAGS3 = ", ".join(f"{joined(t)} AS {t}" for t in ("dietary_labels", "allergens", "sweeteners"))
RESOLVE = (
    f"keyed AS (SELECT variant_id, sk, pk, {fx.UPC} AS upc, {p.dedup_key('brand', 'title')} AS dedup_key FROM titles),\n"
    "known_upc AS (SELECT upc, min(dedup_key) AS known_key FROM keyed WHERE sk < 2 AND upc IS NOT NULL GROUP BY upc),\n"
    "incoming AS (SELECT variant_id, sk || '-' || (pk // 3) AS listing_id, pk % 3 AS place, upc, dedup_key FROM keyed WHERE sk >= 2),\n"
    "own AS (SELECT listing_id, arg_min(dedup_key, place) AS own_key FROM incoming GROUP BY listing_id),\n"
    "coded_offer AS (SELECT listing_id, place, i.upc, known_key, min(own_key) OVER (PARTITION BY i.upc) AS shared_key FROM incoming i JOIN own USING (listing_id) LEFT JOIN known_upc k ON k.upc = i.upc WHERE i.upc IS NOT NULL),\n"
    "decided AS (SELECT listing_id, arg_min(known_key, place) FILTER (WHERE known_key IS NOT NULL) AS known_key, arg_min(shared_key, place) AS shared_key FROM coded_offer GROUP BY listing_id),\n"
    "resolved AS (SELECT variant_id, listing_id, upc, dedup_key, coalesce(known_key, shared_key, own_key) AS product_key, known_key IS NOT NULL AS by_existing_upc FROM incoming JOIN own USING (listing_id) LEFT JOIN decided USING (listing_id))"
)

CHAINS = (
    "pairs AS (SELECT DISTINCT 'u' || i.upc AS a, 'k' || own_key AS b FROM incoming i JOIN own USING (listing_id) WHERE i.upc IS NOT NULL "
    "UNION SELECT 'u' || upc, 'k' || dedup_key FROM keyed WHERE sk < 2 AND upc IS NOT NULL),\n"
    "links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),\n"
    "reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),\n"
    "old_keys AS (SELECT DISTINCT dedup_key FROM keyed WHERE sk < 2),\n"
    "reached AS (SELECT substr(node, 2) AS own_key, substr(other, 2) AS key FROM reach WHERE node LIKE 'k%' AND other LIKE 'k%' "
    "UNION SELECT own_key, own_key FROM own),\n"
    "chosen AS (SELECT own_key, arg_min(key, (CASE WHEN key IN (SELECT dedup_key FROM old_keys) THEN 'a' ELSE 'b' END) || key) AS product_key FROM reached GROUP BY own_key)"
)


def rule(condition: str, *columns: str) -> str:
    return with_catalog(f"SELECT variant_id, {', '.join(columns)} FROM candidates WHERE {condition}")


ORACLE = {
    "parse_weight_g": title("weight_g", p.weight("title")),
    "parse_container_g": title("container_g", p.container("title")),
    "is_multipack": title("multipack", p.multipack("title")),
    "parse_servings": title("servings", p.servings("title")),
    "to_cents": title("price_cents", p.cents("price_text")),
    "clean_flavor": title("flavor", p.flavor("flavor_text")),
    "standardise_listings": with_keys(
        f"SELECT variant_id, {p.weight('title')} AS weight_g, {p.container('title')} AS container_g, {p.multipack('title')} AS multipack, {p.servings('title')} AS servings, {p.cents('price_text')} AS price_cents, {p.flavor('flavor_text')} AS flavor FROM titles", TITLES
    ),
    "parse_weight_g_documents": doc("weight_g", p.weight("body")),
    "parse_container_g_documents": doc("container_g", p.container("body")),
    "collapse_ws": doc("collapsed", p.collapse("body")),
    "slugify": title("slug", p.slug("title")),
    "normalize_brand": title("brand", p.brand("brand")),
    "brand_token_union": title(
        "tokens",
        f"array_to_string(list_filter(list_concat(string_split({p.brand('brand')}, ' '), list_filter(string_split({p.plain('brand')}, ' '), lambda t: NOT list_contains(string_split({p.brand('brand')}, ' '), t))), lambda t: true), ',')",
    ),
    "canonical_core_name": title("core", p.core_name("brand", "title")),
    "product_dedup_key": title("dedup_key", p.dedup_key("brand", "title")),
    "dedup_key_parts": f"SELECT p_partkey AS product_id, {p.dedup_key('p_brand', 'p_name')} AS dedup_key FROM part",
    "gtin_normalize": with_catalog("SELECT variant_id, lpad(ltrim(upc, '0'), 14, '0') AS gtin FROM variants"),
    "resolve_products": with_keys("SELECT * FROM resolved", TITLES, RESOLVE),
    "resolve_product_chains": with_keys(
        "SELECT variant_id, listing_id, upc, dedup_key, product_key, product_key IN (SELECT dedup_key FROM old_keys) AS existing "
        "FROM incoming JOIN own USING (listing_id) JOIN chosen USING (own_key)", TITLES, RESOLVE, CHAINS
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "resolve_identity": with_keys(
        "SELECT product_key, count(*) AS offers, count(*) FILTER (WHERE by_existing_upc) AS by_upc FROM resolved GROUP BY 1", TITLES, RESOLVE
    ),
    "classify_category": doc("category", p.category("low")),
    "scan_dietary": doc("dietary_labels", joined(p.tags("low", vocab.DIETARY))),
    "scan_allergens": doc("allergens", joined(p.tags("low", vocab.ALLERGENS))),
    "scan_sweeteners": doc("sweeteners", joined(p.tags("low", vocab.SWEETENERS))),
    "extract_ingredients": doc("ingredients", p.ingredients("body")),
    "derive_facts": f"WITH {DOCS}, listed AS (SELECT *, {p.ingredients('body')} AS ing FROM docs), {p.facts_ctes('told', 'listed', 'ing', 'body')} SELECT doc_id, ingredients_text_ AS ingredients_text, {TAGS3} FROM told",
    "html_page_text": f"SELECT page_id, replace(replace({p.html_text('html')}, '&copy;', '©'), '&middot;', '·') AS text FROM pages",
    "html_to_text": f"SELECT page_id, {p.html_text('html')} AS text FROM pages",
    "search_grams": page(f"SELECT page_id, {p.facts_fields('text')['fat_g']} AS fat_g FROM texts"),
    "search_number": page(f"SELECT page_id, {p.facts_fields('text')['calories_kcal']} AS kcal FROM texts"),
    "search_protein": page(f"SELECT page_id, {p.protein('text')} AS protein_g FROM texts"),
    "parse_nutrition_text": f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"{sql} AS {k}" for k, sql in p.facts_fields("body").items()) + " FROM docs",
    "parse_nutrition_html": page("SELECT * EXCLUDE (url) FROM parsed", PAGE_FACTS),
    "nutrition_complete": page("SELECT page_id, protein_g IS NOT NULL AND servings_per_container IS NOT NULL AS complete FROM parsed", PAGE_FACTS),
    "merge_nutrition": page(
        "SELECT page_id, " + ", ".join(f"coalesce({k}, {v}) AS {k}" for k, v in OTHER.items()) + ", CASE WHEN "
        + " OR ".join(f"({k} IS NULL AND {v} IS NOT NULL)" for k, v in OTHER.items()) + " THEN 'llm' ELSE 'html_parse' END AS extraction_method FROM parsed", PAGE_FACTS
    ),
    "per_serving_from_100g": f"WITH {BARCODES} SELECT upc, {scaled('protein_serving', 'protein_100g', 'serving_quantity')} AS protein_g, {scaled('CAST(NULL AS DOUBLE)', 'fat_100g', 'serving_quantity')} AS fat_g FROM barcodes",
    "off_nutrition": with_catalog("SELECT * EXCLUDE (size_g) FROM known", OFF),
    "enrich_by_upc": with_catalog("SELECT variant_id, protein_g, servings_per_container FROM known", OFF),
    "off_facts": f"WITH {BARCODES},\n{OFF_FACTS} SELECT upc, ingredients_text_ AS ingredients_text, {TAGS3} FROM told",
    "union_facts": f"WITH {BARCODES} SELECT upc, coalesce(array_to_string(list_sort(list_distinct(list_concat({p.tags('lower(ingredients_text)', vocab.ALLERGENS)}, {leaf('allergen_tag', vocab.BARCODE_ALLERGEN_TAGS)}))), ','), '') AS allergens FROM barcodes",
    "enrich_stats": with_catalog(
        "SELECT (SELECT count(*) FROM missing) AS checked, count(*) FILTER (WHERE ok) AS enriched, (SELECT count(*) FROM variants JOIN told ON told.upc = variants.upc WHERE variant_id NOT IN (SELECT variant_id FROM facts)) AS facts_enriched, count(*) FILTER (WHERE NOT ok) AS issues FROM off_checked",
        OFF, p.validate_cte("off_checked", "known"), OFF_FACTS,
    ),
    "rule_required": rule("protein_g IS NULL OR servings_per_container IS NULL", "protein_g"),
    "rule_negative": with_catalog(
        "SELECT * FROM (SELECT variant_id, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {f} < 0 THEN '{f}' END" for f in ("protein_g", "fat_g", "carb_g", "calories_kcal", "serving_size_g", "servings_per_container"))
        + "], lambda m: m IS NOT NULL), ',') AS fields FROM candidates) WHERE fields <> ''"
    ),
    "rule_protein_le_serving": rule(p.ERRORS["protein_exceeds_serving"], "protein_g", "serving_size_g"),
    "rule_min_servings": rule(p.ERRORS["servings_below_min"], "servings_per_container"),
    "rule_implied_serving": rule(p.ERRORS["implied_serving_too_big"], "size_g", "servings_per_container"),
    "rule_serving_range": rule(p.WARNINGS["serving_size_range"], "serving_size_g"),
    "rule_servings_range": rule(p.WARNINGS["servings_range"], "servings_per_container"),
    "rule_atwater": rule(p.WARNINGS["calories_disagree"], "calories_kcal"),
    "rule_container_math": rule(p.WARNINGS["container_disagrees"], "size_g"),
    "confidence_score": with_catalog("SELECT variant_id, extraction_method, confidence FROM checked"),
    "validate_nutrition": with_catalog(
        "SELECT variant_id, ok, confidence, coalesce(array_to_string(errors, ','), '') AS errors, coalesce(array_to_string(warnings, ','), '') AS warnings FROM checked"
    ),
    "route_validated": with_catalog(
        "SELECT variant_id, 'validate' AS stage, CASE WHEN ok THEN 'warning' ELSE 'error' END AS severity, array_to_string(CASE WHEN ok THEN warnings ELSE errors END, ',') AS codes FROM checked WHERE len(errors) + len(warnings) > 0"
    ),
    "route_accepted": with_catalog("SELECT variant_id, confidence FROM checked WHERE ok"),
}
