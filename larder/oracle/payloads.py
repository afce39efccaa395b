"""Checking SQL for the payload queries: expected columns straight from the payload fields."""

from __future__ import annotations

import re

from larder.functions import vocab
from larder.oracle import prefix as p
from larder.oracle.prefix import joined, q, with_keys
from larder.sources import fixtures as fx


def family(kind: str, table: dict[str, str], name: str = "items") -> str:
    fields = ", ".join(f"{sql} AS {k}" for k, sql in table.items())
    return (
        f"{name}_keys AS (SELECT variant_id, pk, sk, pk AS n, slug AS source_slug, name AS source_name, base_url, market "
        f"FROM keys JOIN sources ON source_id = sk WHERE type = '{kind}'),\n"
        f"{name} AS (SELECT variant_id, pk, sk, n, source_slug, source_name, base_url, market, {fields} FROM {name}_keys)"
    )


FEED = family("shopify", {**fx.FEED, "body_html": fx.FEED_BODY})
AFFILIATE = family("walmart", fx.AFFILIATE)
MARKETPLACE = family(
    "amazon",
    {
        **fx.MARKETPLACE,
        **{k: f"CASE WHEN {fx.MARKETPLACE_HAS_DETAIL} AND NOT (pk % 31 = 0) THEN {v} END" for k, v in fx.MARKETPLACE_DETAIL.items()},
        "has_d": fx.MARKETPLACE_HAS_DETAIL,
    },
)
GROCER = family("kroger", fx.GROCER)
AUCTION = family("ebay", {**fx.AUCTION, "has_item": fx.AUCTION_HAS_ITEM})
PAGE = family("jsonld", {**fx.PAGE, "url": "base_url || '/p/' || CAST(pk AS STRING)", "facts_text": fx.FACTS_TEXT})


def powder_sql(name: str, text: str, excluded: list[str]) -> str:
    return f"NOT {p.multipack(name)} AND contains({text}, 'protein') AND NOT {p.has(text, excluded)}"


FEED_TEXT = "lower(title || ' ' || product_type)"
AFFILIATE_TEXT = "lower(name || ' ' || category)"
GROCER_TEXT = "lower(name || ' ' || brand || ' ' || cat_a)"
POWDER_FEED = f"contains({FEED_TEXT}, 'protein') AND NOT {p.has(FEED_TEXT, vocab.FEED_EXCLUDE)}"
POWDER_AFFILIATE = powder_sql("name", AFFILIATE_TEXT, vocab.AFFILIATE_EXCLUDE)
POWDER_MARKETPLACE = powder_sql("title", "lower(title)", vocab.MARKETPLACE_EXCLUDE)
POWDER_GROCER = powder_sql(GROCER_TEXT, GROCER_TEXT, vocab.GROCER_EXCLUDE)
POWDER_AUCTION = powder_sql("title", "lower(title)", vocab.AUCTION_EXCLUDE) + " AND coalesce(TRY_CAST(feedback AS DOUBLE), 0) >= 95"

PLACE = "CAST(0 AS INTEGER) AS query, CAST(pk // 25 AS BIGINT) AS page"


def scan(ctes: str, key: str, condition: str) -> str:
    return with_keys(f"SELECT source_slug, {PLACE}, CAST({key} AS STRING) AS item_key FROM items WHERE {condition}", ctes)


def powder(ctes: str, key: str, condition: str) -> str:
    return with_keys(f"SELECT source_slug, pk, CAST({key} AS STRING) AS item_key FROM items WHERE {condition}", ctes)


CORE = ("source_slug, market, source_sku, url, title, brand_name, product_name, category, source_variant_id, flavor, "
        "size_g, size_label, price_cents, currency, in_stock, upc, compare_at_price_cents")
NUTRITION = ("serving_size_g, servings_per_container, protein_g, fat_g, carb_g, sugar_g, calories_kcal, extraction_method")
CURRENCY = p.CURRENCY
TAGS3 = ", ".join(f"{joined(t)} AS {t}" for t in ("dietary_labels", "allergens", "sweeteners"))
NULLS = "CAST(NULL AS STRING) AS flavor, CAST(NULL AS STRING) AS size_label"


def facts_query(ctes: list[str], source: str, list_x: str, label_x: str, named_x: str = "''", id_x: str = "source_variant_id") -> str:
    return with_keys(
        f"SELECT source_slug, {id_x} AS source_variant_id, ingredients_text_ AS ingredients_text, {TAGS3} FROM told",
        *ctes, p.facts_ctes("told", source, list_x, label_x, named_x),
    )


# ---- storefront feed
_v = {k: sql.replace("CAST(500 + (pk % 10) * 50 AS INT)", "500 + (pk % 10) * 50") for k, sql in fx.FEED_VARIANT.items()}
FEED_TEXTS = (
    f"texts AS (SELECT *, {p.html_text('body_html')} AS text, CASE WHEN tag_style = 0 THEN tag_a || ' ' || tag_b ELSE tag_a || ', ' || tag_b END AS tags_text FROM items WHERE handle IS NOT NULL)"
)
FEED_PARSED = (
    "parsed AS (SELECT *, " + ", ".join(f"CASE WHEN text <> '' THEN {sql} END AS p_{k}" for k, sql in p.facts_fields("text").items()) + " FROM texts)"
)
FEED_VARIANTS = (
    "exploded AS (SELECT *, unnest([0, 1]) AS j FROM parsed),\n"
    "opts AS (SELECT *, " + ", ".join(f"{sql} AS v_{k}" for k, sql in _v.items()) + " FROM exploded),\n"
    "laid AS (SELECT *, v_flavor_opt || ' / ' || v_size_opt AS v_title, CASE WHEN layout < 2 THEN v_size_opt END AS size_label, "
    "CASE WHEN layout < 2 THEN v_flavor_opt END AS flavor_label, CASE layout WHEN 0 THEN v_flavor_opt WHEN 1 THEN v_size_opt ELSE 'Default Title' END AS option1, "
    "CASE layout WHEN 0 THEN v_size_opt WHEN 1 THEN v_flavor_opt END AS option2, "
    f"{p.cents('v_price')} AS price_cents, {p.cents('v_compare_at')} AS compare_at FROM opts),\n"
    f"sized AS (SELECT *, coalesce(nullif({p.weight('size_label')}, 0), nullif({p.weight('v_title')}, 0), nullif(CAST(v_grams AS DOUBLE), 0)) AS size_g FROM laid WHERE price_cents > 0),\n"
    "shop AS (SELECT *, handle AS source_sku, base_url || '/products/' || handle AS url, coalesce(nullif(vendor, ''), source_name) AS brand_name, title AS product_name, "
    f"{p.category(chr(39) + chr(39) + ' || lower(title || ' + q(' ') + ' || product_type || ' + q(' ') + ' || tags_text)')} AS category, "
    f"CAST(v_vid AS STRING) AS source_variant_id, {p.flavor('flavor_label')} AS flavor, {CURRENCY} AS currency, coalesce(v_available, true) AS in_stock, "
    "CAST(NULL AS STRING) AS upc, CASE WHEN compare_at > price_cents THEN compare_at END AS compare_at_price_cents FROM sized)"
)
FEED_ALL = [FEED, FEED_TEXTS, FEED_PARSED, FEED_VARIANTS]
FILLED = (
    f"coalesce(p_servings_per_container, nullif({p.servings('v_title')}, 0), nullif({p.servings('option1')}, 0), nullif({p.servings('option2')}, 0), "
    f"nullif({p.servings('title')}, 0), CASE WHEN size_g <> 0 AND p_serving_size_g <> 0 THEN {p.rounded('size_g / p_serving_size_g', 1)} END)"
)

# ---- affiliate catalog
AFFILIATE_SHOP = (
    f"priced AS (SELECT *, {p.cents_num('sale_price')} AS price_cents, {p.cents_num('msrp')} AS list_cents, short_text || ' ' || long_text AS about FROM items),\n"
    f"shop AS (SELECT *, {p.ingredients('about')} AS ingredients, CAST(item_id AS STRING) AS source_sku, CAST(item_id AS STRING) AS source_variant_id, "
    "'https://www.walmart.com/ip/' || CAST(item_id AS STRING) AS url, name AS title, name AS product_name, coalesce(brand, 'Unknown') AS brand_name, "
    f"{p.category(AFFILIATE_TEXT)} AS category_, {p.container('name')} AS size_g, {NULLS}, 'USD' AS currency, "
    "coalesce(online, true) AND coalesce(stock, 'Available') <> 'Not available' AS in_stock, CASE WHEN list_cents > price_cents THEN list_cents END AS compare_at_price_cents "
    "FROM priced WHERE price_cents > 0)"
)

# ---- marketplace
FIRST_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
CODE = rf"(?:^|{p.NOTWORD})([0-9]{{12,14}})(?:{p.NOTWORD}|$)"
MARKET_BRAND = (
    "coalesce(trim(nullif(i_brand, '')), trim(nullif(i_brand_name, '')), "
    + p.extract("byline", r"(?i)(?:brand:|visit the)\s*(.+?)(?:\s+store)?$")
    + ", trim(nullif(i_maker, '')), 'Unknown')"
)
MARKET_UPC = f"coalesce({p.extract('i_upc', CODE)}, {p.extract('x_gtin', CODE)})"
MARKET_SHOP = (
    f"texts AS (SELECT *, coalesce(nullif(d_title, ''), nullif(title, ''), asin) AS title_, {p.cents('coalesce(nullif(price, ' + q('') + '), d_price)')} AS price_cents, "
    f"{p.cents('coalesce(original, d_original)')} AS original_cents, coalesce(about, '') || ' ' || coalesce(description, '') AS about_text, "
    "array_to_string(list_filter(list_transform(string_split(coalesce(i_diet, ''), ','), lambda s: trim(s)), lambda s: s <> ''), ' ') AS labels, trim(coalesce(i_allergen, '')) AS named FROM items WHERE asin <> ''),\n"
    f"priced AS (SELECT *, coalesce(i_ingredients, {p.ingredients('about_text')}) AS ingredients FROM texts WHERE price_cents > 0),\n"
    f"shop AS (SELECT * EXCLUDE (title, url), asin AS source_sku, asin AS source_variant_id, coalesce(nullif(d_url, ''), nullif(url, ''), 'https://www.' || CASE market WHEN 'US' THEN 'amazon.com' WHEN 'UK' THEN 'amazon.co.uk' ELSE 'amazon.in' END || '/dp/' || asin) AS url, "
    f"title_ AS title, title_ AS product_name, {MARKET_BRAND} AS brand_name, {p.category('lower(title_)')} AS category, coalesce(nullif({p.weight('i_weight')}, 0), {p.container('title_')}) AS size_g, {NULLS}, "
    f"{CURRENCY} AS currency, NOT contains(lower(coalesce(availability, '')), 'unavailable') AND NOT contains(lower(coalesce(availability, '')), 'out of stock') AS in_stock, {MARKET_UPC} AS upc, "
    f"CASE WHEN original_cents > price_cents THEN original_cents END AS compare_at_price_cents, {p.weight('i_serving_size')} AS serving_size_g, "
    f"coalesce({p.number('i_total_servings', FIRST_NUMBER)}, {p.number('i_servings', FIRST_NUMBER)}) AS servings_per_container, {p.number('i_protein', FIRST_NUMBER)} AS protein_g, {p.number('i_fat', FIRST_NUMBER)} AS fat_g, {p.number('i_carb', FIRST_NUMBER)} AS carb_g, "
    "CAST(NULL AS DOUBLE) AS sugar_g, CAST(NULL AS DOUBLE) AS calories_kcal, 'html_parse' AS extraction_method FROM priced)"
)

# ---- grocer
GROCER_SHOP = (
    "unit AS (SELECT *, coalesce(first_regular, 0) <> 0 OR coalesce(second_regular, 0) = 0 AS use_first FROM items WHERE product_code <> '' AND has_items),\n"
    f"money AS (SELECT *, {p.cents_num('CASE WHEN use_first THEN first_regular ELSE second_regular END')} AS regular, {p.cents_num('CASE WHEN use_first THEN first_promo END')} AS promo, "
    "CASE WHEN use_first THEN first_size ELSE '5 lb' END AS size_label, CASE WHEN use_first THEN coalesce(upper(first_stock), '') ELSE 'HIGH' END AS stock FROM unit),\n"
    "sale AS (SELECT *, coalesce(promo, 0) > 0 AND (coalesce(regular, 0) = 0 OR promo < regular) AS on_sale FROM money),\n"
    "priced AS (SELECT *, CASE WHEN on_sale THEN promo ELSE regular END AS price_cents FROM sale),\n"
    f"shop AS (SELECT * EXCLUDE (brand, size_label), product_code AS source_sku, product_code AS source_variant_id, 'https://www.kroger.com/p/' || {p.slug('name')} || '/' || product_code AS url, name AS title, name AS product_name, "
    f"coalesce(nullif(trim(brand), ''), 'Unknown') AS brand_name, {p.category('lower(name || ' + q(' ') + ' || cat_a)')} AS category, CAST(NULL AS STRING) AS flavor, size_label, "
    f"{p.container('name || ' + q(' ') + ' || coalesce(size_label, ' + q('') + ')')} AS size_g, 'USD' AS currency, stock NOT IN ('TEMPORARILY_OUT_OF_STOCK', 'OUT_OF_STOCK') AS in_stock, "
    "CASE WHEN regexp_full_match(product_code, '[0-9]{12,}') THEN product_code END AS upc, CASE WHEN on_sale AND regular > promo THEN regular END AS compare_at_price_cents, "
    "coalesce(gmo, '') || ' ' || coalesce(organic, '') || ' ' || declaration AS labels, CASE WHEN allergen_level IN ('Contains', 'Derived From') THEN allergen_name ELSE '' END AS named "
    "FROM priced WHERE price_cents > 0)"
)

# ---- auction site
GTIN = (
    "CASE WHEN has_item AND item_id <> '' THEN CASE WHEN regexp_full_match(gtin, '[0-9]+') THEN gtin WHEN lower(aspect_name) IN ('upc', 'ean', 'gtin') "
    "AND regexp_full_match(trim(aspect_value), '[0-9]{12,}') THEN trim(aspect_value) END END"
)
AUCTION_SHOP = (
    f"priced AS (SELECT * EXCLUDE (price, currency), currency AS stated, {p.cents('price')} AS price_cents, {p.cents('original')} AS original_cents, {CURRENCY} AS expected FROM items WHERE item_id <> ''),\n"
    "shop AS (SELECT * EXCLUDE (url, brand), item_id AS source_sku, item_id AS source_variant_id, coalesce(url, 'https://www.ebay.com/itm/' || item_id) AS url, title AS product_name, "
    f"coalesce(nullif(trim(brand), ''), 'Unknown') AS brand_name, {p.category('lower(title)')} AS category, {p.container('title')} AS size_g, {NULLS}, expected AS currency, true AS in_stock, {GTIN} AS upc, "
    "CASE WHEN original_cents > price_cents THEN original_cents END AS compare_at_price_cents FROM priced WHERE price_cents > 0 AND coalesce(stated, expected) = expected)"
)

# ---- product pages
NODE = (
    "node AS (SELECT *, CASE WHEN wrap_style = 1 AND offer_style = 3 THEN 'Related item' ELSE name END AS node_name, wrap_style = 1 AND offer_style = 3 AS bare FROM items)"
)
OFFER_PRICE = "CASE WHEN offer_style <> 3 THEN coalesce(price, low_price) END"
PAGE_SHOP = (
    f"priced AS (SELECT *, {p.cents(OFFER_PRICE)} AS price_cents, {p.weight('name')} AS size_g, coalesce({p.collapse('description')}, name || ' ' || {p.collapse('facts_text')}) AS text FROM node WHERE NOT bare),\n"
    "parsed AS (SELECT *, " + ", ".join(f"{sql} AS {k}" for k, sql in p.facts_fields("text").items() if k != "servings_per_container")
    + f", {p.facts_fields('text')['servings_per_container']} AS s0 FROM priced WHERE price_cents > 0),\n"
    f"shop AS (SELECT * EXCLUDE (currency, category), coalesce(sku, product_code, url) AS source_sku, coalesce(sku, product_code, url) AS source_variant_id, name AS title, name AS product_name, CASE WHEN brand_style < 2 THEN brand ELSE source_name END AS brand_name, "
    f"{p.category('lower(name || ' + q(' ') + ' || coalesce(category, ' + q('') + '))')} AS category, {NULLS}, coalesce(currency, 'USD') AS currency, "
    "contains(lower(coalesce(availability, '')), 'instock') OR availability IS NULL AS in_stock, CAST(NULL AS STRING) AS upc, CAST(NULL AS INTEGER) AS compare_at_price_cents, "
    f"coalesce(s0, nullif({p.servings('name')}, 0), CASE WHEN size_g <> 0 AND serving_size_g <> 0 THEN {p.rounded('size_g / serving_size_g', 1)} END) AS servings_per_container, 'html_parse' AS extraction_method FROM parsed)"
)

AFF_CORE = CORE.replace("category", "category_ AS category")
FALLBACK = {
    "serving_size_g": "CAST(30 + pk % 5 AS DOUBLE)", "servings_per_container": "CAST(NULL AS DOUBLE)",
    "protein_g": "CASE WHEN pk % 2 = 0 THEN 21.0::double END", "fat_g": "2.0::double", "carb_g": "3.0::double",
    "sugar_g": "1.0::double", "calories_kcal": "CAST(NULL AS DOUBLE)",
}
INCOMPLETE = "(p_protein_g IS NULL OR p_servings_per_container IS NULL)"
BYTES = "sha256(text)"
SITES = "sites AS (SELECT page_id // 50 AS site, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) - 1 AS pos, page_id, url FROM pages)"
URLS = (
    "both_lists AS (SELECT site, 0 AS part, page_id AS pos, url FROM sites WHERE contains(url, 'ref=') UNION ALL SELECT site, 1, pos, url FROM sites),\n"
    "firsts AS (SELECT site, url, part, pos FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY part, pos) AS rn FROM both_lists) WHERE rn = 1)"
)
URL_COLUMNS = "site, url, CAST(part AS INTEGER) AS part, CAST(pos AS INTEGER) AS pos"
BARCODES = (
    f"parts AS (SELECT p_partkey AS pk FROM part WHERE p_partkey % 5 <> 0),\n"
    f"barcodes AS (SELECT pk, {fx.UPC} AS upc, " + ", ".join(f"{sql} AS {k}" for k, sql in fx.BARCODE.items()) + f" FROM parts WHERE {fx.BARCODE_FOUND})"
)


def _renamed(ctes: list[str], tag: str) -> list[str]:
    """CTE texts of one family under names of their own, so that families can share a query."""
    names = {m for text in ctes for m in re.findall(r"(?:^|\n)(\w+) AS \(", text)}
    pattern = re.compile(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")(?= AS \(| WHERE|\)|$|,\n| JOIN)")
    return [pattern.sub(lambda m: f"{tag}_{m.group(1)}", text) for text in ctes]


UNION_CTES: list[str] = []
_PARTS = []
for _tag, _ctes, _told, _nutri in [
    ("feed", [*FEED_ALL, f"listed AS (SELECT *, {p.ingredients('text')} AS ing, tags_text || ' ' || product_type AS lab FROM shop)",
              p.facts_ctes("told", "listed", "ing", "lab")], True, "text <> ''"),
    ("affiliate", [AFFILIATE, AFFILIATE_SHOP, p.facts_ctes("told", "shop", "ingredients", "about")], True, "false"),
    ("market", [MARKETPLACE, MARKET_SHOP, p.facts_ctes("told", "shop", "ingredients", "labels", "named")], True,
     "protein_g IS NOT NULL OR servings_per_container IS NOT NULL"),
    ("grocer", [GROCER, GROCER_SHOP, p.facts_ctes("told", "shop", "CAST(NULL AS STRING)", "labels", "named")], True, "false"),
    ("auction", [AUCTION, AUCTION_SHOP], False, "false"),
    ("page", [PAGE, NODE, PAGE_SHOP], False, "protein_g IS NOT NULL OR serving_size_g IS NOT NULL"),
]:
    UNION_CTES += _renamed(_ctes, _tag)
    _fact = f"variant_id || source_variant_id IN (SELECT variant_id || source_variant_id FROM {_tag}_told)" if _told else "false"
    _PARTS.append(f"SELECT source_slug, currency, price_cents, upc, {_fact} AS fact, {_nutri} AS nutri FROM {_tag}_shop")
UNION_CTES.append("all_shops AS (" + " UNION ALL ".join(_PARTS) + ")")

ORACLE: dict[str, str] = {
    "scan_sources": with_keys("SELECT slug, name, type, base_url, market, coalesce(enabled, true) AS enabled FROM sources"),
    "enabled_sources": with_keys("SELECT slug, type, base_url, market FROM sources WHERE coalesce(enabled, true)"),
    "sources_by_slug": with_keys(
        "SELECT slug, type, market FROM sources WHERE slug IN (SELECT 'supplier-' || lpad(CAST(c_custkey AS STRING), 9, '0') FROM customer)"
    ),
    "currency_for_market": with_keys(f"SELECT slug, market, {CURRENCY} AS currency FROM sources"),
    "scan_shopify_feed": with_keys(
        "SELECT source_slug, CAST(query AS INTEGER) AS query, pk // 25 AS page, CAST(row_number() OVER (PARTITION BY source_slug, query, pk // 25 ORDER BY pk) - 1 AS INTEGER) AS pos, pk * 1000 + sk AS id, handle "
        "FROM (SELECT *, unnest(CASE WHEN pk % 3 = 0 THEN [0, 1] ELSE [0] END) AS query FROM items)", FEED
    ),
    "first_seen_dedupe": with_keys(
        f"SELECT source_slug, {PLACE}, CAST(row_number() OVER (PARTITION BY source_slug, pk // 25 ORDER BY pk) - 1 AS INTEGER) AS pos, pk * 1000 + sk AS id FROM items", FEED
    ),
    "scan_walmart_search": scan(AFFILIATE, "item_id", POWDER_AFFILIATE),
    "scan_amazon_search": scan(MARKETPLACE, "asin", f"asin <> '' AND {POWDER_MARKETPLACE}"),
    "scan_kroger_products": scan(GROCER, "product_code", f"product_code <> '' AND {POWDER_GROCER}"),
    "scan_ebay_summaries": scan(AUCTION, "item_id", f"item_id <> '' AND {POWDER_AUCTION}"),
    "unwrap_walmart_lookup": with_keys("SELECT item_id, name FROM items WHERE pk % 3 <> 2", AFFILIATE),
    "scan_off_products": "WITH " + BARCODES + " SELECT upc, serving_size, label_tag AS labels, product_quantity FROM barcodes",
    "to_float": with_keys("SELECT pk, sk, TRY_CAST(feedback AS DOUBLE) AS feedback FROM items", AUCTION),
    "sitemap_urls": f"WITH {SITES} SELECT site, CAST(pos AS INTEGER) AS pos, url FROM sites WHERE regexp_matches(url, 'page=[0-9]+')",
    "page_url_set": f"WITH {SITES},\n{URLS} SELECT {URL_COLUMNS} FROM firsts",
    "url_concat_dedupe": f"WITH {SITES},\n{URLS} SELECT {URL_COLUMNS} FROM firsts",
    "changed_content": f"SELECT doc_id, {BYTES} AS content_hash FROM documents WHERE lang = 'fr'",
    "powder_filter_shopify": powder(FEED, "pk * 1000 + sk", POWDER_FEED),
    "powder_filter_by_source": powder(FEED, "pk * 1000 + sk", f"CASE sk % 5 WHEN 0 THEN {p.has(FEED_TEXT, ['supplement', 'shaker'])} AND NOT {p.has(FEED_TEXT, vocab.FEED_EXCLUDE)} "
                                      f"WHEN 1 THEN contains({FEED_TEXT}, 'protein') AND NOT contains({FEED_TEXT}, 'casein') WHEN 2 THEN {p.has(FEED_TEXT, ['whey', 'vegan'])} ELSE {POWDER_FEED} END"),
    "powder_filter_walmart": powder(AFFILIATE, "item_id", POWDER_AFFILIATE),
    "powder_filter_amazon": powder(MARKETPLACE, "asin", POWDER_MARKETPLACE),
    "powder_filter_kroger": powder(GROCER, "product_code", POWDER_GROCER),
    "powder_filter_ebay": powder(AUCTION, "item_id", POWDER_AUCTION),
    "currency_guard": with_keys(f"SELECT pk, sk, market, currency FROM items WHERE coalesce(currency, {CURRENCY}) = {CURRENCY}", AUCTION),
    "priced_only": with_keys(f"SELECT pk, sk, price_cents FROM (SELECT pk, sk, {p.cents('price')} AS price_cents FROM items) WHERE price_cents > 0", MARKETPLACE),
    "markdown_amazon": with_keys(
        f"SELECT pk, sk, CASE WHEN c > x THEN c END AS compare_at_price_cents FROM (SELECT pk, sk, {p.cents('price')} AS x, {p.cents('original')} AS c FROM items)", MARKETPLACE
    ),
    "join_walmart_lookup": with_keys(f"SELECT source_slug, item_id, {p.cents_num('sale_price - 1.0::double')} AS price_cents FROM items WHERE pk % 3 <> 2", AFFILIATE),
    "normalize_shopify": with_keys(f"SELECT {CORE} FROM shop", *FEED_ALL),
    "normalize_walmart": with_keys(f"SELECT {AFF_CORE} FROM shop", AFFILIATE, AFFILIATE_SHOP),
    "normalize_amazon": with_keys(f"SELECT {CORE} FROM shop", MARKETPLACE, MARKET_SHOP),
    "normalize_kroger": with_keys(f"SELECT {CORE} FROM shop", GROCER, GROCER_SHOP),
    "normalize_ebay": with_keys(f"SELECT {CORE} FROM shop", AUCTION, AUCTION_SHOP),
    "normalize_jsonld": with_keys(f"SELECT {CORE} FROM shop", PAGE, NODE, PAGE_SHOP),
    "facts_shopify": facts_query(
        [*FEED_ALL, f"listed AS (SELECT *, {p.ingredients('text')} AS ing, tags_text || ' ' || product_type AS lab FROM shop)"], "listed", "ing", "lab"
    ),
    "facts_walmart": facts_query([AFFILIATE, AFFILIATE_SHOP], "shop", "ingredients", "about"),
    "amazon_facts": facts_query([MARKETPLACE, MARKET_SHOP], "shop", "ingredients", "labels", "named"),
    "facts_kroger": facts_query([GROCER, GROCER_SHOP], "shop", "CAST(NULL AS STRING)", "labels", "named"),
    "fill_servings": with_keys(
        "SELECT source_slug, source_variant_id, " + ", ".join(
            (f"{FILLED} AS {k}" if k == "servings_per_container" else f"p_{k} AS {k}") for k in p.facts_fields("x")
        ) + ", 'html_parse' AS extraction_method FROM shop WHERE text <> ''", *FEED_ALL
    ),
    "amazon_nutrition": with_keys(
        f"SELECT source_slug, source_variant_id, {NUTRITION} FROM shop WHERE protein_g IS NOT NULL OR servings_per_container IS NOT NULL", MARKETPLACE, MARKET_SHOP
    ),
    "nutrition_jsonld": with_keys(
        f"SELECT source_slug, source_variant_id, {NUTRITION} FROM shop WHERE protein_g IS NOT NULL OR serving_size_g IS NOT NULL", PAGE, NODE, PAGE_SHOP
    ),
    "join_amazon_details": with_keys(
        "SELECT source_slug, pk, has_d AND asin <> '' AS has_details, d_title AS detail_title FROM items", MARKETPLACE
    ),
    "join_ebay_item": with_keys(f"SELECT source_slug, pk, item_id, {GTIN} AS upc FROM items", AUCTION),
    "ebay_gtin": with_keys("SELECT item_id, " + GTIN.replace("has_item AND item_id <> ''", "true") + " AS upc FROM items WHERE has_item", AUCTION),
    "category_shopify": with_keys(
        f"SELECT source_slug, pk * 1000 + sk AS id, {p.category('t')} AS category FROM (SELECT *, lower(title || ' ' || product_type || ' ' || CASE WHEN tag_style = 0 THEN tag_a || ' ' || tag_b ELSE tag_a || ', ' || tag_b END) AS t FROM items)", FEED
    ),
    "nutrition_shopify": with_keys(
        "SELECT handle AS source_sku, " + ", ".join(f"CASE WHEN {INCOMPLETE} THEN coalesce(p_{k}, {v}) ELSE p_{k} END AS {k}" for k, v in FALLBACK.items())
        + f", CASE WHEN {INCOMPLETE} AND (" + " OR ".join(f"(p_{k} IS NULL AND {v} IS NOT NULL)" for k, v in FALLBACK.items())
        + ") THEN 'llm' ELSE 'html_parse' END AS extraction_method FROM parsed WHERE text <> ''", FEED, FEED_TEXTS, FEED_PARSED
    ),
    "jsonld_products": with_keys(
        "SELECT source_slug, pk, CAST(0 AS INTEGER) AS pos, 'Related item' AS name FROM items WHERE wrap_style = 1 UNION ALL "
        "SELECT source_slug, pk, CAST(wrap_style = 1 AS INTEGER), name FROM items", PAGE
    ),
    "jsonld_pick": with_keys("SELECT source_slug, pk, node_name AS name FROM node", PAGE, NODE),
    "jsonld_offer": with_keys(
        f"SELECT source_slug, pk, {p.cents(OFFER_PRICE)} AS price_cents, CASE WHEN offer_style <> 3 THEN currency END AS currency FROM items", PAGE
    ),
    "jsonld_brand": with_keys("SELECT source_slug, pk, CASE WHEN brand_style < 2 AND NOT bare THEN brand END AS brand FROM node", PAGE, NODE),
    "amazon_brand": with_keys(f"SELECT i.source_slug, i.pk, {MARKET_BRAND} AS brand_name FROM items i", MARKETPLACE),
    "amazon_upc": with_keys(f"SELECT i.source_slug, i.pk, {MARKET_UPC} AS upc FROM items i", MARKETPLACE),
    "union_normalized": with_keys(
        "SELECT source_slug, currency, count(*) AS variants, CAST(sum(price_cents) AS BIGINT) AS cents, count(upc) AS coded, "
        "count(*) FILTER (WHERE fact) AS with_facts, count(*) FILTER (WHERE nutri) AS with_nutrition FROM all_shops GROUP BY 1, 2",
        *UNION_CTES,
    ),
}
