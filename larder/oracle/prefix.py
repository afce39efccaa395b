"""SQL text that gives the checking database the same input tables, plus small SQL builders.

Inputs share the expressions in ``larder.sources.fixtures``; every rule below is written again in
SQL, apart from the Spark code it checks.
"""

from __future__ import annotations

from larder.functions import vocab
from larder.sources import fixtures as fx

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOTWORD = r"[^\p{L}\p{N}_]"
END = rf"(?:{NOTWORD}|$)"
START = rf"(?:^|{NOTWORD})"
NUM = r"([0-9]+(?:\.[0-9]+)?)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def case(pairs: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in pairs.items()) + f" ELSE {default} END"


def brand(x: str) -> str:
    return case({k: q(v) for k, v in vocab.BRAND_ALIASES.items()}, plain(x), plain(x))


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def number(x: str, pattern: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, {q(pattern)}, 1) AS DOUBLE)"


def rounded(x: str, digits: int) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE) END"


UNITS = "|".join(vocab.KG_UNITS + vocab.LB_UNITS + vocab.OZ_UNITS + vocab.G_UNITS)


def factor(unit: str) -> str:
    return (
        f"CASE WHEN left(lower({unit}), 1) = 'k' THEN 1000.0::double "
        f"WHEN left(lower({unit}), 1) IN ('l', 'p') THEN 453.59237::double "
        f"WHEN left(lower({unit}), 1) = 'o' THEN 28.349523125::double "
        f"WHEN left(lower({unit}), 1) = 'g' THEN 1.0::double END"
    )


def weight_raw(x: str) -> str:
    p = rf"(?i)([0-9]+(?:[.,][0-9]+)?){WS}*({UNITS}){END}"
    unit = f"regexp_extract({x}, {q(p)}, 2)"
    return f"(TRY_CAST(replace(regexp_extract({x}, {q(p)}, 1), ',', '.') AS DOUBLE) * {factor(unit)})"


def weight(x: str) -> str:
    return rounded(weight_raw(x), 3)


def container(x: str) -> str:
    """Largest lb/kg/oz token, else the largest gram token from 300 up."""
    def tokens(units: str) -> str:
        p = rf"(?i)[0-9]+(?:[.,][0-9]+)?{WS}*(?:{units}){END}"
        return f"regexp_extract_all({x}, {q(p)})"

    one = weight_raw("t")
    big = f"list_max(list_transform({tokens('|'.join(vocab.KG_UNITS + vocab.LB_UNITS + vocab.OZ_UNITS))}, lambda t: {one}))"
    gram = f"list_max(list_filter(list_transform({tokens('|'.join(vocab.G_UNITS))}, lambda t: {one}), lambda g: g >= 300))"
    return rounded(f"coalesce({big}, {gram})", 3)


def multipack(x: str) -> str:
    p = (
        rf"(?i)(?:{START}pack of{WS}*[0-9]+|{START}[0-9]+{WS}*[-\s]?pack{END}|{START}twin pack{END}"
        rf"|{START}case of{WS}*[0-9]+|{START}bundle{END})"
    )
    return f"coalesce(regexp_matches({x}, {q(p)}), false)"


def servings(x: str) -> str:
    return number(x, rf"(?i){NUM}{WS}*servings?{END}")


def cents_num(x: str) -> str:
    return f"TRY_CAST(round_even(({x}) * 100.0::double, 0) AS INTEGER)"


def cents(x: str) -> str:
    return cents_num(f"TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DOUBLE)")


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def flavor(x: str) -> str:
    c = collapse(x)
    return f"CASE WHEN lower({c}) NOT IN ('default title', 'default', 'n/a', '') THEN {c} END"


def has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(c)}" for w, c in vocab.CATEGORY_KEYWORDS) + " END"


def tags(x: str, table: dict[str, list[str]]) -> str:
    """Sorted list of tags whose words occur in lower-case text ``x``."""
    marks = ", ".join(f"CASE WHEN {has(x, words)} THEN {q(tag)} END" for tag, words in table.items())
    return f"list_sort(list_filter([{marks}], lambda m: m IS NOT NULL))"


def joined(tag_list: str) -> str:
    return f"coalesce(array_to_string({tag_list}, ','), '')"


INGREDIENT_SECTION = (
    rf"(?is)ingredients?{WS}*[:\-]?{WS}*(.+?)(?:\.{WS}|\n\n|allergen|contains:|directions|suggested use|$)"
)


def ingredients(x: str) -> str:
    section = f"trim({collapse(f'regexp_extract({x}, {q(INGREDIENT_SECTION)}, 1)')}, ' .,;')"
    return f"CASE WHEN contains({section}, ',') THEN {section} END"


MARKUP = (
    r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
    r"|<head(?:\s[^>]*)?>.*?</head\s*>|</?[a-z!][^>]*>"
)


def html_text(x: str) -> str:
    out = f"regexp_replace({x}, {q(MARKUP)}, ' ', 'g')"
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return collapse(out)


def grams_after(x: str, label: str) -> str:
    return number(x, rf"(?i){label}{WS}*[:\-]?{WS}*{NUM}{WS}*g{END}")


def number_after(x: str, label: str) -> str:
    return number(x, rf"(?i){label}{WS}*[:\-]?{WS}*(?:about{WS}*)?{NUM}")


def protein(x: str) -> str:
    prose = rf"(?i){NUM}{WS}*g(?:rams)?{WS}+(?:of{WS}+)?(?:[a-z]+{WS}+){{0,2}}protein"
    return f"coalesce({grams_after(x, 'protein')}, {number(x, prose)})"


def serving_size(x: str) -> str:
    return weight(f"regexp_extract({x}, {q(rf'(?i)serving size{WS}*[:\-]?{WS}*([^' + chr(92) + 'n.;|]+)')}, 1)")


def facts_fields(x: str) -> dict[str, str]:
    total = rf"(?:total{WS}+)?"
    return {
        "serving_size_g": serving_size(x),
        "servings_per_container": f"coalesce(nullif({number_after(x, rf'servings?{WS}*per{WS}*container')}, 0), {servings(x)})",
        "protein_g": protein(x),
        "fat_g": grams_after(x, rf"{total}fat"),
        "carb_g": grams_after(x, rf"{total}(?:carbohydrates?|carbs?)"),
        "sugar_g": grams_after(x, rf"(?:total{WS}+|added{WS}+)?sugars?"),
        "calories_kcal": number_after(x, "calories"),
    }


NAME_SIZE = (
    rf"({START})[0-9]+(?:[.,][0-9]+)?{WS}*(?:{vocab.NAME_SIZE_UNITS})({END})"
)


def core_name(brand_x: str, name_x: str) -> str:
    """Brand words go by splitting into runs; sizes are replaced twice because neighbours share a
    boundary character."""
    words = f"list_concat(string_split({brand(brand_x)}, ' '), string_split({plain(brand_x)}, ' '))"
    runs = f"regexp_extract_all(lower({name_x}), {q(r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')})"
    text = f"array_to_string(list_transform({runs}, lambda r: CASE WHEN list_contains({words}, r) THEN ' ' ELSE r END), '')"
    for _ in range(2):
        text = f"regexp_replace({text}, {q('(?i)' + NAME_SIZE)}, '\\1 \\2', 'g')"
    dropped = ", ".join(q(w) for w in vocab.FLAVOR_WORDS + vocab.NOISE_WORDS)
    tokens = f"string_split(trim(regexp_replace({text}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"coalesce(array_to_string(list_filter({tokens}, lambda t: t <> '' AND t NOT IN ({dropped})), ' '), '')"


def dedup_key(brand_x: str, name_x: str) -> str:
    core = f"coalesce(nullif({core_name(brand_x, name_x)}, ''), {slug(name_x)})"
    return f"{slug(brand(brand_x))} || ':' || {slug(core)}"


ERRORS = {
    "missing_required": "protein_g IS NULL OR servings_per_container IS NULL",
    "negative_protein_g": "protein_g < 0",
    "negative_fat_g": "fat_g < 0",
    "negative_carb_g": "carb_g < 0",
    "negative_calories_kcal": "calories_kcal < 0",
    "negative_serving_size_g": "serving_size_g < 0",
    "negative_servings_per_container": "servings_per_container < 0",
    "protein_exceeds_serving": "protein_g > serving_size_g",
    "servings_below_min": "servings_per_container < 2",
    "implied_serving_too_big": "servings_per_container > 0 AND size_g / servings_per_container > 200",
}
WARNINGS = {
    "serving_size_range": "serving_size_g < 5 OR serving_size_g > 250",
    "servings_range": "servings_per_container < 1 OR servings_per_container > 400",
    "calories_disagree": (
        "calories_kcal > 0 AND abs(calories_kcal - (4.0::double * protein_g + 4.0::double * carb_g"
        " + 9.0::double * fat_g)) / calories_kcal > 0.30::double"
    ),
    "container_disagrees": (
        "size_g > 0 AND abs(serving_size_g * servings_per_container - size_g) / size_g > 0.25::double"
    ),
}
CONFIDENCE = {"manual": 1.0, "shopify_json": 0.9, "json_ld": 0.9, "html_parse": 0.7, "llm": 0.6}


def codes(rules: dict[str, str]) -> str:
    marks = ", ".join(f"CASE WHEN {cond} THEN {q(code)} END" for code, cond in rules.items())
    return f"list_filter([{marks}], lambda m: m IS NOT NULL)"


def validate_cte(name: str, source: str) -> str:
    base = case({k: f"{v}::double" for k, v in CONFIDENCE.items()}, "extraction_method", "0.5::double")
    score = rounded(f"greatest(0.0::double, {base} - 0.15::double * len(warnings))", 3)
    return (
        f"{name}_codes AS (SELECT *, {codes(ERRORS)} AS errors, {codes(WARNINGS)} AS warnings FROM {source}),\n"
        f"{name} AS (SELECT *, len(errors) = 0 AS ok, CASE WHEN len(errors) > 0 THEN 0.0::double ELSE {score} END AS confidence FROM {name}_codes)"
    )


def facts_ctes(name: str, source: str, list_x: str = "ingredients", label_x: str = "label_text",
               named_x: str = "''", extra_dietary: str | None = None, extra_allergens: str | None = None) -> str:
    """CTEs that add ``ingredients_text`` and three sorted tag lists to ``source``."""
    def united(scan: str, extra: str | None) -> str:
        return f"list_sort(list_distinct(list_concat({scan}, {extra})))" if extra else scan

    dietary = united(tags("_claims", vocab.DIETARY), extra_dietary)
    allergens = united(tags("CASE WHEN _named <> '' THEN _named ELSE _list END", vocab.ALLERGENS), extra_allergens)
    return (
        f"{name}_low AS (SELECT *, lower(coalesce({list_x}, '')) AS _list, lower(coalesce({label_x}, '')) AS _labels, "
        f"lower(coalesce({named_x}, '')) AS _named FROM {source}),\n"
        f"{name}_claims AS (SELECT *, _labels || ' ' || _list AS _claims FROM {name}_low),\n"
        f"{name}_scan AS (SELECT *, nullif({list_x}, '') AS ingredients_text_, {dietary} AS dietary_labels, "
        f"{allergens} AS allergens, {tags('_list', vocab.SWEETENERS)} AS sweeteners FROM {name}_claims),\n"
        f"{name} AS (SELECT * FROM {name}_scan WHERE ingredients_text_ IS NOT NULL OR len(dietary_labels) > 0 "
        f"OR len(allergens) > 0 OR len(sweeteners) > 0)"
    )


TIES = ", ".join(f"{c} DESC" for c in fx.TIE_COLUMNS)
KEYS = f"keys AS (SELECT DISTINCT {fx.VARIANT_ID} AS variant_id, l_partkey AS pk, l_suppkey AS sk FROM lineitem)"
SOURCES = (
    f"sources AS (SELECT s_suppkey AS source_id, {slug('s_name')} AS slug, s_name AS name, {fx.SOURCE_TYPE} AS type, "
    f"{fx.MARKET} AS market, 'https://' || {slug('s_name')} || '.example' AS base_url, {fx.ENABLED} AS enabled "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)
CURRENCY = "CASE market WHEN 'US' THEN 'USD' WHEN 'UK' THEN 'GBP' WHEN 'IN' THEN 'INR' ELSE 'USD' END"
FIELDS = ", ".join(f"{sql} AS {name}" for name, sql in fx.NUTRITION.items())

CATALOG = ",\n".join(
    [
        KEYS,
        SOURCES,
        f"brands AS (SELECT DISTINCT {slug(brand('p_brand'))} AS brand_id, p_brand AS name FROM part)",
        f"products AS (SELECT p_partkey AS product_id, {slug(brand('p_brand'))} AS brand_id, p_name AS name, lower(p_type) AS category FROM part)",
        f"listings AS (SELECT variant_id AS listing_id, sk AS source_id, pk AS product_id, 'https://shop.example/p/' || variant_id AS url FROM keys)",
        f"variants AS (SELECT variant_id, variant_id AS listing_id, {fx.FLAVOR} AS flavor, {fx.SIZE_G} AS size_g, {fx.UPC} AS upc, {fx.COMPARE_AT} AS compare_at_price_cents FROM keys)",
        f"prices AS (SELECT {fx.VARIANT_ID} AS variant_id, l_partkey AS product_id, {fx.PRICE_CENTS} AS price_cents, {CURRENCY} AS currency, l_linestatus = 'O' AS in_stock, l_shipdate AS captured_at, {', '.join(fx.TIE_COLUMNS)} FROM lineitem JOIN sources ON source_id = l_suppkey)",
        f"latest AS (SELECT variant_id, price_cents, currency, in_stock, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY captured_at DESC, {TIES}) AS rn FROM prices) WHERE rn = 1)",
        f"candidates AS (SELECT variant_id, sk, {fx.SIZE_G} AS size_g, {FIELDS} FROM keys WHERE {fx.HAS_NUTRITION})",
        validate_cte("checked", "candidates"),
        "nutrition AS (SELECT variant_id, serving_size_g, servings_per_container, protein_g, fat_g, carb_g, sugar_g, calories_kcal, extraction_method, confidence FROM checked WHERE ok)",
        f"fact_inputs AS (SELECT variant_id, {fx.INGREDIENTS} AS ingredients, {fx.LABEL_TEXT} AS label_text FROM keys WHERE {fx.HAS_INGREDIENTS})",
        facts_ctes("facts", "fact_inputs"),
        """offers AS (SELECT v.variant_id, v.listing_id, l.product_id, s.source_id, s.slug AS source_slug, s.type AS source_type, s.market,
  b.name AS brand_name, p.name AS product_name, p.category, v.flavor, v.size_g, l.url, lp.price_cents, lp.currency, lp.in_stock, lp.captured_at,
  v.compare_at_price_cents, n.serving_size_g, n.servings_per_container, n.protein_g, n.fat_g, n.carb_g, n.calories_kcal,
  coalesce(n.confidence, 0.0::double) AS confidence, f.ingredients_text_ AS ingredients_text,
  coalesce(f.dietary_labels, []) AS dietary_labels, coalesce(f.allergens, []) AS allergens, coalesce(f.sweeteners, []) AS sweeteners,
  n.servings_per_container * n.protein_g AS total_protein_g,
  CASE WHEN lp.price_cents > 0 THEN (n.servings_per_container * n.protein_g) / (lp.price_cents / 100.0::double) END AS protein_per_dollar,
  CASE WHEN n.servings_per_container * n.protein_g > 0 THEN (lp.price_cents / 100.0::double) / ((n.servings_per_container * n.protein_g) / 30.0::double) END AS cost_per_30g_protein,
  CASE WHEN n.serving_size_g > 0 THEN n.protein_g / n.serving_size_g END AS protein_pct_weight,
  CASE WHEN n.protein_g > 0 THEN n.fat_g / n.protein_g END AS fat_per_protein,
  CASE WHEN n.protein_g > 0 THEN n.calories_kcal / n.protein_g END AS calories_per_protein,
  CASE WHEN n.servings_per_container > 0 THEN (lp.price_cents / 100.0::double) / n.servings_per_container END AS price_per_serving
FROM variants v JOIN listings l ON l.listing_id = v.listing_id JOIN products p ON p.product_id = l.product_id
JOIN brands b ON b.brand_id = p.brand_id JOIN sources s ON s.source_id = l.source_id JOIN latest lp ON lp.variant_id = v.variant_id
LEFT JOIN nutrition n ON n.variant_id = v.variant_id LEFT JOIN facts f ON f.variant_id = v.variant_id)""",
    ]
)


def with_catalog(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CATALOG, *ctes]) + "\n" + body


def with_keys(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([KEYS, SOURCES, *ctes]) + "\n" + body
