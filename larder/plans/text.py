"""Text queries: units, identity, facets and nutrition over whole tables, and the quality rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import facets, identity, units
from larder.functions import nutrition as nut
from larder.functions import html as markup
from larder.functions.text import collapse_ws, stage
from larder.operators import enrich, quality, resolve
from larder.plans.catalog import enrichment, flat, validated
from larder.session import shared_folder
from larder.sources import fixtures as fx
from larder.sources import bucketed, feeds, landed
from larder.sources.adapter import StarCatalog

TAGS = ("dietary_labels", "allergens", "sweeteners")


def titles(cat: StarCatalog) -> DataFrame:
    """One retailer wording per variant: brand, title, price text and flavor text."""
    return stage(
        cat.variant_keys,
        {
            "title": F.expr(fx.TITLE), "brand": F.expr(fx.TITLE_BRAND),
            "price_text": F.expr(fx.PRICE_TEXT), "flavor_text": F.expr(fx.FLAVOR_TEXT),
        },
    )


def documents(cat: StarCatalog) -> DataFrame:
    """Whole document texts, each followed by a facts sentence and an ingredient section."""
    docs = cat.table("documents").select("doc_id", "text", F.col("doc_id").alias("n"))
    told = F.concat("text", F.expr(fx.FACTS_TEXT), F.lit("\n\n"), F.expr(fx.INGREDIENT_TEXT))
    return stage(docs, {"body": told}).select("doc_id", "body")


def pages(cat: StarCatalog) -> DataFrame:
    """Whole page markup with a facts block before the end of the body."""
    rows = cat.table("pages").select("page_id", "url", "html", F.col("page_id").alias("n"))
    block = F.concat(F.lit("<div><b>"), F.expr(fx.FACTS_TEXT), F.lit("</b></div></body>"))
    return stage(rows, {"markup": F.replace("html", F.lit("</body>"), block)})


def lowered(cat: StarCatalog) -> DataFrame:
    return stage(documents(cat), {"low": F.lower("body")})


def page_text(cat: StarCatalog) -> DataFrame:
    return stage(pages(cat), {"text": nut.html_to_text(F.col("markup"))})


def page_nutrition(cat: StarCatalog) -> DataFrame:
    return page_text(cat).select(
        "page_id", *[c.alias(n) for n, c in nut.parse_nutrition_text(F.col("text")).items()]
    )


def _title(name: str, column):
    return lambda cat: titles(cat).select("variant_id", column().alias(name))


def _doc(name: str, column):
    return lambda cat: documents(cat).select("doc_id", column().alias(name))


def _tags(name: str, scan):
    return lambda cat: lowered(cat).select("doc_id", F.array_join(scan(F.col("low")), ",").alias(name))


def standardise_listings(cat: StarCatalog) -> DataFrame:
    title = F.col("title")
    return titles(cat).select(
        "variant_id", units.parse_weight_g(title).alias("weight_g"),
        units.parse_container_g(title).alias("container_g"), units.is_multipack(title).alias("multipack"),
        units.parse_servings(title).alias("servings"),
        units.cents_from_text(F.col("price_text")).alias("price_cents"),
        units.clean_flavor(F.col("flavor_text")).alias("flavor"),
    )


def keyed_titles(cat: StarCatalog) -> DataFrame:
    keyed = titles(cat).withColumns(
        {"dedup_key": identity.product_dedup_key(F.col("brand"), F.col("title")), "upc": F.expr(fx.UPC)}
    )
    return keyed.select(
        "variant_id", "sk", "upc", "dedup_key", F.expr("pk % 3").alias("position"),
        F.concat_ws("-", "sk", F.expr("pk div 3")).alias("listing_id"),  # three variants to a listing
    )


def stored_titles(cat: StarCatalog) -> DataFrame:
    """The keyed titles by listing: names are parsed once, and work per listing needs no shuffle."""
    name = f"titles_{uuid.uuid4().hex}"
    return bucketed.save(keyed_titles(cat), name, f"{shared_folder(cat.spark)}/{name}", bucketed.bucket_count(cat.spark), key="listing_id")


def resolved(cat: StarCatalog) -> DataFrame:
    """Incoming offers of every source but the earliest two, against those sources' barcodes."""
    keyed = stored_titles(cat)
    known = keyed.filter((F.col("sk") < 2) & F.col("upc").isNotNull()).groupBy("upc").agg(
        F.min("dedup_key").alias("product_key")
    )
    incoming = keyed.filter(F.col("sk") >= 2).drop("sk")
    return resolve.resolve_products(incoming, known).drop("position")


def resolved_chains(cat: StarCatalog) -> DataFrame:
    """The same offers where listings that barcodes tie together in any number of steps are one product."""
    keyed = stored_titles(cat)
    known = keyed.filter("sk < 2").select(F.col("dedup_key").alias("product_key"), "upc")
    return resolve.resolve_chains(keyed.filter("sk >= 2").drop("sk"), known).drop("position")


def told_documents(cat: StarCatalog) -> DataFrame:
    docs = stage(documents(cat), {"ingredients": facets.extract_ingredients(F.col("body"))})
    return facets.add_facts(docs, F.col("ingredients"), F.col("body"))


def merged(cat: StarCatalog) -> DataFrame:
    """Page nutrition filled from another table where a field is missing."""
    parsed = page_nutrition(cat).select("page_id", *[F.col(f).alias(f"a_{f}") for f in nut.FIELDS])
    other = cat.table("pages").select(
        "page_id", F.lit(30.0).alias("serving_size_g"), F.lit(None).cast("double").alias("servings_per_container"),
        F.when(F.length("url") % 2 == 0, 21.0).alias("protein_g"), F.lit(2.0).alias("fat_g"),
        F.lit(3.0).alias("carb_g"), F.lit(1.0).alias("sugar_g"), F.lit(100.0).alias("calories_kcal"),
    )
    out = nut.merge_nutrition(
        {f: F.col(f"a_{f}") for f in nut.FIELDS}, {f: F.col(f) for f in nut.FIELDS}, F.lit("html_parse")
    )
    return parsed.join(other, "page_id", "left").select("page_id", *[c.alias(n) for n, c in out.items()])


def barcode_hits(cat: StarCatalog) -> DataFrame:
    return feeds.scan_barcodes(landed.barcode_lookups(cat))


def off_nutrition(cat: StarCatalog) -> DataFrame:
    missing, barcodes = enrichment(cat)
    return enrich.enrich_by_upc(missing, barcodes).filter(F.col("n").isNotNull()).select("variant_id", "n.*")


def off_facts(cat: StarCatalog) -> DataFrame:
    told = enrich.barcode_facts(barcode_hits(cat)).filter(F.col("facts").isNotNull())
    return flat(told.select("upc", "facts.*"))


def per_serving(cat: StarCatalog) -> DataFrame:
    n = F.col("product.nutriments")
    get = lambda name: F.try_element_at(n, F.lit(name)).try_cast("double")
    grams = F.col("product.serving_quantity").try_cast("double")
    return barcode_hits(cat).select(
        "upc", nut.per_serving(get("proteins_serving"), get("proteins_100g"), grams).alias("protein_g"),
        nut.per_serving(get("fat_serving"), get("fat_100g"), grams).alias("fat_g"),
    )


def facts_union(cat: StarCatalog) -> DataFrame:
    scanned = stage(barcode_hits(cat), {"low": F.lower(F.coalesce("product.ingredients_text", F.lit("")))})
    mapped = facets.map_tags(F.col("product.allergens_tags"), facets.vocab.BARCODE_ALLERGEN_TAGS)
    return scanned.select(
        "upc", F.array_join(facets.union_tags(facets.scan_allergens(F.col("low")), mapped), ",").alias("allergens")
    )


def _rule(condition, *columns: str):
    return lambda cat: cat.nutrition_candidates.filter(condition()).select("variant_id", *columns)


def negatives(cat: StarCatalog) -> DataFrame:
    rules = {f: quality.is_negative(f) for f in quality.NON_NEGATIVE}
    named = stage(cat.nutrition_candidates, {"fields": quality.tags_where(rules)})
    return named.filter(F.size("fields") > 0).select("variant_id", F.array_join("fields", ",").alias("fields"))


def checked(cat: StarCatalog) -> DataFrame:
    return validated(cat).select(
        "variant_id", "ok", "confidence", F.array_join("errors", ",").alias("errors"),
        F.array_join("warnings", ",").alias("warnings"),
    )


def issues(cat: StarCatalog) -> DataFrame:
    return quality.route_validated(validated(cat))[1].select("variant_id", "stage", "severity", "codes")


QUERIES = {
    "parse_weight_g": _title("weight_g", lambda: units.parse_weight_g(F.col("title"))),
    "parse_container_g": _title("container_g", lambda: units.parse_container_g(F.col("title"))),
    "is_multipack": _title("multipack", lambda: units.is_multipack(F.col("title"))),
    "parse_servings": _title("servings", lambda: units.parse_servings(F.col("title"))),
    "to_cents": _title("price_cents", lambda: units.cents_from_text(F.col("price_text"))),
    "clean_flavor": _title("flavor", lambda: units.clean_flavor(F.col("flavor_text"))),
    "standardise_listings": standardise_listings,
    "parse_weight_g_documents": _doc("weight_g", lambda: units.parse_weight_g(F.col("body"))),
    "parse_container_g_documents": _doc("container_g", lambda: units.parse_container_g(F.col("body"))),
    "collapse_ws": _doc("collapsed", lambda: collapse_ws(F.col("body"))),
    "slugify": _title("slug", lambda: identity.slugify(F.col("title"))),
    "normalize_brand": _title("brand", lambda: identity.normalize_brand(F.col("brand"))),
    "brand_token_union": _title("tokens", lambda: F.array_join(identity.brand_tokens(F.col("brand")), ",")),
    "canonical_core_name": _title("core", lambda: identity.canonical_core_name(F.col("brand"), F.col("title"))),
    "product_dedup_key": _title("dedup_key", lambda: identity.product_dedup_key(F.col("brand"), F.col("title"))),
    "dedup_key_parts": lambda cat: cat.products.select("product_id", "dedup_key"),
    "gtin_normalize": lambda cat: cat.variants.select("variant_id", identity.gtin_normalize(F.col("upc")).alias("gtin")),
    "resolve_products": resolved,
    "resolve_product_chains": resolved_chains,
    "resolve_identity": lambda cat: resolved(cat).groupBy("product_key").agg(
        F.count(F.lit(1)).alias("offers"), F.count_if("by_existing_upc").alias("by_upc")),
    "classify_category": lambda cat: lowered(cat).select("doc_id", facets.classify_category(F.col("low")).alias("category")),
    "scan_dietary": _tags("dietary_labels", facets.scan_dietary),
    "scan_allergens": _tags("allergens", facets.scan_allergens),
    "scan_sweeteners": _tags("sweeteners", facets.scan_sweeteners),
    "extract_ingredients": _doc("ingredients", lambda: facets.extract_ingredients(F.col("body"))),
    "derive_facts": lambda cat: flat(told_documents(cat).filter(F.col("facts").isNotNull()).select("doc_id", "facts.*")),
    "html_page_text": lambda cat: cat.table("pages").select("page_id", markup.page_text(F.col("html")).alias("text")),
    "html_to_text": lambda cat: cat.table("pages").select("page_id", nut.html_to_text(F.col("html")).alias("text")),
    "search_grams": lambda cat: page_text(cat).select("page_id", nut.search_grams(F.col("text"), nut.LABELS["fat"]).alias("fat_g")),
    "search_number": lambda cat: page_text(cat).select("page_id", nut.search_number(F.col("text"), nut.LABELS["calories"]).alias("kcal")),
    "search_protein": lambda cat: page_text(cat).select("page_id", nut.search_protein(F.col("text")).alias("protein_g")),
    "parse_nutrition_text": lambda cat: documents(cat).select(
        "doc_id", *[c.alias(n) for n, c in nut.parse_nutrition_text(F.col("body")).items()]),
    "parse_nutrition_html": page_nutrition,
    "nutrition_complete": lambda cat: page_nutrition(cat).select(
        "page_id", nut.is_complete(F.col("protein_g"), F.col("servings_per_container")).alias("complete")),
    "merge_nutrition": merged,
    "per_serving_from_100g": per_serving,
    "off_nutrition": off_nutrition,
    "enrich_by_upc": lambda cat: off_nutrition(cat).select("variant_id", "protein_g", "servings_per_container"),
    "off_facts": off_facts,
    "union_facts": facts_union,
    "rule_required": _rule(quality.is_missing_required, "protein_g"),
    "rule_negative": negatives,
    "rule_protein_le_serving": _rule(quality.is_protein_over_serving, "protein_g", "serving_size_g"),
    "rule_min_servings": _rule(quality.is_below_min_servings, "servings_per_container"),
    "rule_implied_serving": _rule(quality.is_implied_serving_too_big, "size_g", "servings_per_container"),
    "rule_serving_range": _rule(quality.is_serving_size_odd, "serving_size_g"),
    "rule_servings_range": _rule(quality.is_servings_odd, "servings_per_container"),
    "rule_atwater": _rule(quality.is_calories_off, "calories_kcal"),
    "rule_container_math": _rule(quality.is_container_off, "size_g"),
    "confidence_score": lambda cat: validated(cat).select("variant_id", "extraction_method", "confidence"),
    "validate_nutrition": checked,
    "route_validated": issues,
    "route_accepted": lambda cat: quality.route_validated(validated(cat))[0].select("variant_id", "confidence"),
}
