"""Nutrition facts from page text, HTML, barcode payloads and marketplace attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import (
    ENDS, NUM, WS, collapse_ws, exact_round, first_number, truthy,
)
from larder.functions.units import parse_servings, parse_weight_g

FIELDS = [
    "serving_size_g", "servings_per_container", "protein_g", "fat_g", "carb_g", "sugar_g",
    "calories_kcal",
]

# One pass over the markup: comments, scripts, styles, the head and every tag become a space.
MARKUP = (
    r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
    r"|<head(?:\s[^>]*)?>.*?</head\s*>|</?[a-z!][^>]*>"
)
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
]
# The label patterns that decide which number is which fact.
SERVING_SIZE = rf"(?i)serving size{WS}*[:\-]?{WS}*([^\n.;|]+)"
PROSE_PROTEIN = (
    rf"(?i){NUM}{WS}*g(?:rams)?{WS}+(?:of{WS}+)?(?:[a-z]+{WS}+){{0,2}}protein"
)
LABELS = {
    "protein": "protein",
    "fat": rf"(?:total{WS}+)?fat",
    "carb": rf"(?:total{WS}+)?(?:carbohydrates?|carbs?)",
    "sugar": rf"(?:total{WS}+|added{WS}+)?sugars?",
    "servings": rf"servings?{WS}*per{WS}*container",
    "calories": "calories",
}


def html_to_text(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse_ws(text)


def search_grams(text: Column, label: str) -> Column:
    return first_number(text, rf"(?i){label}{WS}*[:\-]?{WS}*{NUM}{WS}*g{ENDS}")


def search_number(text: Column, label: str) -> Column:
    return first_number(text, rf"(?i){label}{WS}*[:\-]?{WS}*(?:about{WS}*)?{NUM}")


def search_protein(text: Column) -> Column:
    return F.coalesce(search_grams(text, LABELS["protein"]), first_number(text, PROSE_PROTEIN))


def parse_nutrition_text(text: Column) -> dict[str, Column]:
    """The seven fields of a facts blob, by field name; missing ones are null."""
    return {
        "serving_size_g": parse_weight_g(F.regexp_extract(text, SERVING_SIZE, 1)),
        "servings_per_container": F.coalesce(
            truthy(search_number(text, LABELS["servings"])), parse_servings(text)
        ),
        "protein_g": search_protein(text),
        "fat_g": search_grams(text, LABELS["fat"]),
        "carb_g": search_grams(text, LABELS["carb"]),
        "sugar_g": search_grams(text, LABELS["sugar"]),
        "calories_kcal": search_number(text, LABELS["calories"]),
    }


def is_complete(protein: Column, servings: Column) -> Column:
    return protein.isNotNull() & servings.isNotNull()


def merge_nutrition(
    base: dict[str, Column], fallback: dict[str, Column], method: Column
) -> dict[str, Column]:
    """Fill nulls from the fallback; the method becomes ``llm`` when anything was filled."""
    filled = F.lit(False)
    merged: dict[str, Column] = {}
    for name in FIELDS:
        merged[name] = F.coalesce(base[name], fallback[name])
        filled = filled | (base[name].isNull() & fallback[name].isNotNull())
    merged["extraction_method"] = F.when(filled, "llm").otherwise(method)
    return merged


def derived_servings(size_g: Column, serving_g: Column) -> Column:
    """Servings from the container and serving weights, when both are known and non-zero."""
    return exact_round(F.when(size_g != 0, F.try_divide(size_g, serving_g)), 1)


def fill_servings(
    servings: Column, texts: list[Column], size_g: Column, serving_g: Column
) -> Column:
    """Known servings, else the first text with a non-zero count, else from the weights."""
    counted = [truthy(parse_servings(t)) for t in texts]
    return F.coalesce(servings, *counted, derived_servings(size_g, serving_g))


def per_serving(direct: Column, per_100g: Column, serving_g: Column) -> Column:
    scaled = F.when(serving_g != 0, exact_round(per_100g * serving_g / 100.0, 2))
    return F.coalesce(exact_round(direct, 2), scaled)


def barcode_nutrition(product: Column, size_g: Column) -> Column:
    """Per-serving facts of a barcode-database product; null when neither protein nor the serving
    size is known."""
    def nutriment(name: str) -> Column:
        return F.try_element_at(product["nutriments"], F.lit(name)).try_cast("double")

    serving_g = F.coalesce(
        truthy(product["serving_quantity"].try_cast("double")),
        parse_weight_g(product["serving_size"]),
    )
    quantity = product["product_quantity"].try_cast("double")
    has_serving = serving_g != 0
    servings = F.when(
        (quantity != 0) & has_serving, exact_round(F.try_divide(quantity, serving_g), 1)
    ).when((size_g >= 300) & has_serving, exact_round(F.try_divide(size_g, serving_g), 1))
    values = {
        "serving_size_g": serving_g,
        "servings_per_container": servings,
        "protein_g": per_serving(nutriment("proteins_serving"), nutriment("proteins_100g"), serving_g),
        "fat_g": per_serving(nutriment("fat_serving"), nutriment("fat_100g"), serving_g),
        "carb_g": per_serving(
            nutriment("carbohydrates_serving"), nutriment("carbohydrates_100g"), serving_g
        ),
        "sugar_g": per_serving(nutriment("sugars_serving"), nutriment("sugars_100g"), serving_g),
        "calories_kcal": per_serving(
            nutriment("energy-kcal_serving"), nutriment("energy-kcal_100g"), serving_g
        ),
        "extraction_method": F.lit("open_food_facts"),
    }
    record = F.struct(*[col.alias(name) for name, col in values.items()])
    return F.when(values["protein_g"].isNotNull() | serving_g.isNotNull(), record)
