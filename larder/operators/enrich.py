"""Filling missing nutrition and facts from a barcode database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.facets import add_facts
from larder.functions.nutrition import barcode_nutrition
from larder.functions.text import stage
from larder.operators.quality import route_validated, validate_nutrition


def variants_missing(variants: DataFrame, having: DataFrame) -> DataFrame:
    """Variants with a barcode and no row in ``having``."""
    coded = variants.filter(F.col("upc").isNotNull()).select("variant_id", "upc", "size_g")
    return coded.join(having.select("variant_id"), "variant_id", "left_anti")


def next_batch(missing: DataFrame, cap: int | None = None) -> DataFrame:
    """The worklist of one pass: all of it, or the first ``cap`` in id order."""
    return missing if cap is None else missing.orderBy("variant_id").limit(cap)


def one_per_barcode(barcode_products: DataFrame) -> DataFrame:
    """A lookup landed twice must not multiply its variants; of different ones one stays, always the same."""
    return barcode_products.groupBy("upc").agg(F.max_by("product", F.to_json("product")).alias("product"))


def enrich_by_upc(missing: DataFrame, barcode_products: DataFrame) -> DataFrame:
    """Worklist joined with the barcode database and parsed; one row per hit. Only the worklist can
    hold a barcode often, and adaptive execution splits such a side."""
    hits = missing.join(one_per_barcode(barcode_products), "upc")
    return stage(hits, {"n": barcode_nutrition(F.col("product"), F.col("size_g"))})


def enrich_nutrition(missing: DataFrame, barcode_products: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = enrich_by_upc(missing, barcode_products).filter(F.col("n").isNotNull())
    checked = validate_nutrition(parsed.select("variant_id", "size_g", "n.*"))
    return route_validated(checked, enrichment=True)


def barcode_facts(hits: DataFrame) -> DataFrame:
    """Adds ``facts`` from a barcode product: scanned tags united with its structured ones."""
    product = F.col("product")
    text = F.coalesce(
        F.nullif(product["ingredients_text"], F.lit("")), product["ingredients_text_en"]
    )
    return add_facts(
        hits, text, allergen_tags=product["allergens_tags"], label_tags=product["labels_tags"]
    )


def enrich_facts(missing: DataFrame, barcode_products: DataFrame) -> DataFrame:
    hits = missing.join(one_per_barcode(barcode_products), "upc")
    told = barcode_facts(hits).filter(F.col("facts").isNotNull())
    return told.select("variant_id", "facts.*")


def enrich_stats(
    missing: DataFrame, accepted: DataFrame, issues: DataFrame, facts: DataFrame
) -> DataFrame:
    """How many were checked, enriched, given facts, and rejected."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("what"))

    rows = (
        tagged(missing, "checked").unionAll(tagged(accepted, "enriched"))
        .unionAll(tagged(facts, "facts_enriched")).unionAll(tagged(issues, "issues"))
    )
    return rows.agg(
        *[
            F.count_if(F.col("what") == name).alias(name)
            for name in ("checked", "enriched", "facts_enriched", "issues")
        ]
    )
