"""Categories and ingredient facets by substring scans over lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.text import (
    WS, blank_to_null, collapse_ws, contains_any, let, lookup, stage, tags_where,
)

INGREDIENTS = (
    rf"(?is)ingredients?{WS}*[:\-]?{WS}*(.+?)"
    rf"(?:\.{WS}|\n\n|allergen|contains:|directions|suggested use|$)"
)
FACT_FIELDS = ["ingredients_text", "dietary_labels", "allergens", "sweeteners"]


def empty_tags() -> Column:
    return F.array().cast("array<string>")


def classify_category(lower_text: Column) -> Column:
    expr = F.when(F.contains(lower_text, F.lit(vocab.CATEGORY_KEYWORDS[0][0])),
                  vocab.CATEGORY_KEYWORDS[0][1])
    for word, category in vocab.CATEGORY_KEYWORDS[1:]:
        expr = expr.when(F.contains(lower_text, F.lit(word)), category)
    return expr


def scan(lower_text: Column, table: dict[str, list[str]]) -> Column:
    """Tags of ``table`` whose words occur in the text. Tags are laid out in name order, so the
    result is sorted without a sort per row. Pass a plain column: the text is read per word."""
    return tags_where({tag: contains_any(lower_text, table[tag]) for tag in sorted(table)})


def scan_dietary(lower_text: Column) -> Column:
    return scan(lower_text, vocab.DIETARY)


def scan_allergens(lower_text: Column) -> Column:
    return scan(lower_text, vocab.ALLERGENS)


def scan_sweeteners(lower_text: Column) -> Column:
    return scan(lower_text, vocab.SWEETENERS)


def extract_ingredients(text: Column, longest: int | None = None) -> Column:
    """The ingredient list inside a description: a comma list, with ``longest`` only up to that many
    characters, else null."""
    section = F.regexp_replace(
        collapse_ws(F.regexp_extract(text, INGREDIENTS, 1)), r"^[ .,;]+|[ .,;]+$", ""
    )
    fits = (lambda s: F.length(s) <= longest) if longest else (lambda s: F.lit(True))
    return let(section, lambda s: F.when(F.contains(s, F.lit(",")) & fits(s), s))


def add_facts(
    df: DataFrame,
    ingredients: Column,
    label_text: Column | None = None,
    explicit_allergens: Column | None = None,
    allergen_tags: Column | None = None,
    label_tags: Column | None = None,
    name: str = "facts",
) -> DataFrame:
    """Adds a facts struct, null when nothing is known.

    ``label_text`` holds claims and labels already joined by spaces. Non-empty
    ``explicit_allergens`` replaces the ingredient scan; structured tags of a barcode database are
    united with it. The lower-cased texts are columns of their own, so each is computed once per
    row and not once per word.
    """
    blank = F.lit("")
    named = F.array_join(explicit_allergens, " ") if explicit_allergens is not None else blank
    df = stage(
        df,
        {
            "_ingredients": blank_to_null(ingredients),
            "_list": F.lower(F.coalesce(ingredients, blank)),
            "_labels": F.lower(F.coalesce(label_text, blank)) if label_text is not None else blank,
            "_named": F.lower(F.coalesce(named, blank)),
        },
    )
    df = df.withColumns(
        {
            "_claims": F.concat(F.col("_labels"), F.lit(" "), F.col("_list")),
            "_allergy": F.when(F.col("_named") != "", F.col("_named")).otherwise(F.col("_list")),
        }
    )
    dietary, allergens = scan_dietary(F.col("_claims")), scan_allergens(F.col("_allergy"))
    if label_tags is not None:
        dietary = union_tags(dietary, map_tags(label_tags, vocab.BARCODE_LABEL_TAGS))
    if allergen_tags is not None:
        allergens = union_tags(allergens, map_tags(allergen_tags, vocab.BARCODE_ALLERGEN_TAGS))
    df = stage(
        df,
        {
            "_told": F.col("_ingredients"), "_dietary": dietary, "_allergens": allergens,
            "_sweet": scan_sweeteners(F.col("_list")),
        },
    )
    known = (
        F.col("_told").isNotNull()
        | (F.size("_dietary") > 0)
        | (F.size("_allergens") > 0)
        | (F.size("_sweet") > 0)
    )
    facts = F.struct(
        F.col("_told").alias("ingredients_text"),
        F.col("_dietary").alias("dietary_labels"),
        F.col("_allergens").alias("allergens"),
        F.col("_sweet").alias("sweeteners"),
    )
    staged = ["_told", "_ingredients", "_list", "_labels", "_named", "_claims", "_allergy", "_dietary",
              "_allergens", "_sweet"]
    return df.withColumn(name, F.when(known, facts)).drop(*staged)


def map_tags(tags: Column, table: dict[str, str]) -> Column:
    """Leaves of structured tags ("en:milk" -> "milk") that the table knows, as our tags."""
    return F.array_compact(
        F.transform(
            F.coalesce(tags, empty_tags()), lambda t: lookup(table, F.substring_index(t, ":", -1))
        )
    )


def union_tags(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def tag_bits(tags: Column, table: dict[str, list[str]]) -> Column:
    """Tags as a bit mask: a set union becomes ``bit_or``, a fixed-width aggregate buffer."""
    mask = F.lit(0).cast("long")
    for bit, tag in enumerate(sorted(table)):
        mask = mask.bitwiseOR(
            F.when(F.array_contains(tags, tag), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        )
    return mask


def bits_to_tags(mask: Column, table: dict[str, list[str]]) -> Column:
    return tags_where(
        {
            tag: mask.bitwiseAND(F.lit(1 << bit).cast("long")) != 0
            for bit, tag in enumerate(sorted(table))
        }
    )
