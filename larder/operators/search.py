"""Substring search over product and brand names by a table of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - GRAM + 1)
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))))


def postings(products: DataFrame, brands: DataFrame) -> DataFrame:
    """(gram, product_id) over the product's own and its brand's name.

    A brand's grams are made once and joined to its products, so the table's cost follows names,
    not offers. A match must lie in one name, but only one row stands for a gram of both: such a
    candidate too many is sorted out by the exact check.
    """
    own = products.select("product_id", F.explode(grams(F.col("name"))).alias("gram"))
    branded = brands.select("brand_id", F.explode(grams(F.col("name"))).alias("gram"))
    return own.union(products.select("product_id", "brand_id").join(branded, "brand_id").select("product_id", "gram")).distinct()


def candidates(table: DataFrame, q: str) -> DataFrame | None:
    """Products that have every trigram of ``q``; None for a text too short to have one."""
    low = q.lower()
    wanted = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    hits = table.filter(F.col("gram").isin(wanted))
    return hits.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("product_id")


def search(products: DataFrame, brands: DataFrame, table: DataFrame, q: str) -> DataFrame:
    """Products whose own or brand name holds ``q``, letter case aside: candidates, then the exact check."""
    few = candidates(table, q)
    rows = products if few is None else products.join(few, "product_id", "left_semi")
    named = rows.join(brands.select("brand_id", F.col("name").alias("brand_name")), "brand_id")
    needle = F.lower(F.lit(q))
    return named.filter(F.contains(F.lower("name"), needle) | F.contains(F.lower("brand_name"), needle)).select(
        "product_id", F.col("name").alias("product_name"), "brand_name")
