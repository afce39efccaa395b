"""The catalog: nine relational tables as DataFrames, landed or derived from the driver tables."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import identity
from larder.functions.facets import add_facts
from larder.functions.market import currency_for_market
from larder.operators.quality import validate_nutrition
from larder.session import kept
from larder.sources import fixtures as fx


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Catalog:
    """The tables a query can ask for. Each is built on first use, so a query only plans what it
    reads."""

    sources: DataFrame
    brands: DataFrame
    products: DataFrame
    listings: DataFrame
    variants: DataFrame
    nutrition: DataFrame
    facts: DataFrame
    prices: DataFrame


@dataclass
class LandedCatalog(Catalog):
    """A catalog whose tables are already stored, one parquet folder each."""

    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        if name in Catalog.__annotations__:
            return self.spark.read.parquet(os.path.join(self.root, name))
        raise AttributeError(name)


def _keys():
    return [F.max("pk").alias("pk"), F.max("sk").alias("sk")]


class StarCatalog(Catalog):
    """The catalog derived from the star-schema tables by the expressions in ``fixtures``.

    Variant-level tables are all keyed by ``variant_id`` alone in their one aggregation, so every
    later join on it finds both sides partitioned the same way. The part and supplier keys, which
    it determines, ride along as aggregates.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def sources(self) -> DataFrame:
        """Stored once: from its files Spark knows the table's size, and decides by it how prices and offers meet it."""
        return kept(self.derived_sources, "sources")

    @property
    def derived_sources(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        supplier = self.table("supplier")
        joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        slug = identity.slugify(F.col("s_name"))
        return joined.select(
            F.col("s_suppkey").alias("source_id"),
            slug.alias("slug"),
            F.col("s_name").alias("name"),
            F.expr(fx.SOURCE_TYPE).alias("type"),
            F.expr(fx.MARKET).alias("market"),
            F.concat(F.lit("https://"), slug, F.lit(".example")).alias("base_url"),
            F.expr(fx.ENABLED).alias("enabled"),
        )

    @cached_property
    def brands(self) -> DataFrame:
        brand = self.table("part").select("p_brand").distinct()
        return brand.select(
            identity.slugify(identity.normalize_brand(F.col("p_brand"))).alias("brand_id"),
            F.col("p_brand").alias("name"),
        )

    @cached_property
    def products(self) -> DataFrame:
        brand, name = F.col("p_brand"), F.col("p_name")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            identity.slugify(identity.normalize_brand(brand)).alias("brand_id"),
            name.alias("name"),
            F.lower("p_type").alias("category"),
            identity.product_dedup_key(brand, name).alias("dedup_key"),
        )

    @cached_property
    def variant_keys(self) -> DataFrame:
        """One row per variant, with its part and supplier keys."""
        return self.keyed_lineitem().groupBy("variant_id").agg(*_keys())

    def keyed_lineitem(self, *columns: str) -> DataFrame:
        lines = self.table("lineitem")
        return lines.select(
            F.expr(fx.VARIANT_ID).alias("variant_id"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
            *columns,
        )

    @cached_property
    def listings(self) -> DataFrame:
        seen = F.min("l_shipdate").alias("first_seen_at"), F.max("l_shipdate").alias("last_seen_at")
        keyed = self.keyed_lineitem("l_shipdate").groupBy("variant_id").agg(*_keys(), *seen)
        return keyed.select(
            F.col("variant_id").alias("listing_id"),
            F.col("sk").alias("source_id"),
            F.col("pk").alias("product_id"),
            F.col("variant_id").alias("source_sku"),
            F.concat(F.lit("https://shop.example/p/"), "variant_id").alias("url"),
            F.expr(fx.TITLE).alias("title"),
            "first_seen_at",
            "last_seen_at",
        )

    @cached_property
    def variants(self) -> DataFrame:
        return self.variant_keys.select(
            "variant_id",
            F.col("variant_id").alias("listing_id"),
            F.lit("default").alias("source_variant_id"),
            F.expr(fx.FLAVOR).alias("flavor"),
            F.expr(fx.SIZE_G).alias("size_g"),
            F.lit(None).cast("string").alias("size_label"),
            F.expr(fx.UPC).alias("upc"),
            F.expr(fx.COMPARE_AT).alias("compare_at_price_cents"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        market = self.sources.select(F.col("source_id").alias("l_suppkey"), "market")
        return self.table("lineitem").join(market, "l_suppkey").select(
            F.expr(fx.VARIANT_ID).alias("variant_id"),
            F.expr(fx.PRICE_CENTS).alias("price_cents"),
            currency_for_market(F.col("market")).alias("currency"),
            (F.col("l_linestatus") == "O").alias("in_stock"),
            F.col("l_shipdate").alias("captured_at"),
            F.struct(*fx.TIE_COLUMNS).alias("seq"),
        )

    @cached_property
    def nutrition_candidates(self) -> DataFrame:
        """Unvalidated nutrition per variant, beside the container size that validation needs."""
        return self.variant_keys.filter(fx.HAS_NUTRITION).select(
            "variant_id",
            F.expr(fx.SIZE_G).alias("size_g"),
            *[F.expr(sql).alias(name) for name, sql in fx.NUTRITION.items()],
        )

    @cached_property
    def nutrition(self) -> DataFrame:
        checked = validate_nutrition(self.nutrition_candidates)
        return checked.filter("ok").select("variant_id", *fx.NUTRITION, "confidence")

    @cached_property
    def fact_inputs(self) -> DataFrame:
        return self.variant_keys.filter(fx.HAS_INGREDIENTS).select(
            "variant_id",
            F.expr(fx.INGREDIENTS).alias("ingredients"),
            F.expr(fx.LABEL_TEXT).alias("label_text"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        told = add_facts(self.fact_inputs, F.col("ingredients"), F.col("label_text"))
        return told.select("variant_id", "facts.*")
