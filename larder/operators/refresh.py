"""The listing view kept up to date: only variants that a change can reach are computed again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.metrics import listing_metrics
from larder.session import kept
from larder.sources.adapter import Catalog

# The view's eight relations and their keys.
RELATION_KEYS = {
    "variants": "variant_id", "prices": "variant_id", "nutrition": "variant_id", "facts": "variant_id",
    "listings": "listing_id", "products": "product_id", "brands": "brand_id", "sources": "source_id",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of rows that were inserted, updated or deleted between two states of a table."""
    columns = [c for c in new.columns if c != key]
    state = lambda df: df.groupBy(key).agg(
        F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in columns]).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    a, b = state(old).toDF(key, "h0", "n0"), state(new).toDF(key, "h1", "n1")
    both = a.join(b, key, "full_outer")
    return both.filter(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("n0").eqNullSafe(F.col("n1"))).select(key)


def touched_variants(view: DataFrame, cat, deltas: dict[str, DataFrame]) -> DataFrame:
    """Variants that a change of the given keys can reach, in the view as it was or in the tables as
    they are. Keys spread downwards: brands to products, products and sources to listings, listings
    to variants. A row that changed its parent is in its own table's delta."""
    def keys(name: str, *more: DataFrame) -> DataFrame | None:
        given = [deltas[name].select(RELATION_KEYS[name])] if name in deltas else []
        parts = given + list(more)
        return _union(parts).distinct() if parts else None

    def below(parent: DataFrame | None, key: str, table: DataFrame, child: str) -> list[DataFrame]:
        return [] if parent is None else [table.join(parent, key, "left_semi").select(child)]

    products = keys("products", *below(keys("brands"), "brand_id", cat.products, "product_id"))
    sources = keys("sources")
    listings = keys("listings", *below(products, "product_id", cat.listings, "listing_id"),
                    *below(sources, "source_id", cat.listings, "listing_id"))
    direct = [deltas[n].select("variant_id") for n, key in RELATION_KEYS.items() if key == "variant_id" and n in deltas]
    reached = direct + below(listings, "listing_id", cat.variants, "variant_id")
    for parent, key in ((listings, "listing_id"), (products, "product_id"), (sources, "source_id")):
        reached += below(parent, key, view, "variant_id")
    if not reached:
        return view.select("variant_id").limit(0)
    return _union(reached).distinct()


class _Touched(Catalog):
    """The catalog's variant tables cut down to some variants before anything is derived from them."""

    def __init__(self, cat, variants: DataFrame) -> None:
        self.cat, self.keys = cat, variants

    def __getattr__(self, name: str) -> DataFrame:
        rows = getattr(self.cat, name)
        return rows.join(self.keys, "variant_id", "left_semi") if "variant_id" in rows.columns else rows


def refresh(view: DataFrame, cat, deltas: dict[str, DataFrame]) -> DataFrame:
    """The listing view after a change: ``view`` was right before it, ``cat`` holds the tables after it,
    and ``deltas`` names, per changed relation, the keys of its inserted, updated and deleted rows."""
    touched = kept(touched_variants(view, cat, deltas), "touched")  # read beside every table of the view
    # stored, so that what its joins shuffled is gone before the whole view is
    fresh = kept(listing_metrics(_Touched(cat, touched)).select(*view.columns), "fresh")
    return view.join(touched, "variant_id", "left_anti").unionByName(fresh)
