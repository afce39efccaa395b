"""Catalog queries: reading, metrics, filters, joins, grouping, ranking and product pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import detail, enrich, filters, grouping, metrics, ranking, refresh, resolve, search, stats
from larder.operators.filters import FilterSpec
from larder.operators.metrics import METRICS
from larder.operators.quality import route_validated, validate_nutrition
from larder.session import kept
from larder.sources import feeds, landed
from larder.sources.adapter import Catalog, StarCatalog

Query = Callable[[StarCatalog], DataFrame]
TAGS = ("dietary_labels", "allergens", "sweeteners")


def flat(df: DataFrame) -> DataFrame:
    """Tag lists as comma-joined text, so that results compare by value anywhere."""
    return df.withColumns({c: F.array_join(c, ",") for c in TAGS if c in df.columns})


def view(cat: StarCatalog) -> DataFrame:
    return metrics.listing_metrics(cat)


def metric_inputs(cat: StarCatalog) -> DataFrame:
    priced = metrics.join_latest_price(cat.variants, cat.prices)
    return metrics.join_optional_nutrition(priced, cat.nutrition)


def _metric(column: str) -> Query:
    return lambda cat: metric_inputs(cat).select("variant_id", metrics.metric_columns()[column].alias(column))


def _filtered(condition, *columns: str) -> Query:
    return lambda cat: flat(view(cat).filter(condition()).select("variant_id", *columns))


def offers_for(cat: StarCatalog, spec: FilterSpec) -> DataFrame:
    return filters.compose_filters(view(cat), spec)


PAGE_COLUMNS = ["product_id", "variant_id", "brand_name", "product_name", "price_cents",
                "retailer_count", "offer_count"]


def shown(spec: FilterSpec) -> list[str]:
    return [*PAGE_COLUMNS, *({spec.metric_def.column} - set(PAGE_COLUMNS))]


def grid_page(cat: StarCatalog, spec: FilterSpec, page: int = 1) -> DataFrame:
    """Ranked on keys; names are fetched for the page's rows only."""
    keys = ranking.page_listings(grouping.grid_keys(cat, spec), spec, page)
    return grouping.with_names(keys, cat).select(*shown(spec))


def grid_page_rows(cat: StarCatalog, spec: FilterSpec, page: int = 1) -> DataFrame:
    """The page with every column of the view."""
    keys = ranking.page_listings(grouping.grid_keys(cat, spec), spec, page)
    return grouping.fetch_offers(cat, keys.select("variant_id", "retailer_count", "offer_count"))


def ranked_grid(cat: StarCatalog, spec: FilterSpec) -> DataFrame:
    return ranking.global_rank(grouping.grid_keys(cat, spec), ranking.rank_order(spec))


def full_ranking(cat: StarCatalog, spec: FilterSpec) -> DataFrame:
    """Every product of the grid with its rank; names are joined to the ranked keys."""
    return grouping.with_names(ranked_grid(cat, spec), cat).select(*shown(spec), "rank")


def last_page(cat: StarCatalog, spec: FilterSpec) -> DataFrame:
    """The deepest page, cut out of the ranked keys by rank instead of by a huge offset."""
    ranked = ranked_grid(cat, spec)
    number = ranking.page_number(F.col("rank"))
    last = ranked.agg(F.max(number).alias("last"))
    page = ranked.join(F.broadcast(last), number == F.col("last"))
    return grouping.with_names(page, cat).select(
        *PAGE_COLUMNS, "rank", ranking.page_row_number(F.col("rank")).alias("row"),
    )


def page_table(cat: StarCatalog) -> DataFrame:
    """Every page of the default grid with the positions it shows."""
    total = grouping.product_total(grouping.offer_keys(cat, FilterSpec()))
    pages = total.withColumn(
        "page",
        F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("total") / ranking.PAGE_SIZE)))),
    )
    return pages.select("page", "total", *[c.alias(n) for n, c in ranking.page_bounds(F.col("total"), F.col("page")).items()])


def history(cat: StarCatalog) -> DataFrame:
    return detail.product_history(cat.prices, cat.variants, cat.listings)


def validated(cat: StarCatalog) -> DataFrame:
    return validate_nutrition(cat.nutrition_candidates)


def run_stats(cat: StarCatalog) -> DataFrame:
    owner = F.split_part("variant_id", F.lit("-"), F.lit(2)).cast("long").alias("source_id")
    accepted, issues = route_validated(validated(cat))
    return stats.run_stats(
        {
            "sources": feeds.enabled_sources(feeds.scan_sources(cat.sources)).select("source_id"),
            "products": cat.listings.select("source_id"),
            "variants": cat.variant_keys.select(F.col("sk").alias("source_id")),
            "prices": cat.table("lineitem").select(F.col("l_suppkey").alias("source_id")),
            "nutrition_ok": accepted.select(owner),
            "issues": issues.select(owner),
        }
    )


def enrichment(cat: StarCatalog):
    missing = enrich.variants_missing(cat.variants, cat.nutrition)
    return missing, feeds.scan_barcodes(landed.barcode_lookups(cat))


def enrich_stats(cat: StarCatalog) -> DataFrame:
    missing, barcodes = enrichment(cat)
    accepted, issues = enrich.enrich_nutrition(missing, barcodes)
    facts = enrich.enrich_facts(enrich.variants_missing(cat.variants, cat.facts), barcodes)
    return enrich.enrich_stats(missing, accepted, issues, facts)


PK = "CAST(split_part(variant_id, '-', 1) AS BIGINT)"
TODAY = "1998-06-01"


class Yesterday(Catalog):
    """The catalog before rows were inserted, updated and deleted in each of the view's relations."""

    def __init__(self, cat: StarCatalog) -> None:
        self.spark, self.cat = cat.spark, cat
        gone = cat.variants.filter(f"{PK} % 41 = 0").select("variant_id")  # variants that lose their twin
        self.variants = cat.variants.filter(f"{PK} % 17 <> 0").withColumn(
            "flavor", F.expr(f"CASE WHEN {PK} % 13 = 0 THEN 'Plain' ELSE flavor END")).unionByName(
            cat.variants.join(gone, "variant_id", "left_semi").withColumn("variant_id", F.concat("variant_id", F.lit("-old"))))
        seen = cat.prices.filter(F.col("captured_at") < F.lit(TODAY).cast("timestamp_ntz"))
        self.prices = seen.unionByName(seen.join(gone, "variant_id", "left_semi").withColumn("variant_id", F.concat("variant_id", F.lit("-old"))))
        more = cat.nutrition.filter(f"{PK} % 9 = 1").withColumn(
            "variant_id", F.expr(f"concat({PK} - 1, '-', split_part(variant_id, '-', 2))"))
        self.nutrition = cat.nutrition.filter(f"{PK} % 23 <> 0").withColumn(
            "protein_g", F.expr(f"protein_g + CASE WHEN {PK} % 19 = 0 THEN 1.0D ELSE 0.0D END")).unionByName(
            more.join(cat.nutrition, "variant_id", "left_anti"))
        self.facts = cat.facts.filter(f"{PK} % 11 <> 0")
        self.listings = cat.listings.withColumns({
            "url": F.concat("url", F.when(F.col("product_id") % 31 == 0, "?old").otherwise("")),
            "product_id": F.when(F.col("product_id") % 37 == 1, F.col("product_id") - 1).otherwise(F.col("product_id"))})
        self.products = cat.products.withColumn("name", F.concat(F.when(F.col("product_id") % 29 == 0, "old ").otherwise(""), F.col("name")))
        self.brands = cat.brands.withColumn("name", F.when(F.col("name") == "Brand#7", "Seven").otherwise(F.col("name")))
        self.sources = cat.sources.withColumn("market", F.when(F.col("source_id") % 10 == 3, "IN").otherwise(F.col("market")))

    def deltas(self) -> dict[str, DataFrame]:
        """The keys of everything that changed since."""
        cat = self.cat
        gone = self.variants.filter(F.col("variant_id").endswith("-old"))
        return {
            "variants": cat.variants.filter(f"{PK} % 17 = 0 OR {PK} % 13 = 0").select("variant_id").union(gone.select("variant_id")),
            "prices": cat.prices.filter(F.col("captured_at") >= F.lit(TODAY).cast("timestamp_ntz")).select("variant_id").union(gone.select("variant_id")),
            "nutrition": cat.nutrition.filter(f"{PK} % 23 = 0 OR {PK} % 19 = 0").select("variant_id").union(
                self.nutrition.filter(f"{PK} % 9 = 0").select("variant_id")),
            "facts": cat.facts.filter(f"{PK} % 11 = 0").select("variant_id"),
            "listings": cat.listings.filter("product_id % 31 = 0 OR product_id % 37 = 1").select("listing_id"),
            "products": cat.products.filter("product_id % 29 = 0").select("product_id"),
            "brands": cat.brands.filter("name = 'Brand#7'").select("brand_id"),
            "sources": cat.sources.filter("source_id % 10 = 3").select("source_id"),
        }


def refreshed_view(cat: StarCatalog) -> DataFrame:
    """Yesterday's view brought up to date from what changed."""
    before = Yesterday(cat)
    return refresh.refresh(kept(view(before), "view"), cat, before.deltas())


def searched(cat: StarCatalog) -> DataFrame:
    return search.search(cat.products, cat.brands, search.postings(cat.products, cat.brands), "RING")


def search_pruning(cat: StarCatalog) -> DataFrame:
    """How many products the trigrams leave for the exact check, of how many."""
    few = search.candidates(search.postings(cat.products, cat.brands), "RING").agg(F.count(F.lit(1)).alias("candidates"))
    return few.crossJoin(cat.products.agg(F.count(F.lit(1)).alias("products")))  # one row each


FULL = FilterSpec(
    market="US", q="ring", brands=("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"),
    in_stock_only=True, max_price_cents=8000, allergen_free=("soy",), no_artificial=True,
)
RETAILERS = ("supplier-000000001", "supplier-000000002", "supplier-000000007")

QUERIES: dict[str, Query] = {
    "listing_metrics": lambda cat: flat(view(cat)),
    "listing_metrics_refresh": lambda cat: flat(refreshed_view(cat)),
    "search_trigrams": searched,
    "search_trigram_candidates": search_pruning,
    "read_catalog_table": lambda cat: cat.products.filter(F.col("name").contains("ring"))
    .select("brand_id", "category").distinct().orderBy("brand_id", "category"),
    **{
        f"metric_{key}": _metric(column)
        for key, column in {
            "total_protein": "total_protein_g", "protein_per_dollar": "protein_per_dollar",
            "cost_per_30g": "cost_per_30g_protein", "protein_pct_weight": "protein_pct_weight",
            "fat_per_protein": "fat_per_protein", "calories_per_protein": "calories_per_protein",
            "price_per_serving": "price_per_serving",
        }.items()
    },
    "metric_protein_per_cal": lambda cat: cat.nutrition.select(
        "variant_id",
        metrics.protein_per_calorie(F.col("protein_g"), F.col("calories_kcal")).alias("protein_per_cal"),
    ),
    "sale_percent": lambda cat: metrics.join_latest_price(cat.variants, cat.prices).select(
        "variant_id", "price_cents", "compare_at_price_cents",
        metrics.sale_percent(F.col("price_cents"), F.col("compare_at_price_cents")).alias("sale_percent"),
    ),
    "genuine_markdown": lambda cat: metrics.join_latest_price(cat.variants, cat.prices).select(
        "variant_id",
        metrics.genuine_markdown(F.col("compare_at_price_cents"), F.col("price_cents")).alias("markdown_from_cents"),
    ),
    "coalesce_defaults": lambda cat: flat(
        metrics.coalesce_defaults(
            metrics.join_optional_facts(
                metrics.join_optional_nutrition(cat.variants.select("variant_id"), cat.nutrition), cat.facts
            )
        ).select("variant_id", "confidence", *TAGS)
    ),
    "column_pruned_history": lambda cat: cat.prices.select("price_cents", "captured_at"),
    "filter_market": _filtered(lambda: filters.market_is("US"), "market"),
    "filter_market_uk": _filtered(lambda: filters.market_is("UK"), "market"),
    "filter_market_in": _filtered(lambda: filters.market_is("IN"), "market"),
    "filter_in_stock": _filtered(filters.in_stock, "in_stock"),
    "filter_brands": _filtered(lambda: filters.brand_in(("Brand#2", "Brand#17")), "brand_name"),
    "filter_sources": _filtered(lambda: filters.source_in(RETAILERS), "source_slug"),
    "filter_max_price": _filtered(lambda: filters.priced_at_most(filters.max_price_cents(50.00)), "price_cents"),
    "search_text": _filtered(lambda: filters.text_matches("RING"), "product_name", "brand_name"),
    "filter_metric_known": _filtered(lambda: filters.metric_known(METRICS["proteinPerDollar"]), "protein_per_dollar"),
    "filter_has_every": _filtered(lambda: filters.has_every("dietary_labels", ("vegan", "keto")), "dietary_labels"),
    "filter_allergen_free": _filtered(lambda: filters.has_none("allergens", ("soy",)), "allergens"),
    "filter_no_artificial": _filtered(lambda: filters.has_none("sweeteners", ("sucralose", "aspartame", "acesulfame_k", "saccharin")), "sweeteners"),
    "compose_filters": lambda cat: offers_for(cat, FULL).select(
        "variant_id", "product_id", "brand_name", "product_name", "price_cents", "protein_per_dollar"
    ),
    "join_catalog_dims": metrics.join_catalog_dims,
    "join_latest_price": lambda cat: metrics.join_latest_price(cat.variants, cat.prices).select(
        "variant_id", "flavor", "size_g", "price_cents", "currency", "in_stock", "captured_at"
    ),
    "join_optional_nutrition": lambda cat: metrics.join_optional_nutrition(
        cat.variants.select("variant_id"), cat.nutrition
    ),
    "join_optional_facts": lambda cat: flat(
        metrics.join_optional_facts(cat.variants.select("variant_id"), cat.facts)
    ),
    "upc_to_product": lambda cat: resolve.upc_to_product(cat.variants, cat.listings),
    "variants_missing_nutrition": lambda cat: enrich.variants_missing(cat.variants, cat.nutrition),
    "variants_missing_facts": lambda cat: enrich.variants_missing(cat.variants, cat.facts).drop("size_g"),
    "enrichment_batch": lambda cat: enrich.next_batch(enrich.variants_missing(cat.variants, cat.nutrition)),
    "history_for_variants": lambda cat: detail.history_for_variants(
        cat.prices, cat.variants.filter(F.col("flavor") == "Vanilla")
    ).select("variant_id", "price_cents", "captured_at"),
    "latest_price": lambda cat: metrics.latest_price(cat.prices),
    "best_offer_per_product": lambda cat: grouping.with_names(grouping.grid_keys(cat, FilterSpec()), cat).select(
        *PAGE_COLUMNS, "protein_per_dollar"
    ),
    "grouped_listings": lambda cat: flat(grouping.grouped_listings(cat, FULL)),
    "retailer_count": lambda cat: grouping.product_counts(
        grouping.offer_keys(cat, FilterSpec())).select("product_id", "retailer_count"),
    "offer_count": lambda cat: grouping.product_counts(
        grouping.offer_keys(cat, FilterSpec())).select("product_id", "offer_count"),
    "product_total": lambda cat: grouping.product_total(grouping.offer_keys(cat, FilterSpec())),
    "facet_brands": lambda cat: detail.facet_values(view(cat), "brand_name"),
    "facet_sources": lambda cat: detail.facet_values(view(cat), "source_slug"),
    "facet_counts": lambda cat: detail.facet_counts(view(cat), "dietary_labels"),
    "product_facet_union": lambda cat: flat(detail.product_facet_union(view(cat))),
    "first_ingredients_text": lambda cat: detail.first_ingredients_text(view(cat)),
    "price_range": lambda cat: detail.price_range(history(cat)),
    "run_stats": run_stats,
    "enrich_stats": enrich_stats,
    "rank_offers": lambda cat: ranked_grid(cat, FilterSpec()).select("product_id", "variant_id", "rank"),
    "page_row_number": lambda cat: ranked_grid(cat, FilterSpec()).select(
        "product_id", ranking.page_number(F.col("rank")).alias("page"),
        ranking.page_row_number(F.col("rank")).alias("row"),
    ),
    "series_position": lambda cat: detail.series_points(history(cat)).select(
        "product_id", "variant_id", "captured_at", "price_cents", "pos", "x"
    ),
    "series_minmax_scale": lambda cat: detail.series_points(history(cat)).select(
        "product_id", "variant_id", "captured_at", "price_cents", "y"
    ),
    **{
        f"rank_by_metric_{m.column}_{order}": (
            lambda cat, key=key, order=order: full_ranking(cat, FilterSpec(metric=key, order=order))
        )
        for key, m in METRICS.items()
        for order in ("best", "worst")
    },
    "top_listings": lambda cat: ranking.top_listings(offers_for(cat, FilterSpec()), FilterSpec(), take=200).select(
        "variant_id", "product_id", "price_cents", "protein_per_dollar"
    ),
    "page_listings": lambda cat: grid_page(cat, FilterSpec(market="UK"), 1),
    "page_listings_rows": lambda cat: flat(grid_page_rows(cat, FULL, 1)),
    "page_listings_2": lambda cat: grid_page(cat, FilterSpec(market="UK"), 2),
    "page_listings_last": lambda cat: last_page(cat, FilterSpec(market="UK")),
    "page_bounds": page_table,
    "product_detail_rows": lambda cat: detail.product_detail_rows(  # only what the page shows is stored and ranked
        view(cat).select("product_id", "variant_id", "market", "protein_per_dollar")),
    "price_history": lambda cat: detail.price_history(history(cat)).select(
        "product_id", "variant_id", "captured_at", "price_cents", "pos"
    ),
}
