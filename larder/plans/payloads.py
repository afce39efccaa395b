"""Payload queries: landed retailer JSON to items, and items to the common schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.metrics import genuine_markdown
from larder.functions.facets import classify_category
from larder.functions.text import stage
from larder.functions.units import cents_from_text, cents_from_number
from larder.functions.market import currency_for_market
from larder.sources import feeds, landed
from larder.sources import retailers as shops
from larder.sources.adapter import StarCatalog

CORE = [c for c in shops.SCHEMA if c not in ("nutrition", "facts", "source_id")]


def landed_families(cat: StarCatalog) -> dict[str, DataFrame]:
    return {
        "shopify": landed.feed_items(cat),
        "walmart": landed.affiliate_items(cat),
        "amazon": shops.join_details(landed.marketplace_items(cat), landed.marketplace_details(cat)),
        "kroger": landed.grocer_items(cat),
        "ebay": shops.join_item(landed.auction_items(cat), landed.auction_details(cat)),
        "jsonld": landed.product_pages(cat),
    }


def normalized(cat: StarCatalog, kind: str) -> DataFrame:
    return shops.normalizer(kind)(landed_families(cat)[kind])


def _core(kind: str):
    return lambda cat: normalized(cat, kind).select(*CORE)


def _facts(kind: str):
    return lambda cat: normalized(cat, kind).filter(F.col("facts").isNotNull()).select(
        "source_slug", "source_variant_id", F.col("facts.ingredients_text").alias("ingredients_text"),
        *[F.array_join(f"facts.{t}", ",").alias(t) for t in ("dietary_labels", "allergens", "sweeteners")],
    )


def _nutrition(kind: str):
    return lambda cat: normalized(cat, kind).filter(F.col("nutrition").isNotNull()).select(
        "source_slug", "source_variant_id", "nutrition.*"
    )


def pages_of(cat: StarCatalog, kind: str, path: str) -> DataFrame:
    return landed.result_pages(landed_families(cat)[kind] if kind != "amazon" else landed.marketplace_items(cat), "pk", path)


def _parsed(items: DataFrame, schema: str) -> DataFrame:
    return feeds.parse(items, schema)


def powder(cat: StarCatalog, items, schema: str, test, key: str) -> DataFrame:
    rows = _parsed(items(cat), schema).filter(test(F.col("item")))
    return rows.select("source_slug", "pk", F.col(f"item.{key}").cast("string").alias("item_key"))


# Source settings as they come with the source definitions: some bring word lists of their own.
CONFIG = (
    "CASE s_suppkey % 5 WHEN 0 THEN '{\"include_keywords\":[\"Supplement\",\"shaker\"]}' WHEN 1 THEN '{\"exclude_keywords\":[\"CASEIN\"],\"max_pages\":3}' "
    "WHEN 2 THEN '{\"include_keywords\":[\"whey\",\"vegan\"],\"exclude_keywords\":[]}' WHEN 3 THEN '{\"max_pages\":2}' END"
)


def powder_by_source(cat: StarCatalog) -> DataFrame:
    """Feed products kept by the lists of their own source."""
    configured = cat.table("supplier").select(F.col("s_suppkey").alias("source_id"), F.expr(CONFIG).alias("config"))
    rows = _parsed(landed.feed_items(cat), feeds.FEED_PRODUCT)
    kept = feeds.powder_by_source(rows, feeds.source_words(configured))
    return kept.select("source_slug", "pk", F.col("item.id").cast("string").alias("item_key"))


def affiliate_lookups(cat: StarCatalog) -> DataFrame:
    """Lookup responses in their three shapes: a list, a bare object, an empty list."""
    body = F.col("payload")
    shape = F.col("pk") % 3
    wrapped = (
        F.when(shape == 0, F.concat(F.lit('{"items":['), body, F.lit("]}")))
        .when(shape == 1, body)
        .otherwise(F.lit('{"items":[]}'))
    )
    return landed.affiliate_items(cat).select("source_id", "pk", "sk", wrapped.alias("payload"))


def walmart_lookup(cat: StarCatalog) -> DataFrame:
    """Search items whose price is replaced by the lookup's; items without a lookup vanish."""
    searched = feeds.parse(landed.affiliate_items(cat), feeds.AFFILIATE_ITEM)
    fresh = feeds.unwrap_lookup(affiliate_lookups(cat))
    fresh = fresh.withColumn("item", F.col("item").withField("salePrice", F.col("item.salePrice") - 1.0))
    return shops.join_lookup(searched, fresh).select(
        "source_slug", F.col("item.itemId").alias("item_id"),
        cents_from_number(F.col("item.salePrice")).alias("price_cents"),
    )


def feed_category(cat: StarCatalog) -> DataFrame:
    rows = _parsed(landed.feed_items(cat), feeds.FEED_PRODUCT)
    item = F.col("item")
    text = F.lower(F.concat_ws(" ", item["title"], item["product_type"], shops.feed_tags(item)))
    return rows.withColumn("t", text).select(
        "source_slug", item["id"].alias("id"), classify_category(F.col("t")).alias("category")
    )


def nutrition_fallback(cat: StarCatalog) -> DataFrame:
    """Feed nutrition where incomplete rows are filled from another table: here a
    product-level table keyed by handle."""
    rows, item = shops.stage_feed(landed.feed_items(cat))
    rows = rows.filter(item["handle"].isNotNull()).withColumn("source_sku", item["handle"])
    other = cat.variant_keys.select(
        F.concat(F.lit("item-"), F.col("pk").cast("string"), F.lit("-"), F.col("sk").cast("string")).alias("source_sku"),
        (F.lit(30) + F.col("pk") % 5).cast("double").alias("serving_size_g"),
        F.lit(None).cast("double").alias("servings_per_container"),
        F.when(F.col("pk") % 2 == 0, 21.0).alias("protein_g"),
        F.lit(2.0).alias("fat_g"), F.lit(3.0).alias("carb_g"), F.lit(1.0).alias("sugar_g"),
        F.lit(None).cast("double").alias("calories_kcal"),
    )
    out = shops.nutrition_feed(rows, other)
    return out.filter(F.col("method").isNotNull()).select(
        "source_sku", *[F.col(f"p_{f}").alias(f) for f in shops.nut.FIELDS], F.col("method").alias("extraction_method")
    )


def marketplace_staged(cat: StarCatalog) -> DataFrame:
    return shops.stage_marketplace(landed_families(cat)["amazon"])


def sources(cat: StarCatalog) -> DataFrame:
    return feeds.scan_sources(cat.sources)


def requested_slugs(cat: StarCatalog) -> DataFrame:
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return cat.table("customer").select(F.concat(F.lit("supplier-"), key).alias("slug"))


def sitemaps(cat: StarCatalog) -> DataFrame:
    """Sitemap documents of 50 URLs each, built from the page table."""
    pages = cat.table("pages").select("page_id", "url", F.floor(F.col("page_id") / 50).alias("site"))
    listed = pages.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    locs = F.transform("u", lambda r: F.concat(F.lit("<url>\n<LOC> "), r["url"], F.lit(" </LOC></url>")))
    return listed.select("site", F.concat(F.lit("<urlset>"), F.array_join(locs, ""), F.lit("</urlset>")).alias("xml"))


def url_sets(cat: StarCatalog, cap: int | None) -> DataFrame:
    pages = cat.table("pages").select(F.floor(F.col("page_id") / 50).alias("site"), "page_id", "url")
    explicit = pages.filter(F.contains("url", F.lit("ref="))).select("site", F.col("page_id").cast("int").alias("pos"), "url")
    found = feeds.page_url_set(explicit, feeds.sitemap_urls(sitemaps(cat)), "site", cap)
    return found.select("site", "url", F.col("place.part").alias("part"), F.col("place.pos").alias("pos"))


def changed(cat: StarCatalog) -> DataFrame:
    docs = cat.table("documents").select("doc_id", "text", "lang")
    old = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    seen = docs.select("doc_id", F.sha2(old.cast("binary"), 256).alias("content_hash"))
    return feeds.changed_content(docs, seen, "doc_id", "text").select("doc_id", "content_hash")


_scan_key = lambda df, key: df.select("source_slug", "query", "page", F.col(f"item.{key}").cast("string").alias("item_key"))

QUERIES = {
    "scan_sources": lambda cat: sources(cat).select("slug", "name", "type", "base_url", "market", "enabled"),
    "enabled_sources": lambda cat: feeds.enabled_sources(sources(cat)).select("slug", "type", "base_url", "market"),
    "sources_by_slug": lambda cat: feeds.sources_by_slug(sources(cat), requested_slugs(cat)).select("slug", "type", "market"),
    "currency_for_market": lambda cat: cat.sources.select("slug", "market", currency_for_market(F.col("market")).alias("currency")),
    "scan_shopify_feed": lambda cat: feeds.scan_feed(pages_of(cat, "shopify", "products")).select(
        "source_slug", "query", "page", "pos", F.col("item.id").alias("id"), F.col("item.handle").alias("handle")),
    "scan_walmart_search": lambda cat: _scan_key(feeds.scan_affiliate(pages_of(cat, "walmart", "items")), "itemId"),
    "scan_amazon_search": lambda cat: _scan_key(feeds.scan_marketplace(pages_of(cat, "amazon", "data.products")), "asin"),
    "scan_kroger_products": lambda cat: _scan_key(feeds.scan_grocer(pages_of(cat, "kroger", "data")), "productId"),
    "scan_ebay_summaries": lambda cat: _scan_key(feeds.scan_auction(pages_of(cat, "ebay", "itemSummaries")), "itemId"),
    "first_seen_dedupe": lambda cat: feeds.first_seen(
        feeds.scan_feed(pages_of(cat, "shopify", "products")), F.col("item.id"), ["source_id"]
    ).select("source_slug", "query", "page", "pos", F.col("item.id").alias("id")),
    "unwrap_walmart_lookup": lambda cat: feeds.unwrap_lookup(affiliate_lookups(cat)).select(
        F.col("item.itemId").alias("item_id"), F.col("item.name").alias("name")),
    "scan_off_products": lambda cat: feeds.scan_barcodes(landed.barcode_lookups(cat)).select(
        "upc", F.col("product.serving_size").alias("serving_size"),
        F.array_join("product.labels_tags", ",").alias("labels"),
        F.col("product.product_quantity").try_cast("double").alias("product_quantity")),
    "to_float": lambda cat: _parsed(landed.auction_items(cat), feeds.AUCTION_SUMMARY).select(
        "pk", "sk", F.col("item.seller.feedbackPercentage").try_cast("double").alias("feedback")),
    "sitemap_urls": lambda cat: feeds.sitemap_urls(sitemaps(cat), pattern="page=[0-9]+").select("site", "pos", "url"),
    "page_url_set": lambda cat: url_sets(cat, None),
    "url_concat_dedupe": lambda cat: url_sets(cat, None),
    "changed_content": changed,
    "powder_filter_shopify": lambda cat: powder(cat, landed.feed_items, feeds.FEED_PRODUCT, feeds.powder_feed, "id"),
    "powder_filter_by_source": powder_by_source,
    "powder_filter_walmart": lambda cat: powder(cat, landed.affiliate_items, feeds.AFFILIATE_ITEM, feeds.powder_affiliate, "itemId"),
    "powder_filter_amazon": lambda cat: powder(cat, landed.marketplace_items, feeds.MARKETPLACE_ITEM, feeds.powder_marketplace, "asin"),
    "powder_filter_kroger": lambda cat: powder(cat, landed.grocer_items, feeds.GROCER_ITEM, feeds.powder_grocer, "productId"),
    "powder_filter_ebay": lambda cat: powder(cat, landed.auction_items, feeds.AUCTION_SUMMARY, feeds.powder_auction, "itemId"),
    "currency_guard": lambda cat: shops.currency_guard(
        _parsed(landed.auction_items(cat), feeds.AUCTION_SUMMARY), F.col("item.price.currency")
    ).select("pk", "sk", "market", F.col("item.price.currency").alias("currency")),
    "priced_only": lambda cat: shops.priced_only(
        _parsed(landed.marketplace_items(cat), feeds.MARKETPLACE_ITEM).withColumn(
            "price_cents", cents_from_text(F.col("item.product_price")))
    ).select("pk", "sk", "price_cents"),
    "markdown_amazon": lambda cat: _parsed(landed.marketplace_items(cat), feeds.MARKETPLACE_ITEM).select(
        "pk", "sk", genuine_markdown(cents_from_text(F.col("item.product_original_price")),
                                     cents_from_text(F.col("item.product_price"))).alias("compare_at_price_cents")),
    "join_walmart_lookup": walmart_lookup,
    "join_amazon_details": lambda cat: landed_families(cat)["amazon"].select(
        "source_slug", "pk", F.col("d").isNotNull().alias("has_details"), F.col("d.product_title").alias("detail_title")),
    "join_ebay_item": lambda cat: landed_families(cat)["ebay"].select("source_slug", "pk", "item_id", "upc"),
    "ebay_gtin": lambda cat: landed.auction_details(cat).select(
        "item_id", shops.auction_gtin(F.from_json("payload", feeds.AUCTION_ITEM)).alias("upc")),
    "amazon_brand": lambda cat: marketplace_staged(cat).select("source_slug", "pk", "brand_name"),
    "amazon_upc": lambda cat: marketplace_staged(cat).select("source_slug", "pk", shops.marketplace_upc(F.col("d")).alias("upc")),
    "category_shopify": feed_category,
    "nutrition_shopify": nutrition_fallback,
    "normalize_shopify": _core("shopify"),
    "normalize_walmart": _core("walmart"),
    "normalize_amazon": _core("amazon"),
    "normalize_kroger": _core("kroger"),
    "normalize_ebay": _core("ebay"),
    "normalize_jsonld": _core("jsonld"),
    "facts_shopify": _facts("shopify"),
    "facts_walmart": _facts("walmart"),
    "amazon_facts": _facts("amazon"),
    "facts_kroger": _facts("kroger"),
    "fill_servings": _nutrition("shopify"),
    "amazon_nutrition": _nutrition("amazon"),
    "nutrition_jsonld": _nutrition("jsonld"),
    "jsonld_products": lambda cat: shops.jsonld_products(landed.product_pages(cat)).select(
        "source_slug", "pk", "pos", F.try_variant_get("node", "$.name", "string").alias("name")),
    "jsonld_pick": lambda cat: landed.product_pages(cat).withColumn(
        "node", shops.pick_node(shops.product_nodes(F.col("html")))
    ).select("source_slug", "pk", F.try_variant_get("node", "$.name", "string").alias("name")),
    "jsonld_offer": lambda cat: stage(
        landed.product_pages(cat), {"offer": shops.pick_offer(shops.pick_node(shops.product_nodes(F.col("html"))))}
    ).select("source_slug", "pk", cents_from_text(shops.offer_price(F.col("offer"))).alias("price_cents"),
             F.try_variant_get("offer", "$.priceCurrency", "string").alias("currency")),
    "jsonld_brand": lambda cat: stage(
        landed.product_pages(cat), {"node": shops.pick_node(shops.product_nodes(F.col("html")))}
    ).select("source_slug", "pk", shops.node_brand(F.col("node")).alias("brand")),
    "union_normalized": lambda cat: shops.union_normalized(landed_families(cat)).groupBy("source_slug", "currency").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("price_cents").alias("cents"),
        F.count("upc").alias("coded"), F.count("facts").alias("with_facts"),
        F.count("nutrition").alias("with_nutrition")),
}
