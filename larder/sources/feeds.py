"""Readers of landed payloads: page bodies to one row per item, first arrival wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.text import contains_any, first_match, stage
from larder.functions.units import is_multipack

FEED_PRODUCT = (
    "struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,tags:string,"
    "body_html:string,options:array<struct<name:string,position:int>>,"
    "variants:array<struct<id:bigint,title:string,option1:string,option2:string,option3:string,price:string,"
    "compare_at_price:string,available:boolean,grams:int,sku:string>>>"
)
AFFILIATE_ITEM = (
    "struct<itemId:bigint,name:string,brandName:string,salePrice:double,msrp:double,upc:string,"
    "categoryPath:string,availableOnline:boolean,stock:string,productTrackingUrl:string,"
    "shortDescription:string,longDescription:string>"
)
MARKETPLACE_ITEM = (
    "struct<asin:string,product_title:string,product_price:string,product_original_price:string,"
    "product_url:string>"
)
MARKETPLACE_DETAIL = (
    "struct<product_title:string,product_price:string,product_original_price:string,"
    "product_url:string,product_byline:string,product_availability:string,"
    "product_description:string,about_product:array<string>,"
    "product_information:map<string,string>,product_details:map<string,string>>"
)
GROCER_ITEM = (
    "struct<productId:string,brand:string,description:string,categories:array<string>,"
    "items:array<struct<itemId:string,size:string,inventory:struct<stockLevel:string>,"
    "price:struct<regular:double,promo:double>>>,"
    "allergens:array<struct<name:string,levelOfContainmentName:string>>,"
    "manufacturerDeclarations:array<string>,nonGmoClaimName:string,organicClaimName:string>"
)
AUCTION_SUMMARY = (
    "struct<itemId:string,title:string,brand:string,price:struct<value:string,currency:string>,"
    "marketingPrice:struct<originalPrice:struct<value:string,currency:string>>,"
    "itemWebUrl:string,seller:struct<feedbackPercentage:string>>"
)
AUCTION_ITEM = "struct<gtin:string,localizedAspects:array<struct<name:string,value:string>>>"
BARCODE_PRODUCT = (
    "struct<serving_quantity:string,serving_size:string,product_quantity:string,"
    "ingredients_text:string,ingredients_text_en:string,allergens_tags:array<string>,"
    "labels_tags:array<string>,nutriments:map<string,string>>"
)


def parse(df: DataFrame, schema: str, name: str = "item", payload: str = "payload") -> DataFrame:
    return stage(df, {name: F.from_json(payload, schema)})


def _items(pages: DataFrame, path: str, schema: str) -> DataFrame:
    """Items of each page with their place in it. A missing list counts as empty."""
    wrapped = f"array<{schema}>"
    for step in reversed(path.split(".")):
        wrapped = f"struct<{step}:{wrapped}>"
    body = F.from_json("payload", wrapped)
    for step in path.split("."):
        body = body[step]
    kept = [c for c in pages.columns if c != "payload"]
    return pages.select(*kept, F.posexplode(body).alias("pos", "item"))


def first_seen(items: DataFrame, key: Column, scope: list[str]) -> DataFrame:
    """Keep the first arrival per id: by query, then page, then place on the page.

    ``row_number() = 1`` is cut down on the map side before the shuffle, so an id that is repeated
    on very many pages costs one row per task.
    """
    arrival = Window.partitionBy(*scope, "_id").orderBy("query", "page", "pos")
    numbered = items.withColumn("_id", key).withColumn("_n", F.row_number().over(arrival))
    return numbered.filter("_n = 1").drop("_n", "_id")


def scan_feed(pages: DataFrame) -> DataFrame:
    """All products of the landed feed pages, duplicates included."""
    return _items(pages, "products", FEED_PRODUCT)


def scan_affiliate(pages: DataFrame) -> DataFrame:
    items = _items(pages, "items", AFFILIATE_ITEM).filter(powder_affiliate(F.col("item")))
    return first_seen(items, F.col("item.itemId").cast("string"), ["source_id"])


def scan_marketplace(pages: DataFrame) -> DataFrame:
    items = _items(pages, "data.products", MARKETPLACE_ITEM)
    kept = items.filter((F.col("item.asin") != "") & powder_marketplace(F.col("item")))
    return first_seen(kept, F.col("item.asin"), ["source_id"])


def scan_grocer(pages: DataFrame) -> DataFrame:
    items = _items(pages, "data", GROCER_ITEM)
    kept = items.filter((F.col("item.productId") != "") & powder_grocer(F.col("item")))
    return first_seen(kept, F.col("item.productId"), ["source_id"])


def scan_auction(pages: DataFrame) -> DataFrame:
    items = _items(pages, "itemSummaries", AUCTION_SUMMARY)
    kept = items.filter((F.col("item.itemId") != "") & powder_auction(F.col("item")))
    return first_seen(kept, F.col("item.itemId"), ["source_id"])


def scan_barcodes(lookups: DataFrame) -> DataFrame:
    """Products of successful barcode lookups."""
    body = F.from_json("payload", f"struct<status:int,product:{BARCODE_PRODUCT}>")
    parsed = stage(lookups, {"_b": body}).filter(F.col("_b.status") == 1)
    return parsed.select("upc", F.col("_b.product").alias("product"))


def unwrap_lookup(df: DataFrame) -> DataFrame:
    """The item of a lookup response: first of ``items`` when that is a list, else the object
    itself when it has an id; rows with neither are dropped."""
    single = F.from_json("payload", AFFILIATE_ITEM)
    listed = F.from_json("payload", f"struct<items:array<{AFFILIATE_ITEM}>>")["items"]
    is_list = F.coalesce(
        F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.items", "variant")).startswith("ARRAY"),
        F.lit(False),
    )
    item = F.when(is_list, F.try_element_at(listed, F.lit(1))).when(
        single["itemId"].isNotNull(), single
    )
    return stage(df, {"item": item}).filter(F.col("item").isNotNull())


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def _is_powder(name: Column, text: Column, excluded: list[str]) -> Column:
    return (
        ~is_multipack(name)
        & F.contains(text, F.lit(vocab.POWDER_WORD))
        & ~contains_any(text, excluded)
    )


def powder_feed(item: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Title and type only; tags are noisy. A source may bring its own word lists."""
    text = F.lower(_text(item["title"], item["product_type"]))
    return contains_any(text, include or [vocab.POWDER_WORD]) & ~contains_any(
        text, exclude or vocab.FEED_EXCLUDE
    )


SOURCE_CONFIG = "struct<include_keywords:array<string>,exclude_keywords:array<string>>"


def source_words(sources: DataFrame) -> DataFrame:
    """(source_id, include, exclude) from the sources' ``config`` JSON, in lower case; the default
    lists where a source brings none. An empty list is a list: it includes or excludes nothing."""
    config = F.from_json("config", SOURCE_CONFIG)
    def words(own: Column, default: list[str]) -> Column:
        return F.coalesce(F.transform(own, lambda w: F.lower(w)), F.array(*[F.lit(w) for w in default]))

    return sources.select(
        "source_id", words(config["include_keywords"], [vocab.POWDER_WORD]).alias("include"),
        words(config["exclude_keywords"], vocab.FEED_EXCLUDE).alias("exclude"))


def powder_by_source(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Feed products (``source_id, item``) that their own source's word lists let through."""
    def occurs(text: Column, lists: str) -> Column:
        return F.exists(lists, lambda w: F.contains(text, w))

    item = F.col("item")
    named = stage(rows, {"_text": F.lower(_text(item["title"], item["product_type"]))}).join(words, "source_id")
    return named.filter(occurs(F.col("_text"), "include") & ~occurs(F.col("_text"), "exclude")).select(*rows.columns)


def powder_affiliate(item: Column) -> Column:
    name = F.coalesce(item["name"], F.lit(""))
    return _is_powder(name, F.lower(_text(name, item["categoryPath"])), vocab.AFFILIATE_EXCLUDE)


def powder_marketplace(item: Column) -> Column:
    title = F.coalesce(item["product_title"], F.lit(""))
    return _is_powder(title, F.lower(title), vocab.MARKETPLACE_EXCLUDE)


def powder_grocer(item: Column) -> Column:
    text = F.lower(F.concat_ws(" ", _text(item["description"], item["brand"]), item["categories"]))
    return _is_powder(text, text, vocab.GROCER_EXCLUDE)


def powder_auction(item: Column) -> Column:
    title = F.coalesce(item["title"], F.lit(""))
    feedback = F.coalesce(item["seller"]["feedbackPercentage"].try_cast("double"), F.lit(0.0))
    return _is_powder(title, F.lower(title), vocab.AUCTION_EXCLUDE) & (
        feedback >= vocab.MIN_SELLER_FEEDBACK
    )


LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml", pattern: str | None = None) -> DataFrame:
    """Every ``<loc>`` with its place in the sitemap, optionally only those matching a pattern."""
    kept = [c for c in sitemaps.columns if c != xml]
    urls = sitemaps.select(
        *kept, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(LOC), F.lit(1))).alias("pos", "url")
    )
    return urls.filter(F.rlike("url", F.lit(pattern))) if pattern else urls


def page_url_set(explicit: DataFrame, mapped: DataFrame, scope: str, cap: int | None = None) -> DataFrame:
    """Explicit URLs, then sitemap URLs; first place wins; with ``cap``, that many per source.

    Both inputs have (scope, pos, url).
    """
    both = explicit.select(scope, F.lit(0).alias("part"), "pos", "url").unionByName(
        mapped.select(scope, F.lit(1).alias("part"), "pos", "url")
    )
    firsts = both.groupBy(scope, "url").agg(F.min(F.struct("part", "pos")).alias("place"))
    if cap is None:
        return firsts
    order = Window.partitionBy(scope).orderBy("place", "url")
    return firsts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)


def changed_content(current: DataFrame, seen: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose content hash was not seen before under the same key."""
    hashed = current.withColumn("content_hash", F.sha2(F.col(text).cast("binary"), 256))
    return hashed.join(seen.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def scan_sources(defs: DataFrame) -> DataFrame:
    """Source definitions with their defaults filled in: enabled, US."""
    return defs.withColumns(
        {
            "enabled": F.coalesce("enabled", F.lit(True)),
            "market": F.coalesce("market", F.lit("US")),
        }
    )


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def sources_by_slug(sources: DataFrame, slugs: DataFrame) -> DataFrame:
    """Requested sources; unknown slugs are dropped silently."""
    return sources.join(slugs.select("slug").distinct(), "slug", "left_semi")


def byline_brand(byline: Column) -> Column:
    return F.trim(first_match(byline, r"(?i)(?:brand:|visit the)\s*(.+?)(?:\s+store)?$", 1))
