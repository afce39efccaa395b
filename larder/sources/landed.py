"""Landed retailer payloads: the catalog's variants written as each retailer's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import dealt
from larder.sources import fixtures as fx

SOURCE_COLUMNS = ["source_id", "source_slug", "source_name", "base_url", "market"]
PAGE_ITEMS = 25


def family_rows(cat, kind: str) -> DataFrame:
    """Variants sold by sources of one type, with the source's columns."""
    sources = cat.sources.filter(F.col("type") == kind).select(
        "source_id", F.col("slug").alias("source_slug"), F.col("name").alias("source_name"),
        "base_url", "market",
    )
    keys = dealt(cat.variant_keys, "variant_id").withColumn("source_id", F.col("sk"))
    return keys.join(sources, "source_id").withColumn("n", F.col("pk"))


def _fields(df: DataFrame, table: dict[str, str], *keep: str) -> DataFrame:
    return df.select(
        *SOURCE_COLUMNS, "pk", "sk", "n", *keep, *[F.expr(sql).alias(k) for k, sql in table.items()]
    )


def _payload(df: DataFrame, payload: Column, *keep: str) -> DataFrame:
    return df.select(*SOURCE_COLUMNS, "pk", "sk", *keep, payload.alias("payload"))


def _named(**columns: str) -> list[Column]:
    return [F.col(src).alias(name) for name, src in columns.items()]


def feed_items(cat) -> DataFrame:
    """Storefront feed products with two variants each. Tags are a list or one string."""
    rows = _fields(family_rows(cat, "shopify"), {**fx.FEED, "body_html": fx.FEED_BODY})

    def variant(j: int) -> Column:
        get = {
            k: F.expr(sql.replace("j", str(j)) if k == "vid" else _with_j(sql, j))
            for k, sql in fx.FEED_VARIANT.items()
        }
        first = F.when(F.col("layout") == 0, get["flavor_opt"]).when(
            F.col("layout") == 1, get["size_opt"]
        ).otherwise(F.lit("Default Title"))
        second = F.when(F.col("layout") == 0, get["size_opt"]).when(
            F.col("layout") == 1, get["flavor_opt"]
        )
        return F.struct(
            get["vid"].alias("id"),
            F.concat_ws(" / ", get["flavor_opt"], get["size_opt"]).alias("title"),
            first.alias("option1"), second.alias("option2"), get["price"].alias("price"),
            get["compare_at"].alias("compare_at_price"), get["available"].alias("available"),
            get["grams"].alias("grams"),
        )

    def option(name: str, position: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(position).alias("position"))

    options = (
        F.when(F.col("layout") == 0, F.array(option("Flavor", 1), option("Size", 2)))
        .when(F.col("layout") == 1, F.array(option("weight", 1), option("TASTE", 2)))
        .otherwise(F.array(option("Title", 1)))
    )
    common = [
        (F.col("pk") * 1000 + F.col("sk")).alias("id"), "handle", "title", "vendor", "product_type",
        "body_html", options.alias("options"), F.array(variant(0), variant(1)).alias("variants"),
    ]
    listed = F.to_json(F.struct(*common, F.array("tag_a", "tag_b").alias("tags")))
    joined = F.to_json(F.struct(*common, F.concat_ws(", ", "tag_a", "tag_b").alias("tags")))
    return _payload(rows, F.when(F.col("tag_style") == 0, listed).otherwise(joined))


def _with_j(sql: str, j: int) -> str:
    return sql.replace(" j)", f" {j})").replace("+ j", f"+ {j}").replace("j = 0", f"{j} = 0")


def affiliate_items(cat) -> DataFrame:
    rows = _fields(family_rows(cat, "walmart"), fx.AFFILIATE)
    item = F.struct(
        *_named(itemId="item_id", name="name", brandName="brand", salePrice="sale_price", msrp="msrp",
                upc="upc", categoryPath="category", availableOnline="online", stock="stock",
                shortDescription="short_text", longDescription="long_text"),
        F.lit("https://t.example/|PUBID|/x").alias("productTrackingUrl"),
    )
    return _payload(rows, F.to_json(item))


def marketplace_items(cat) -> DataFrame:
    rows = _fields(family_rows(cat, "amazon"), fx.MARKETPLACE)
    item = F.struct(*_named(asin="asin", product_title="title", product_price="price",
                            product_original_price="original", product_url="url"))
    return _payload(rows, F.to_json(item), "asin")


def marketplace_details(cat) -> DataFrame:
    """Detail payloads; some items have none."""
    rows = family_rows(cat, "amazon").filter(fx.MARKETPLACE_HAS_DETAIL)
    rows = _fields(rows, {"asin": fx.MARKETPLACE["asin"], **fx.MARKETPLACE_DETAIL})
    info = F.struct(
        F.col("i_brand").alias("Brand"), F.col("i_brand_name").alias("Brand Name"),
        F.col("i_maker").alias("Manufacturer"), F.col("i_weight").alias("Item Weight"),
        F.col("i_diet").alias("Diet Type"), F.col("i_allergen").alias("Allergen Information"),
        F.col("i_ingredients").alias("Ingredients"), F.col("i_protein").alias("Protein"),
        F.col("i_total_servings").alias("Total Servings Per Container"),
        F.col("i_servings").alias("Servings Per Container"),
        F.col("i_serving_size").alias("Serving Size"), F.col("i_fat").alias("Fat"),
        F.col("i_carb").alias("Carbohydrate"), F.col("i_upc").alias("Item UPC"),
    )
    detail = F.struct(
        *_named(product_title="d_title", product_price="d_price", product_original_price="d_original",
                product_url="d_url", product_byline="byline", product_availability="availability",
                product_description="description"),
        F.array("about").alias("about_product"), info.alias("product_information"),
        F.struct(F.col("x_gtin").alias("Global GTIN number")).alias("product_details"),
    )
    return rows.select("source_id", "asin", F.to_json(F.struct(detail.alias("data"))).alias("payload"))


def grocer_items(cat) -> DataFrame:
    rows = _fields(family_rows(cat, "kroger"), fx.GROCER)
    first = F.struct(
        F.col("first_size").alias("size"),
        F.struct(F.col("first_stock").alias("stockLevel")).alias("inventory"),
        F.struct(F.col("first_regular").alias("regular"), F.col("first_promo").alias("promo")).alias("price"),
    )
    second = F.struct(
        F.lit("5 lb").alias("size"), F.struct(F.lit("HIGH").alias("stockLevel")).alias("inventory"),
        F.struct(F.col("second_regular").alias("regular"), F.lit(None).cast("double").alias("promo")).alias("price"),
    )
    allergen = F.struct(F.col("allergen_name").alias("name"), F.col("allergen_level").alias("levelOfContainmentName"))
    item = F.struct(
        *_named(productId="product_code", brand="brand", description="name", nonGmoClaimName="gmo",
                organicClaimName="organic"),
        F.array("cat_a").alias("categories"),
        F.when(F.col("has_items"), F.array(first, second)).alias("items"),
        F.array(allergen).alias("allergens"), F.array("declaration").alias("manufacturerDeclarations"),
    )
    return _payload(rows, F.to_json(item))


def auction_items(cat) -> DataFrame:
    rows = _fields(family_rows(cat, "ebay"), fx.AUCTION)
    money = lambda v: F.struct(F.col(v).alias("value"), F.col("currency"))
    item = F.struct(
        *_named(itemId="item_id", title="title", brand="brand", itemWebUrl="url"),
        money("price").alias("price"),
        F.when(F.col("original").isNotNull(), F.struct(money("original").alias("originalPrice"))).alias("marketingPrice"),
        F.struct(F.col("feedback").alias("feedbackPercentage")).alias("seller"),
    )
    return _payload(rows, F.to_json(item), "item_id")


def auction_details(cat) -> DataFrame:
    rows = _fields(family_rows(cat, "ebay").filter(fx.AUCTION_HAS_ITEM), fx.AUCTION)
    aspect = F.struct(F.col("aspect_name").alias("name"), F.col("aspect_value").alias("value"))
    detail = F.struct("gtin", F.array(aspect).alias("localizedAspects"))
    return rows.select("source_id", "item_id", F.to_json(detail).alias("payload"))


def product_pages(cat) -> DataFrame:
    """Product pages with schema.org JSON: a plain node, a list, or a graph behind another block."""
    rows = _fields(family_rows(cat, "jsonld"), fx.PAGE)
    url = F.concat("base_url", F.lit("/p/"), F.col("pk").cast("string"))
    offer = F.to_json(F.struct(*_named(price="price", lowPrice="low_price", priceCurrency="currency",
                                       availability="availability")))
    offers = (
        F.when(F.col("offer_style") == 0, F.concat(F.lit(',"offers":['), offer, F.lit("]")))
        .when(F.col("offer_style") == 3, F.lit(""))
        .otherwise(F.concat(F.lit(',"offers":'), offer))
    )
    brand = (
        F.when(F.col("brand_style") == 0, F.concat(F.lit(',"brand":'), F.to_json(F.struct(F.col("brand").alias("name")))))
        .when(F.col("brand_style") == 1, F.concat(F.lit(',"brand":"'), F.col("brand"), F.lit('"')))
        .otherwise(F.lit(""))
    )
    base = F.to_json(F.struct(*_named(name="name", sku="sku", productID="product_code",
                                      category="category", description="description")))
    kind = F.when(F.col("offer_style") == 1, '"@type":["Thing","Product"]').otherwise('"@type":"Product"')
    node = F.concat(F.lit("{"), kind, F.lit(","), F.expr("substring(_base, 2, length(_base) - 2)"), brand, offers, F.lit("}"))
    bare = F.lit('{"@type":"Product","name":"Related item"}')
    block = (
        F.when(F.col("wrap_style") == 0, F.col("_node"))
        .when(F.col("wrap_style") == 1, F.concat(F.lit("["), bare, F.lit(","), F.col("_node"), F.lit("]")))
        .otherwise(F.concat(F.lit('{"@graph":[{"@type":"WebSite","name":"x"},'), F.col("_node"), F.lit("]}")))
    )
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    html = F.concat(
        F.lit("<html><head><title>t</title>"), script(F.lit("{broken")), script(block),
        F.lit("</head><body><h1>"), F.col("name"), F.lit("</h1><p>"), F.expr(fx.FACTS_TEXT),
        F.lit("</p></body></html>"),
    )
    built = rows.withColumn("_base", base).withColumn("_node", node)
    return built.select(*SOURCE_COLUMNS, "pk", "sk", url.alias("url"), html.alias("html"))


def barcode_lookups(cat) -> DataFrame:
    """Barcode database responses as JSON, one per coded part; some are "not found"."""
    parts = cat.table("part").select(F.col("p_partkey").alias("pk")).filter("pk % 5 <> 0")
    rows = parts.select("pk", F.expr(fx.UPC).alias("upc"), F.expr(fx.BARCODE_FOUND).alias("found"),
                        *[F.expr(sql).alias(k) for k, sql in fx.BARCODE.items()])
    nutriments = F.struct(
        F.col("protein_serving").alias("proteins_serving"), F.col("protein_100g").alias("proteins_100g"),
        F.col("fat_100g"), F.col("carb_100g").alias("carbohydrates_100g"),
        F.col("sugar_serving").alias("sugars_serving"), F.col("kcal_100g").alias("energy-kcal_100g"),
    )
    product = F.struct(
        "serving_quantity", "serving_size", "product_quantity", "ingredients_text",
        "ingredients_text_en", F.array("allergen_tag").alias("allergens_tags"),
        F.array("label_tag").alias("labels_tags"), nutriments.alias("nutriments"),
    )
    hit = F.to_json(F.struct(F.lit(1).alias("status"), product.alias("product")))
    return rows.select("upc", F.when(F.col("found"), hit).otherwise('{"status":0}').alias("payload"))


def result_pages(items: DataFrame, key: str, path: str) -> DataFrame:
    """Search result pages holding ``items``: every item is found by query 0, every third part
    again by query 1. ``path`` is the JSON path of the list, dot separated."""
    slot = F.floor(F.col("pk") / PAGE_ITEMS)
    seen = items.withColumn(
        "query", F.explode(F.when(F.col("pk") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("page", slot)
    grouped = seen.groupBy(*SOURCE_COLUMNS, "query", "page").agg(
        F.array_sort(F.collect_list(F.struct("pk", "payload"))).alias("rows")
    )
    body = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["payload"]), ","), F.lit("]"))
    for name in reversed(path.split(".")):
        body = F.concat(F.lit('{"' + name + '":'), body, F.lit("}"))
    return grouped.select(*SOURCE_COLUMNS, "query", "page", body.alias("payload"))
