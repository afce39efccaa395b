"""Retailer payloads to one product/variant schema: one job per payload family, in a registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import nutrition as nut
from larder.functions import units, vocab
from larder.functions.facets import add_facts, classify_category, empty_tags, extract_ingredients
from larder.functions.identity import slugify
from larder.functions.market import currency_for_market, marketplace_domain
from larder.functions.text import STARTS, ENDS, blank_to_null, collapse_ws, contains_any, first_number, let, stage, truthy
from larder.operators.metrics import genuine_markdown
from larder.sources import feeds

SCHEMA = [
    "source_id", "source_slug", "market", "source_sku", "url", "title", "brand_name",
    "product_name", "category", "source_variant_id", "flavor", "size_g", "size_label",
    "price_cents", "currency", "in_stock", "upc", "compare_at_price_cents", "nutrition", "facts",
]
_NUTRITION_TYPE = (
    "struct<serving_size_g:double,servings_per_container:double,protein_g:double,fat_g:double,"
    "carb_g:double,sugar_g:double,calories_kcal:double,extraction_method:string>"
)
_FACTS_TYPE = (
    "struct<ingredients_text:string,dietary_labels:array<string>,allergens:array<string>,"
    "sweeteners:array<string>>"
)
BARCODE = rf"{STARTS}([0-9]{{12,14}}){ENDS}"

Normalizer = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Normalizer] = {}


def register_normalizer(source_type: str, fn: Normalizer) -> None:
    """Plug in a payload family: landed rows in, rows of ``SCHEMA`` out."""
    _REGISTRY[source_type] = fn


def normalizer(source_type: str) -> Normalizer:
    if source_type not in _REGISTRY:
        raise ValueError(f"no normalizer registered for source type {source_type!r}")
    return _REGISTRY[source_type]


def union_normalized(landed: dict[str, DataFrame]) -> DataFrame:
    """All families in one schema."""
    parts = [normalizer(kind)(rows) for kind, rows in landed.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _first_text(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def _nutrition(prefix: str, method: Column) -> Column:
    fields = [F.col(f"{prefix}{name}").alias(name) for name in nut.FIELDS]
    return F.struct(*fields, method.alias("extraction_method"))


def _no_nutrition() -> Column:
    return F.lit(None).cast(_NUTRITION_TYPE)


def priced_only(df: DataFrame) -> DataFrame:
    """Rows whose price is unknown or zero are not offers."""
    return df.filter(F.col("price_cents") > 0)


def _unpacked(df: DataFrame, schema: str) -> tuple[DataFrame, dict[str, Column]]:
    """Parses the payload and lays its fields out as plain ``i_*`` columns, so later steps prune
    and filter on columns instead of reaching into one struct."""
    parsed = df if "item" in df.columns else feeds.parse(df, schema)
    names = parsed.schema["item"].dataType.names
    fields = [F.col(f"item.{name}").alias(f"i_{name}") for name in names]
    kept = [c for c in parsed.columns if c != "item"]
    return parsed.select(*kept, *fields), {name: F.col(f"i_{name}") for name in names}


# ---- Storefront feed ---------------------------------------------------------------------------


def feed_tags(item) -> Column:
    """Tags as one text; they arrive as a list or as a string."""
    listed = F.array_join(F.from_json(item["tags"], "array<string>"), " ")
    return F.when(item["tags"].startswith("["), listed).otherwise(_text_or_empty(item["tags"]))


def stage_feed(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Product fields, page text, tags text and the product's own nutrition as ``p_*`` columns."""
    df, item = _unpacked(rows, feeds.FEED_PRODUCT)
    df = stage(df, {"text": nut.html_to_text(item["body_html"]), "tags_text": feed_tags(item)})
    df = df.withColumn("told", blank_to_null(F.col("text")))
    parsed = nut.parse_nutrition_text(F.col("told"))
    return stage(df, {f"p_{name}": col for name, col in parsed.items()}).drop("told"), item


def _option_position(options: Column, names: list[str]) -> Column:
    hits = F.filter(options, lambda o: F.lower(o["name"]).isin(names))
    return F.try_element_at(F.transform(hits, lambda o: o["position"]), F.lit(1))


def _option_value(variant: Column, position: Column) -> Column:
    return F.coalesce(*[F.when(position == k, variant[f"option{k}"]) for k in (1, 2, 3)])


def nutrition_feed(df: DataFrame, fallback: DataFrame | None = None, key: str = "source_sku") -> DataFrame:
    """The product's nutrition from its page text. Incomplete rows are filled from ``fallback``
    (columns ``key`` and the seven fields); complete rows never enter that join."""
    staged = df.withColumn(
        "method", F.when(F.col("text") != "", F.lit("html_parse"))
    )
    if fallback is None:
        return staged
    complete = nut.is_complete(F.col("p_protein_g"), F.col("p_servings_per_container"))
    needs = ~complete & (F.col("text") != "")
    other = fallback.select(key, *[F.col(f).alias(f"f_{f}") for f in nut.FIELDS])
    joined = staged.filter(needs).join(other, key, "left")
    merged = nut.merge_nutrition(
        {f: F.col(f"p_{f}") for f in nut.FIELDS}, {f: F.col(f"f_{f}") for f in nut.FIELDS},
        F.col("method"),
    )
    filled = joined.select(
        *[c for c in staged.columns if not c.startswith("p_") and c != "method"],
        *[merged[f].alias(f"p_{f}") for f in nut.FIELDS],
        merged["extraction_method"].alias("method"),
    )
    return staged.filter(~needs).unionByName(filled)


def normalize_feed(rows: DataFrame) -> DataFrame:
    staged, item = stage_feed(rows)
    staged = nutrition_feed(staged.filter(item["handle"] != ""))
    staged = add_facts(
        stage(staged, {"ingredients": extract_ingredients(F.col("text"))}), F.col("ingredients"),
        F.concat(F.col("tags_text"), F.lit(" "), _text_or_empty(item["product_type"])),
    )
    title = F.coalesce(item["title"], item["handle"])
    words = F.concat_ws(
        " ", _text_or_empty(item["title"]), _text_or_empty(item["product_type"]), F.col("tags_text")
    )
    staged = staged.withColumns(
        {
            "title": title,
            "category_text": F.lower(words),
            "flavor_at": _option_position(item["options"], vocab.FLAVOR_OPTIONS),
            "size_at": _option_position(item["options"], vocab.SIZE_OPTIONS),
        }
    )
    v = F.col("variant")
    variants = stage(
        staged.withColumn("variant", F.explode(item["variants"])),
        {
            "price_cents": units.cents_from_text(v["price"]),
            "size_label": _option_value(v, F.col("size_at")),
            "compare_at": units.cents_from_text(v["compare_at_price"]),
        },
    )
    size = F.coalesce(
        truthy(units.parse_weight_g(F.col("size_label"))),
        truthy(units.parse_weight_g(v["title"])),
        truthy(v["grams"].cast("double")),
    )
    variants = stage(priced_only(variants), {"size_g": size})
    servings = nut.fill_servings(
        F.col("p_servings_per_container"),
        [v["title"], v["option1"], v["option2"], F.col("title")],
        F.col("size_g"), F.col("p_serving_size_g"),
    )
    variants = variants.withColumn("p_servings_per_container", servings)
    return variants.select(
        "source_id", "source_slug", "market",
        item["handle"].alias("source_sku"),
        F.concat("base_url", F.lit("/products/"), item["handle"]).alias("url"),
        "title",
        _first_text(item["vendor"], F.col("source_name")).alias("brand_name"),
        F.col("title").alias("product_name"),
        classify_category(F.col("category_text")).alias("category"),
        v["id"].cast("string").alias("source_variant_id"),
        units.clean_flavor(_option_value(v, F.col("flavor_at"))).alias("flavor"),
        "size_g", "size_label", "price_cents",
        currency_for_market(F.col("market")).alias("currency"),
        F.coalesce(v["available"], F.lit(True)).alias("in_stock"),
        F.lit(None).cast("string").alias("upc"),
        genuine_markdown(F.col("compare_at"), F.col("price_cents")).alias("compare_at_price_cents"),
        F.when(F.col("method").isNotNull(), _nutrition("p_", F.col("method"))).alias("nutrition"),
        "facts",
    )


# ---- Affiliate catalog -------------------------------------------------------------------------


def join_lookup(items: DataFrame, lookups: DataFrame) -> DataFrame:
    """Search items with their item lookup. The lookup replaces the item, because search prices
    are stale; an item without one is dropped."""
    keyed = lookups.withColumn("_id", F.col("item.itemId"))
    fresh = keyed.groupBy("source_id", "_id").agg(F.max("item").alias("_fresh"))  # landed twice: once
    searched = items.withColumn("_id", F.col("item.itemId"))
    joined = searched.join(fresh, ["source_id", "_id"])
    return joined.withColumn("item", F.col("_fresh")).drop("_fresh", "_id")


def normalize_affiliate(rows: DataFrame, publisher_id: str | None = None) -> DataFrame:
    df, item = _unpacked(rows, feeds.AFFILIATE_ITEM)
    sku = item["itemId"].cast("string")
    df = stage(
        df,
        {
            "title": _first_text(item["name"], sku),
            "price_cents": units.cents_from_number(item["salePrice"]),
            "about": F.concat(
                _text_or_empty(item["shortDescription"]), F.lit(" "),
                _text_or_empty(item["longDescription"]),
            ),
        },
    )
    df = priced_only(df.filter(item["itemId"].isNotNull()))
    df = stage(df, {"ingredients": extract_ingredients(F.col("about"))})
    df = add_facts(df, F.col("ingredients"), F.col("about"))
    df = df.withColumn(
        "category_text",
        F.lower(F.concat("title", F.lit(" "), _text_or_empty(item["categoryPath"]))),
    )
    url = F.concat(F.lit("https://www.walmart.com/ip/"), sku)
    if publisher_id:
        tracked = F.replace(item["productTrackingUrl"], F.lit("|PUBID|"), F.lit(publisher_id))
        url = F.coalesce(blank_to_null(tracked), url)
    in_stock = F.coalesce(item["availableOnline"], F.lit(True)) & (
        F.lower(F.coalesce(item["stock"], F.lit("Available"))) != "not available"
    )
    return df.select(
        "source_id", "source_slug", "market", sku.alias("source_sku"), url.alias("url"), "title",
        _first_text(item["brandName"], F.lit("Unknown")).alias("brand_name"),
        F.col("title").alias("product_name"),
        classify_category(F.col("category_text")).alias("category"),
        sku.alias("source_variant_id"),
        F.lit(None).cast("string").alias("flavor"),
        units.parse_container_g(F.col("title")).alias("size_g"),
        F.lit(None).cast("string").alias("size_label"),
        "price_cents", F.lit("USD").alias("currency"), in_stock.alias("in_stock"),
        blank_to_null(item["upc"]).alias("upc"),
        genuine_markdown(units.cents_from_number(item["msrp"]), F.col("price_cents")).alias(
            "compare_at_price_cents"
        ),
        _no_nutrition().alias("nutrition"), "facts",
    )


# ---- Marketplace search with details -----------------------------------------------------------


def one_per_id(details: DataFrame, key: str) -> DataFrame:
    """One detail payload per source and real id. Items without an id are never looked up, and a
    payload landed twice must not multiply its item: the newest by ``landed_at`` counts where the
    table has that column, else the greatest text."""
    order = F.struct("landed_at", "payload") if "landed_at" in details.columns else F.col("payload")
    real = details.filter(F.col(key) != "")
    return real.groupBy("source_id", key).agg(F.max_by("payload", order).alias("payload"))


def join_details(items: DataFrame, details: DataFrame | None) -> DataFrame:
    """Search items with their details where there are any; details may be switched off."""
    typed = feeds.MARKETPLACE_DETAIL
    if details is None:
        return items.withColumn("d", F.lit(None).cast(typed))
    body = one_per_id(details, "asin").select(
        "source_id", "asin", F.from_json("payload", f"struct<data:{typed}>")["data"].alias("d")
    )
    return items.join(body, ["source_id", "asin"], "left")


def marketplace_brand(details: Column, info: Callable[[str], Column]) -> Column:
    """Consumer brand before the store line, and the maker last."""
    return F.coalesce(
        F.trim(blank_to_null(info("Brand"))), F.trim(blank_to_null(info("Brand Name"))),
        feeds.byline_brand(details["product_byline"]), F.trim(blank_to_null(info("Manufacturer"))),
    )


def marketplace_upc(details: Column) -> Column:
    """First attribute whose name speaks of a barcode and whose value holds 12 to 14 digits."""
    def first_code(attributes: Column) -> Column:
        coded = F.filter(
            F.map_entries(attributes),
            lambda e: contains_any(F.lower(e["key"]), vocab.BARCODE_ATTRIBUTES)
            & F.rlike(e["value"], F.lit(BARCODE)),
        )
        return let(
            F.try_element_at(F.transform(coded, lambda e: e["value"]), F.lit(1)),
            lambda value: F.regexp_extract(value, BARCODE, 1),
        )

    return F.coalesce(
        first_code(details["product_information"]), first_code(details["product_details"])
    )


def stage_marketplace(rows: DataFrame) -> DataFrame:
    d = F.col("d")
    df, item = _unpacked(rows, feeds.MARKETPLACE_ITEM)
    info = lambda name: F.try_element_at(d["product_information"], F.lit(name))
    about = F.coalesce(F.array_join(d["about_product"], " "), F.lit(""))
    diets = F.transform(F.split(_text_or_empty(info("Diet Type")), ","), lambda s: collapse_ws(s))
    allergen = F.trim(_text_or_empty(info("Allergen Information")))
    return stage(
        df,
        {
            "title": _first_text(d["product_title"], item["product_title"], item["asin"]),
            "price_cents": units.cents_from_text(_first_text(item["product_price"], d["product_price"])),
            "about": F.concat(about, F.lit(" "), _text_or_empty(d["product_description"])),
            "labels": F.array_join(F.filter(diets, lambda s: s != ""), " "),
            "named": F.when(allergen != "", F.array(allergen)).otherwise(empty_tags()),
            "listed": blank_to_null(info("Ingredients")),
            "n_protein_g": _number(info("Protein")),
            "n_servings_per_container": F.coalesce(
                _number(info("Total Servings Per Container")), _number(info("Servings Per Container"))
            ),
            "n_serving_size_g": units.parse_weight_g(info("Serving Size")),
            "n_fat_g": F.coalesce(_number(info("Total Fat")), _number(info("Fat"))),
            "n_carb_g": F.coalesce(
                _number(info("Total Carbohydrate")), _number(info("Carbohydrate")),
                _number(info("Total Carbohydrates")),
            ),
            "n_sugar_g": F.lit(None).cast("double"),
            "n_calories_kcal": F.lit(None).cast("double"),
            "brand_name": F.coalesce(marketplace_brand(d, info), F.lit("Unknown")),
            "weight_text": info("Item Weight"),
        },
    )


def _number(value: Column) -> Column:
    return first_number(value, r"([0-9]+(?:\.[0-9]+)?)")


def normalize_marketplace(rows: DataFrame) -> DataFrame:
    """``rows`` are search items already joined with details (column ``d``)."""
    df = priced_only(stage_marketplace(rows).filter(F.col("i_asin") != ""))
    df = stage(df, {"ingredients": F.coalesce("listed", extract_ingredients(F.col("about")))})
    df = add_facts(df, F.col("ingredients"), F.col("labels"), F.col("named"))
    d = F.col("d")
    item = {name: F.col(f"i_{name}") for name in ("asin", "product_original_price", "product_url")}
    original = units.cents_from_text(
        _first_text(item["product_original_price"], d["product_original_price"])
    )
    url = _first_text(
        d["product_url"], item["product_url"],
        F.concat(F.lit("https://www."), marketplace_domain(F.col("market")), F.lit("/dp/"), item["asin"]),
    )
    available = F.lower(_text_or_empty(d["product_availability"]))
    known = F.col("n_protein_g").isNotNull() | F.col("n_servings_per_container").isNotNull()
    return df.withColumn("lower_title", F.lower("title")).select(
        "source_id", "source_slug", "market", item["asin"].alias("source_sku"), url.alias("url"),
        "title", "brand_name", F.col("title").alias("product_name"),
        classify_category(F.col("lower_title")).alias("category"),
        item["asin"].alias("source_variant_id"),
        F.lit(None).cast("string").alias("flavor"),
        F.coalesce(
            truthy(units.parse_weight_g(F.col("weight_text"))), units.parse_container_g(F.col("title"))
        ).alias("size_g"),
        F.lit(None).cast("string").alias("size_label"),
        "price_cents", currency_for_market(F.col("market")).alias("currency"),
        (~F.contains(available, F.lit("unavailable")) & ~F.contains(available, F.lit("out of stock"))).alias("in_stock"),
        marketplace_upc(d).alias("upc"),
        genuine_markdown(original, F.col("price_cents")).alias("compare_at_price_cents"),
        F.when(known, _nutrition("n_", F.lit("html_parse"))).alias("nutrition"),
        "facts",
    )


# ---- Grocer ------------------------------------------------------------------------------------


def normalize_grocer(rows: DataFrame) -> DataFrame:
    df, item = _unpacked(rows, feeds.GROCER_ITEM)
    code = item["productId"]
    priced = F.filter(item["items"], lambda i: i["price"]["regular"] != 0)
    df = df.filter((code != "") & (F.size(F.coalesce(item["items"], F.array())) > 0)).withColumn(
        "unit", F.coalesce(F.try_element_at(priced, F.lit(1)), F.try_element_at(item["items"], F.lit(1)))
    )
    df = stage(
        df,
        {
            "regular": units.cents_from_number(F.col("unit.price.regular")),
            "promo": units.cents_from_number(F.col("unit.price.promo")),
            "title": _first_text(item["description"], code),
            "size_label": blank_to_null(F.col("unit.size")),
        },
    )
    on_sale = (F.col("promo") > 0) & (
        F.col("regular").isNull() | (F.col("regular") == 0) | (F.col("promo") < F.col("regular"))
    )
    on_sale = F.coalesce(on_sale, F.lit(False))
    df = priced_only(df.withColumn("price_cents", F.when(on_sale, F.col("promo")).otherwise(F.col("regular"))))
    declared = F.array_join(item["manufacturerDeclarations"], " ")
    labels = F.concat_ws(
        " ", _text_or_empty(item["nonGmoClaimName"]), _text_or_empty(item["organicClaimName"]),
        _text_or_empty(declared),
    )
    named = F.transform(
        F.filter(item["allergens"], lambda a: a["levelOfContainmentName"].isin(vocab.GROCER_CONTAINMENT)),
        lambda a: F.coalesce(a["name"], F.lit("")),
    )
    df = add_facts(df, F.lit(None).cast("string"), labels, named)
    df = df.withColumn(
        "category_text",
        F.lower(F.concat("title", F.lit(" "), _text_or_empty(F.array_join(item["categories"], " ")))),
    )
    stock = F.upper(_text_or_empty(F.col("unit.inventory.stockLevel")))
    return df.select(
        "source_id", "source_slug", "market", code.alias("source_sku"),
        F.concat(
            F.lit("https://www.kroger.com/p/"), _first_text(slugify(F.col("title")), F.lit("product")),
            F.lit("/"), code,
        ).alias("url"),
        "title",
        _first_text(F.trim(item["brand"]), F.lit("Unknown")).alias("brand_name"),
        F.col("title").alias("product_name"),
        classify_category(F.col("category_text")).alias("category"),
        code.alias("source_variant_id"),
        F.lit(None).cast("string").alias("flavor"),
        units.parse_container_g(
            F.concat("title", F.lit(" "), _text_or_empty(F.col("size_label")))
        ).alias("size_g"),
        "size_label", "price_cents", F.lit("USD").alias("currency"),
        (~stock.isin(vocab.GROCER_OUT_OF_STOCK)).alias("in_stock"),
        F.when(F.rlike(code, F.lit("^[0-9]{12,}$")), code).alias("upc"),
        F.when(on_sale & (F.col("regular") > F.col("promo")), F.col("regular")).alias(
            "compare_at_price_cents"
        ),
        _no_nutrition().alias("nutrition"), "facts",
    )


# ---- Auction site ------------------------------------------------------------------------------


def auction_gtin(item: Column) -> Column:
    """Numeric barcode of an item, else a barcode aspect of at least 12 digits."""
    aspects = F.filter(
        F.transform(
            item["localizedAspects"],
            lambda a: F.struct(F.lower(a["name"]).alias("name"), F.trim(a["value"]).alias("value")),
        ),
        lambda a: a["name"].isin(vocab.BARCODE_ATTRIBUTES) & F.rlike(a["value"], F.lit("^[0-9]{12,}$")),
    )
    return F.coalesce(
        F.when(F.rlike(item["gtin"], F.lit("^[0-9]+$")), item["gtin"]),
        F.try_element_at(F.transform(aspects, lambda a: a["value"]), F.lit(1)),
    )


def join_item(items: DataFrame, details: DataFrame) -> DataFrame:
    """Summaries with the barcode of their item, where there is one."""
    body = one_per_id(details, "item_id").select(
        "source_id", "item_id", auction_gtin(F.from_json("payload", feeds.AUCTION_ITEM)).alias("upc")
    )
    return items.join(body, ["source_id", "item_id"], "left")


def currency_guard(df: DataFrame, currency: Column) -> DataFrame:
    """Only prices in the market's own currency; a missing currency passes."""
    expected = currency_for_market(F.col("market"))
    return df.filter(F.coalesce(currency, expected) == expected)


def normalize_auction(rows: DataFrame) -> DataFrame:
    """``rows`` are summaries already joined with their barcode (column ``upc``)."""
    df, item = _unpacked(rows, feeds.AUCTION_SUMMARY)
    df = stage(
        df.filter((item["itemId"] != "") & (item["title"] != "")),
        {
            "price_cents": units.cents_from_text(item["price"]["value"]),
            "original": units.cents_from_text(item["marketingPrice"]["originalPrice"]["value"]),
            "title": item["title"],
        },
    )
    df = currency_guard(priced_only(df), item["price"]["currency"])
    return df.withColumn("lower_title", F.lower("title")).select(
        "source_id", "source_slug", "market", item["itemId"].alias("source_sku"),
        _first_text(
            item["itemWebUrl"], F.concat(F.lit("https://www.ebay.com/itm/"), item["itemId"])
        ).alias("url"),
        "title",
        _first_text(F.trim(item["brand"]), F.lit("Unknown")).alias("brand_name"),
        F.col("title").alias("product_name"),
        classify_category(F.col("lower_title")).alias("category"),
        item["itemId"].alias("source_variant_id"),
        F.lit(None).cast("string").alias("flavor"),
        units.parse_container_g(F.col("title")).alias("size_g"),
        F.lit(None).cast("string").alias("size_label"),
        "price_cents", currency_for_market(F.col("market")).alias("currency"),
        F.lit(True).alias("in_stock"), "upc",
        genuine_markdown(F.col("original"), F.col("price_cents")).alias("compare_at_price_cents"),
        _no_nutrition().alias("nutrition"),
        F.lit(None).cast(_FACTS_TYPE).alias("facts"),
    )


# ---- Product pages with schema.org JSON --------------------------------------------------------

LD_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"


def json_block(text: Column) -> Column:
    """The JSON of a block, null where it is none. An object whose first name has no quote is told without
    an attempt to parse it: a failure costs an exception, many times what a block costs."""
    return F.when(~F.rlike(text, F.lit(r"^\s*\{\s*[^\s\"}]")), F.try_parse_json(text))


def _get(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def _is_product(node: Column) -> Column:
    several = F.array_contains(_get(node, '$["@type"]', "array<string>"), "Product")
    return F.coalesce(several, F.lit(False)) | F.coalesce(
        _get(node, '$["@type"]') == "Product", F.lit(False)
    )


def _opened(entry: Column) -> Column:
    """The entries that stand for one: a list's members, a graph's members and then its holder, or
    the entry itself. ``open`` marks those that may hold more."""
    node = entry["node"]
    members = _get(node, "$", "array<variant>")
    graph = _get(node, '$["@graph"]', "array<variant>")
    as_open = lambda nodes: F.transform(nodes, lambda v: F.struct(v.alias("node"), F.lit(True).alias("open")))
    closed = F.array(F.struct(node.alias("node"), F.lit(False).alias("open")))
    held = F.when(members.isNotNull(), as_open(members)).when(graph.isNotNull(), F.concat(as_open(graph), closed)).otherwise(closed)
    return F.when(entry["open"], held).otherwise(F.array(entry))


def product_nodes(html: Column) -> Column:
    """Product nodes of a page in document order: members of lists and graphs of any depth, a
    graph's members before their holder.

    All open entries are opened at once, again and again until none is left. No page nests deeper
    than it has opening brackets, so that many rounds are the limit; those after the last do nothing.
    """
    def walked(blocks: Column) -> Column:
        parsed = F.filter(F.transform(blocks, json_block), lambda v: v.isNotNull())
        entries = F.transform(parsed, lambda v: F.struct(v.alias("node"), F.lit(True).alias("open")))
        brackets = F.length(F.regexp_replace(F.array_join(blocks, ""), r"[^\[]+", ""))
        return F.aggregate(
            F.sequence(F.lit(0), brackets), entries,
            lambda held, _: F.when(F.exists(held, lambda e: e["open"]), F.flatten(F.transform(held, _opened))).otherwise(held))

    nodes = let(F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1)), walked)
    return F.filter(F.transform(nodes, lambda e: e["node"]), _is_product)


def has_offers(node: Column) -> Column:
    text = _get(node, "$.offers", "variant").cast("string")
    return F.coalesce(~text.isin("", "[]", "{}", "null"), F.lit(False))


def pick_node(nodes: Column) -> Column:
    """First node that carries an offer, else the first node."""
    return let(nodes, lambda held: F.coalesce(
        F.try_element_at(F.filter(held, has_offers), F.lit(1)), F.try_element_at(held, F.lit(1))
    ))


def pick_offer(node: Column) -> Column:
    """The offer object; the first of a list."""
    return let(node, lambda held: F.coalesce(
        F.try_element_at(_get(held, "$.offers", "array<variant>"), F.lit(1)), _get(held, "$.offers", "variant")
    ))


def offer_price(offer: Column) -> Column:
    price = _get(offer, "$.price")
    zero = F.coalesce(_get(offer, "$.price", "variant").cast("string") == "0", F.lit(False))
    return F.coalesce(F.when(~zero, blank_to_null(price)), _get(offer, "$.lowPrice"))


def node_brand(node: Column) -> Column:
    """Name of a brand object, else the brand when it is plain text."""
    named = _get(node, "$.brand.name")
    raw = _get(node, "$.brand", "variant").cast("string")
    return F.coalesce(named, F.when(~raw.startswith("{") & ~raw.startswith("["), raw))


def jsonld_products(pages: DataFrame) -> DataFrame:
    """One row per Product node of each page, in page order."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.posexplode(product_nodes(F.col("html"))).alias("pos", "node"))


def normalize_pages(rows: DataFrame) -> DataFrame:
    df = stage(rows, {"node": pick_node(product_nodes(F.col("html")))})
    df = df.filter(F.col("node").isNotNull())
    node = F.col("node")
    df = stage(df, {"offer": pick_offer(node)})
    offer = F.col("offer")
    df = stage(
        df,
        {
            "price_cents": units.cents_from_text(offer_price(offer)),
            "title": _first_text(_get(node, "$.name"), F.col("url")),
            "sku": _first_text(_get(node, "$.sku"), _get(node, "$.productID"), F.col("url")),
            "availability": F.lower(_text_or_empty(_get(offer, "$.availability"))),
            "described": blank_to_null(_get(node, "$.description")),
        },
    )
    df = stage(
        priced_only(df),
        {
            "size_g": units.parse_weight_g(F.col("title")),
            "text": nut.html_to_text(F.coalesce("described", "html")),
            "category_text": F.lower(
                F.concat("title", F.lit(" "), _text_or_empty(_get(node, "$.category")))
            ),
        },
    )
    parsed = nut.parse_nutrition_text(F.col("text"))
    df = stage(df, {f"p_{name}": col for name, col in parsed.items()})
    servings = nut.fill_servings(
        F.col("p_servings_per_container"), [F.col("title")], F.col("size_g"), F.col("p_serving_size_g")
    )
    df = df.withColumn("p_servings_per_container", servings)
    known = F.col("p_protein_g").isNotNull() | F.col("p_serving_size_g").isNotNull()
    availability = F.col("availability")
    return df.select(
        "source_id", "source_slug", "market", F.col("sku").alias("source_sku"), "url", "title",
        _first_text(node_brand(node), F.col("source_name"), F.lit("Unknown")).alias("brand_name"),
        F.col("title").alias("product_name"),
        classify_category(F.col("category_text")).alias("category"),
        F.col("sku").alias("source_variant_id"),
        F.lit(None).cast("string").alias("flavor"), "size_g",
        F.lit(None).cast("string").alias("size_label"), "price_cents",
        F.coalesce(_get(offer, "$.priceCurrency"), F.lit("USD")).alias("currency"),
        (F.contains(availability, F.lit("instock")) | (availability == "")).alias("in_stock"),
        F.lit(None).cast("string").alias("upc"),
        F.lit(None).cast("int").alias("compare_at_price_cents"),
        F.when(known, _nutrition("p_", F.lit("html_parse"))).alias("nutrition"),
        F.lit(None).cast(_FACTS_TYPE).alias("facts"),
    )


for _kind, _fn in [
    ("shopify", normalize_feed), ("walmart", normalize_affiliate), ("amazon", normalize_marketplace),
    ("kroger", normalize_grocer), ("ebay", normalize_auction), ("jsonld", normalize_pages),
]:
    register_normalizer(_kind, _fn)
