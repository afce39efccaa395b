"""How the driver's star-schema tables are read as a price catalog.

Every expression below is plain SQL that Spark and the checking database both accept (integer and
exact binary arithmetic only). ``pk`` and ``sk`` are the part and supplier keys of a variant. The
adapter puts them into DataFrames; the checks put the same input text into their own queries, so
only inputs are shared and never the operator under test.
"""

MARKET = "CASE n_regionkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' ELSE 'IN' END"
SOURCE_TYPE = (
    "CASE s_suppkey % 6 WHEN 0 THEN 'shopify' WHEN 1 THEN 'walmart' WHEN 2 THEN 'amazon' "
    "WHEN 3 THEN 'kroger' WHEN 4 THEN 'ebay' ELSE 'jsonld' END"
)
ENABLED = "CASE WHEN s_suppkey % 10 = 9 THEN CAST(NULL AS BOOLEAN) ELSE s_acctbal > 0 END"

VARIANT_ID = "CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"

PRICE_CENTS = "CAST(1000 + CAST(floor(l_extendedprice) AS BIGINT) % 9000 AS INT)"
TIE_COLUMNS = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

FLAVOR = (
    "CASE (pk + sk) % 4 WHEN 0 THEN 'Chocolate' WHEN 1 THEN 'Vanilla' WHEN 3 THEN 'Strawberry' END"
)
SIZE_G = "CASE WHEN (pk + sk) % 7 <> 0 THEN CAST(300 + 10 * ((pk * 7 + sk) % 200) AS DOUBLE) END"
UPC = "CASE WHEN pk % 5 <> 0 THEN lpad(CAST(pk AS STRING), 12, '0') END"
COMPARE_AT = "CASE WHEN (pk + sk) % 3 = 0 THEN CAST(1000 + (pk * 13 + sk * 7) % 9500 AS INT) END"

# Nutrition candidates: macros by the part key, then seeded rule violations, first match wins.
HAS_NUTRITION = "pk % 4 <> 0"
SERVING_SIZE_G = "CAST(25 + pk % 20 AS DOUBLE)"
SERVINGS = "CASE WHEN pk % 37 <> 0 AND pk % 31 <> 0 AND pk % 29 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(10 + pk % 60 AS DOUBLE) END"
PROTEIN_G = (
    "CASE WHEN pk % 37 = 0 THEN CAST(NULL AS DOUBLE) "
    "WHEN pk % 31 <> 0 AND pk % 29 <> 0 AND pk % 23 = 0 THEN CAST(60 AS DOUBLE) "
    "ELSE CAST(18 + pk % 8 AS DOUBLE) END"
)
FAT_G = (
    "CASE WHEN pk % 37 <> 0 AND pk % 31 = 0 THEN CAST(-1 AS DOUBLE) "
    "ELSE CAST(1 AS DOUBLE) + CAST(pk % 5 AS DOUBLE) / CAST(2 AS DOUBLE) END"
)
CARB_G = "CAST(2 + pk % 6 AS DOUBLE)"
SUGAR_G = "CAST(1 + pk % 3 AS DOUBLE)"
CALORIES = (
    "CAST(4 * (18 + pk % 8) + 4 * (2 + pk % 6) + 9 + 10 * (pk % 9) AS DOUBLE) "
    "+ CAST(9 * (pk % 5) AS DOUBLE) / CAST(2 AS DOUBLE)"
)
METHOD = (
    "CASE pk % 3 WHEN 0 THEN 'html_parse' WHEN 1 THEN 'shopify_json' ELSE 'open_food_facts' END"
)
NUTRITION = {
    "serving_size_g": SERVING_SIZE_G,
    "servings_per_container": SERVINGS,
    "protein_g": PROTEIN_G,
    "fat_g": FAT_G,
    "carb_g": CARB_G,
    "sugar_g": SUGAR_G,
    "calories_kcal": CALORIES,
    "extraction_method": METHOD,
}

HAS_INGREDIENTS = "pk % 6 <> 0"
INGREDIENTS = (
    "'Whey Protein Isolate'"
    " || CASE WHEN pk % 2 = 0 THEN ', Soy Lecithin' ELSE '' END"
    " || CASE WHEN pk % 3 = 0 THEN ', Sucralose' ELSE '' END"
    " || CASE WHEN pk % 5 = 0 THEN ', Stevia Leaf Extract' ELSE '' END"
    " || CASE WHEN pk % 7 = 0 THEN ', Organic Cocoa' ELSE '' END"
)
LABEL_TEXT = (
    "CASE WHEN pk % 11 = 0 THEN 'Vegan Keto ' ELSE '' END"
    " || CASE WHEN pk % 13 = 0 THEN 'Gluten-Free' ELSE '' END"
)

# Retailer wording of a variant: brand spelling, core words, flavor words and a size token.
TITLE_BRAND = (
    "CASE pk % 6 WHEN 0 THEN 'ON' WHEN 1 THEN 'Optimum Nutrition' WHEN 2 THEN 'Ghost' "
    "WHEN 3 THEN 'Dymatize' WHEN 4 THEN 'B.P.N' ELSE 'Naked & Co' END"
)
TITLE_CORE = (
    "CASE pk % 5 WHEN 0 THEN 'Gold Standard 100% Whey Protein Powder' "
    "WHEN 1 THEN 'ISO100 Whey Isolate Protein' WHEN 2 THEN 'Elite Casein' "
    "WHEN 3 THEN 'Vegan Plant Protein Blend' ELSE 'Collagen Peptides Café' END"
)
TITLE_FLAVOR = (
    "CASE sk % 5 WHEN 0 THEN ' - Double Rich Chocolate' WHEN 1 THEN ', Vanilla Ice Cream' "
    "WHEN 2 THEN ' Cookies & Cream' WHEN 3 THEN ' Protein Bar' ELSE '' END"
)
TITLE_SIZE = (
    "CASE (pk + sk) % 13 WHEN 0 THEN ', 5 lb' WHEN 1 THEN ' 2.27kg' WHEN 2 THEN ' 32oz' "
    "WHEN 3 THEN ' (907 g)' WHEN 4 THEN ' 1,5 kg tub' WHEN 5 THEN ' 1.6 lb / 5 lb' "
    "WHEN 6 THEN ', 30g per scoop' WHEN 7 THEN ' 12 Ounces (Pack of 2)' "
    "WHEN 8 THEN ' 30 servings' WHEN 9 THEN ' 25g protein 2 pounds 40 Servings' "
    "WHEN 10 THEN ' 2-Pack 450 grams' WHEN 11 THEN ' 750gr' ELSE '' END"
)
TITLE = f"({TITLE_BRAND}) || ' ' || ({TITLE_CORE}) || ({TITLE_FLAVOR}) || ({TITLE_SIZE})"
PRICE_TEXT = (
    "CASE WHEN pk % 17 = 0 THEN '' WHEN pk % 19 = 0 THEN 'call us' "
    "ELSE '$' || CAST(10 + pk % 90 AS STRING) || '.' || lpad(CAST((pk * 7 + sk) % 100 AS STRING), 2, '0') END"
)
FLAVOR_TEXT = (
    "CASE (pk + sk) % 6 WHEN 0 THEN 'Default Title' WHEN 1 THEN '  Double  Rich   Chocolate ' "
    "WHEN 2 THEN 'N/A' WHEN 3 THEN 'Vanilla' WHEN 4 THEN '' ELSE 'Café Latte' END"
)

# A facts sentence that is appended to real page and document text by row id ``n``.
FACTS_TEXT = (
    "' Serving Size: 1 Scoop (' || CAST(25 + n % 20 AS STRING) || ' g) Servings Per Container '"
    " || CAST(10 + n % 40 AS STRING) || ' Calories ' || CAST(90 + n % 60 AS STRING)"
    " || ' Total Fat ' || CAST(n % 5 AS STRING) || '.5g Total Carbohydrate ' || CAST(n % 9 AS STRING)"
    " || 'g Total Sugars ' || CAST(n % 4 AS STRING) || 'g '"
    " || CASE WHEN n % 3 = 0 THEN 'Protein ' || CAST(20 + n % 8 AS STRING) || 'g'"
    " WHEN n % 3 = 1 THEN 'with ' || CAST(20 + n % 8 AS STRING) || 'g of pure whey protein' ELSE '' END"
)
INGREDIENT_TEXT = (
    "' Ingredients: ' || CASE n % 4 WHEN 0 THEN 'Whey Protein Isolate, Cocoa, Sucralose'"
    " WHEN 1 THEN 'Pea Protein, Soy Lecithin, Monk Fruit, Almond' WHEN 2 THEN 'Maltodextrin, Veggie Mix'"
    " ELSE 'Egg White' END || '. Directions: mix. '"
    " || CASE WHEN n % 5 = 0 THEN 'Certified Gluten Free and Non-GMO' ELSE 'No sugar added' END"
)

# ---- Landed payloads. ``pk``/``sk`` as above; ``j`` is the variant position inside a feed product.
MONEY = "CAST({a} AS STRING) || '.' || lpad(CAST({b} AS STRING), 2, '0')"

FEED = {
    "handle": "CASE WHEN pk % 23 <> 0 THEN 'item-' || CAST(pk AS STRING) || '-' || CAST(sk AS STRING) END",
    "title": TITLE,
    "vendor": f"CASE WHEN pk % 4 = 0 THEN '' ELSE {TITLE_BRAND} END",
    "product_type": "CASE pk % 3 WHEN 0 THEN 'Protein Powder' WHEN 1 THEN 'Shaker' ELSE 'Supplements' END",
    "tag_a": "CASE pk % 4 WHEN 0 THEN 'keto' WHEN 1 THEN 'Gluten-Free' WHEN 2 THEN 'casein' ELSE 'new' END",
    "tag_b": "CASE sk % 3 WHEN 0 THEN 'vegan' ELSE 'sale' END",
    "tag_style": "pk % 2",
    "layout": "pk % 3",
}
FEED_BODY = (
    "CASE WHEN n % 6 = 0 THEN '' ELSE '<p>Great&nbsp;taste' || (" + FACTS_TEXT + ") || '</p><div>'"
    " || (" + INGREDIENT_TEXT + ") || '</div>' END"
)
FEED_VARIANT = {
    "vid": "(pk * 1000 + sk) * 10 + j",
    "flavor_opt": "CASE WHEN j = 0 THEN 'Chocolate' ELSE ' Vanilla  Bean ' END",
    "size_opt": "CASE (pk + j) % 4 WHEN 0 THEN '2 lb' WHEN 1 THEN '907 g' WHEN 2 THEN '30 servings' ELSE 'Large' END",
    "price": (
        "CASE WHEN (pk + j) % 13 = 0 THEN '0.00' WHEN (pk + j) % 11 = 0 THEN CAST(NULL AS STRING) ELSE "
        + MONEY.format(a="20 + (pk + sk + j) % 50", b="(pk * 7) % 100") + " END"
    ),
    "compare_at": "CASE WHEN pk % 4 <> 0 THEN CAST(30 + (pk * 3 + j) % 50 AS STRING) || '.50' END",
    "available": "CASE WHEN pk % 7 <> 0 THEN (pk + j) % 5 <> 0 END",
    "grams": "CASE WHEN pk % 3 = 0 THEN 0 ELSE CAST(500 + (pk % 10) * 50 AS INT) END",
}

AFFILIATE = {
    "item_id": "pk * 100000 + sk",
    "name": TITLE,
    "brand": f"CASE WHEN pk % 9 = 0 THEN CAST(NULL AS STRING) ELSE {TITLE_BRAND} END",
    "sale_price": (
        "CASE WHEN pk % 19 = 0 THEN CAST(NULL AS DOUBLE) WHEN pk % 29 = 0 THEN CAST(0 AS DOUBLE) "
        "ELSE CAST(2000 + (pk * 37 + sk * 11) % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) END"
    ),
    "msrp": (
        "CASE WHEN pk % 4 <> 0 THEN CAST(2500 + (pk * 41) % 6000 AS DOUBLE) / CAST(100 AS DOUBLE) END"
    ),
    "upc": UPC,
    "category": (
        "CASE pk % 3 WHEN 0 THEN 'Health/Protein Powder' WHEN 1 THEN 'Grocery/Snack' "
        "ELSE 'Sports/Supplements' END"
    ),
    "online": "CASE WHEN pk % 8 <> 0 THEN pk % 6 <> 0 END",
    "stock": (
        "CASE pk % 5 WHEN 0 THEN 'Not available' WHEN 1 THEN 'Limited' WHEN 2 THEN CAST(NULL AS STRING) "
        "ELSE 'Available' END"
    ),
    "short_text": "CASE WHEN n % 7 = 0 THEN '' ELSE " + INGREDIENT_TEXT + " END",
    "long_text": "CASE pk % 3 WHEN 0 THEN 'Keto friendly, grass-fed' WHEN 1 THEN 'Kosher' ELSE '' END",
}

MARKETPLACE = {
    "asin": "CASE WHEN pk % 31 = 0 THEN '' ELSE 'A' || CAST(pk AS STRING) END",
    "title": TITLE,
    "price": PRICE_TEXT,
    "original": (
        "CASE WHEN pk % 4 <> 0 THEN '$' || " + MONEY.format(a="15 + (pk * 3) % 95", b="(sk * 3) % 100") + " END"
    ),
    "url": "CASE WHEN pk % 3 = 0 THEN '' ELSE 'https://m.example/s/' || CAST(pk AS STRING) END",
}
MARKETPLACE_HAS_DETAIL = "pk % 5 <> 0"
MARKETPLACE_DETAIL = {
    "d_title": f"CASE WHEN pk % 2 = 0 THEN '' ELSE {TITLE} || ' (Whey)' END",
    "d_price": "'$' || " + MONEY.format(a="11 + (pk + sk) % 80", b="(pk * 3) % 100"),
    "d_original": "'$' || " + MONEY.format(a="40 + (pk * 7) % 60", b="99"),
    "d_url": "CASE WHEN pk % 4 = 1 THEN 'https://m.example/d/' || CAST(pk AS STRING) END",
    "byline": (
        "CASE pk % 4 WHEN 0 THEN 'Visit the Dymatize Store' WHEN 1 THEN 'Brand: Naked Whey' "
        "WHEN 2 THEN '' ELSE CAST(NULL AS STRING) END"
    ),
    "availability": (
        "CASE pk % 6 WHEN 0 THEN 'Currently unavailable.' WHEN 1 THEN 'Temporarily out of stock' "
        "WHEN 2 THEN CAST(NULL AS STRING) ELSE 'In Stock' END"
    ),
    "description": "CASE WHEN n % 3 = 0 THEN '' ELSE " + INGREDIENT_TEXT + " END",
    "about": "'About ' || CAST(pk AS STRING) || CASE WHEN n % 3 = 0 THEN '. Ingredients: Casein, Xylitol, Egg. Enjoy' ELSE '' END",
    "i_brand": "CASE WHEN pk % 7 = 0 THEN ' NOW Sports ' END",
    "i_brand_name": "CASE WHEN pk % 7 = 1 THEN 'Optimum Nutrition' WHEN pk % 7 = 2 THEN '' END",
    "i_maker": "CASE WHEN pk % 2 = 0 THEN 'Glanbia' END",
    "i_weight": "CASE pk % 4 WHEN 0 THEN '2.5 Pounds' WHEN 1 THEN 'heavy' END",
    "i_diet": "CASE pk % 3 WHEN 0 THEN 'Vegan, Gluten Free,' WHEN 1 THEN 'Keto' END",
    "i_allergen": "CASE pk % 6 WHEN 0 THEN ' Contains Milk and Soy ' WHEN 1 THEN ' ' END",
    "i_ingredients": "CASE WHEN pk % 8 = 0 THEN 'Whey, Sucralose' END",
    "i_protein": "CASE pk % 4 WHEN 0 THEN '24 Grams' WHEN 1 THEN 'n/a' WHEN 2 THEN '22.5 g' END",
    "i_total_servings": "CASE pk % 5 WHEN 1 THEN '29' WHEN 2 THEN 'unknown' END",
    "i_servings": "CASE pk % 5 WHEN 2 THEN '40 servings' WHEN 3 THEN '30' END",
    "i_serving_size": "CASE WHEN pk % 2 = 0 THEN '32 g' END",
    "i_fat": "CASE WHEN pk % 3 = 0 THEN '1.5 g' END",
    "i_carb": "CASE WHEN pk % 3 = 1 THEN '4 Grams' END",
    "i_upc": "CASE pk % 3 WHEN 0 THEN lpad(CAST(pk AS STRING), 13, '7') WHEN 1 THEN 'none' END",
    "x_gtin": "CASE WHEN pk % 4 <> 3 THEN 'code ' || lpad(CAST(pk AS STRING), 12, '8') || ' ok' END",
}

GROCER = {
    "product_code": "CASE WHEN pk % 37 = 0 THEN '' WHEN pk % 11 = 0 THEN 'K' || CAST(pk AS STRING) ELSE lpad(CAST(pk AS STRING), 13, '0') END",
    "brand": f"CASE WHEN pk % 9 = 0 THEN ' ' ELSE {TITLE_BRAND} END",
    "name": TITLE,
    "cat_a": "CASE pk % 3 WHEN 0 THEN 'Protein' WHEN 1 THEN 'Natural & Organic' ELSE 'Bars' END",
    "has_items": "pk % 41 <> 0",
    "first_regular": "CASE WHEN pk % 3 <> 0 THEN CAST(1500 + (pk * 13 + sk) % 4000 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "first_promo": (
        "CASE pk % 4 WHEN 0 THEN CAST(1200 + (pk * 13) % 4000 AS DOUBLE) / CAST(100 AS DOUBLE) "
        "WHEN 1 THEN CAST(0 AS DOUBLE) END"
    ),
    "first_size": "CASE WHEN pk % 5 = 0 THEN CAST(NULL AS STRING) ELSE '2 lb' END",
    "first_stock": (
        "CASE pk % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'temporarily_out_of_stock' "
        "WHEN 2 THEN CAST(NULL AS STRING) ELSE 'LOW' END"
    ),
    "second_regular": "CASE WHEN pk % 2 = 0 THEN CAST(2000 + pk % 900 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "allergen_name": "CASE pk % 3 WHEN 0 THEN 'Milk' WHEN 1 THEN 'Tree Nut' ELSE 'Soybean' END",
    "allergen_level": "CASE sk % 3 WHEN 0 THEN 'Contains' WHEN 1 THEN 'May Contain' ELSE 'Derived From' END",
    "declaration": "CASE pk % 4 WHEN 0 THEN 'Gluten Free' WHEN 1 THEN 'Kosher' WHEN 2 THEN 'Vegetarian' ELSE '' END",
    "gmo": "CASE WHEN pk % 5 = 0 THEN 'Non-GMO Project' END",
    "organic": "CASE WHEN pk % 7 = 0 THEN 'USDA Organic' END",
}

AUCTION = {
    "item_id": "CASE WHEN pk % 43 = 0 THEN '' ELSE 'v1|' || CAST(pk AS STRING) || '-' || CAST(sk AS STRING) || '|0' END",
    "title": TITLE,
    "brand": f"CASE WHEN pk % 3 = 0 THEN CAST(NULL AS STRING) ELSE ' ' || {TITLE_BRAND} END",
    "price": "CASE WHEN pk % 17 = 0 THEN CAST(NULL AS STRING) ELSE " + MONEY.format(a="20 + (pk + sk) % 60", b="(pk * 3) % 100") + " END",
    "currency": "CASE pk % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' ELSE CAST(NULL AS STRING) END",
    "original": "CASE WHEN pk % 2 = 0 THEN " + MONEY.format(a="25 + (pk * 3) % 60", b="(sk * 3) % 100") + " END",
    "url": "CASE WHEN pk % 3 <> 0 THEN 'https://a.example/i/' || CAST(pk AS STRING) END",
    "feedback": "CASE pk % 5 WHEN 0 THEN '80.5' WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN '95.0' ELSE '99.8' END",
    "gtin": "CASE pk % 4 WHEN 0 THEN lpad(CAST(pk AS STRING), 13, '0') WHEN 1 THEN 'Does Not Apply' END",
    "aspect_name": "CASE sk % 4 WHEN 0 THEN 'UPC' WHEN 1 THEN 'ean' WHEN 2 THEN 'Color' ELSE 'GTIN' END",
    "aspect_value": "CASE pk % 3 WHEN 0 THEN ' ' || lpad(CAST(pk AS STRING), 12, '9') || ' ' WHEN 1 THEN '12345' ELSE 'none' END",
}
AUCTION_HAS_ITEM = "pk % 7 <> 0"

PAGE = {
    "sku": "CASE WHEN pk % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'S' || CAST(pk AS STRING) || '-' || CAST(sk AS STRING) END",
    "product_code": "CASE WHEN pk % 10 = 0 THEN 'P' || CAST(pk AS STRING) END",
    "name": TITLE,
    "brand": TITLE_BRAND,
    "brand_style": "pk % 3",
    "category": "CASE WHEN pk % 2 = 0 THEN 'Plant Protein' END",
    "price": "CASE WHEN pk % 13 = 0 THEN CAST(NULL AS STRING) ELSE " + MONEY.format(a="20 + (pk * 3 + sk) % 60", b="(pk * 9) % 100") + " END",
    "low_price": "CASE WHEN pk % 26 = 0 THEN '19.95' END",
    "offer_style": "pk % 4",
    "currency": "CASE WHEN pk % 6 <> 0 THEN 'EUR' END",
    "availability": "CASE pk % 3 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'https://schema.org/OutOfStock' END",
    "description": "CASE WHEN n % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'Tasty.' || (" + FACTS_TEXT + ") END",
    "wrap_style": "sk % 3",
}

# Barcode database, one row per coded part.
BARCODE_FOUND = "pk % 7 <> 0"
BARCODE = {
    "serving_quantity": "CASE WHEN pk % 3 = 0 THEN CAST(0 AS DOUBLE) WHEN pk % 3 = 1 THEN CAST(25 + pk % 15 AS DOUBLE) END",
    "serving_size": "CASE WHEN pk % 2 = 0 THEN '1 scoop (30 g)' ELSE 'one scoop' END",
    "product_quantity": "CASE WHEN pk % 4 = 0 THEN CAST(907 + pk % 100 AS DOUBLE) END",
    "ingredients_text": "CASE WHEN pk % 3 = 0 THEN '' ELSE " + INGREDIENTS + " END",
    "ingredients_text_en": "CASE WHEN pk % 6 = 0 THEN 'Pea Protein, Xylitol' END",
    "allergen_tag": "CASE pk % 4 WHEN 0 THEN 'en:soybeans' WHEN 1 THEN 'en:nuts' WHEN 2 THEN 'en:celery' ELSE 'fr:lait:milk' END",
    "label_tag": "CASE pk % 3 WHEN 0 THEN 'en:no-gluten' WHEN 1 THEN 'en:fair-trade' ELSE 'en:vegan' END",
    "protein_serving": "CASE WHEN pk % 2 = 0 THEN CAST(2000 + (pk * 7) % 900 AS DOUBLE) / CAST(96 AS DOUBLE) END",
    "protein_100g": "CASE WHEN pk % 5 <> 1 THEN CAST(60 + pk % 25 AS DOUBLE) END",
    "fat_100g": "CAST(3 + pk % 5 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(4 AS DOUBLE)",
    "carb_100g": "CASE WHEN pk % 3 <> 1 THEN CAST(4 + pk % 9 AS DOUBLE) END",
    "sugar_serving": "CAST(pk % 4 AS DOUBLE)",
    "kcal_100g": "CAST(350 + pk % 60 AS DOUBLE)",
}
