"""Word lists, lookup tables and constants that define the results.

Everything in this file must equal the published vocabulary for results to be
right; the logic that uses it lives elsewhere.
"""

# Grams per unit.
GRAMS_PER_LB = 453.59237
GRAMS_PER_OZ = 28.349523125
GRAMS_PER_KG = 1000.0
GRAMS_PER_G = 1.0

# Unit spellings, longest first within a family.
KG_UNITS = ["kilograms", "kilogram", "kgs", "kg"]
LB_UNITS = ["pounds", "pound", "lbs", "lb"]
OZ_UNITS = ["ounces", "ounce", "oz"]
G_UNITS = ["grams", "gram", "gr", "g"]

# Fixed value: gram tokens below this are serving claims, not a container.
MIN_CONTAINER_G = 300.0

# Option labels that mean "no flavor".
NO_FLAVOR = ["default title", "default", "n/a", ""]

# Market -> currency, market -> storefront domain.
MARKET_CURRENCY = {"US": "USD", "UK": "GBP", "IN": "INR"}
DEFAULT_CURRENCY = "USD"
MARKETPLACE_DOMAIN = {"US": "amazon.com", "UK": "amazon.co.uk", "IN": "amazon.in"}
DEFAULT_MARKETPLACE_DOMAIN = "amazon.com"

# Enums.
SOURCE_TYPES = ["shopify", "jsonld", "walmart", "amazon", "kroger", "ebay"]
MARKETS = ["US", "UK", "IN"]
EXTRACTION_METHODS = ["shopify_json", "json_ld", "html_parse", "llm", "manual", "open_food_facts"]
ISSUE_STAGES = ["fetch", "extract", "normalize", "validate", "upsert"]
ISSUE_SEVERITIES = ["warning", "error"]

# Brand abbreviation -> full brand.
BRAND_ALIASES = {
    "on": "optimum nutrition",
    "bpn": "bare performance nutrition",
    "ghost": "ghost lifestyle",
    "raw": "raw nutrition",
    "mts": "mts nutrition",
}

# Flavor words dropped from a product's core name.
FLAVOR_WORDS = [
    "chocolate", "vanilla", "strawberry", "banana", "cookies", "cream", "cookie", "dough", "peanut", "butter",
    "caramel", "mocha", "coffee", "latte", "mint", "birthday", "cake", "unflavored", "unflavoured", "natural",
    "fruity", "fruit", "cinnamon", "salted", "coconut", "mango", "berry", "blueberry", "raspberry", "lemon",
    "lemonade", "orange", "smores", "marshmallow", "hazelnut", "pumpkin", "spice", "chip", "chips", "fudge",
    "brownie", "milk", "dark", "white", "rich", "double", "gourmet", "vanilla bean", "punch", "icy", "blue",
    "green", "apple", "watermelon", "grape", "cherry", "tropical", "honey", "maple", "horchata",
    "snickerdoodle", "frosted", "glazed", "donut", "toffee", "pina", "colada", "flavor", "flavored", "flavour",
    "flavoured", "naturally", "ice", "iced", "sea", "salt", "roasted", "creamy", "smooth",
]

# Marketing words dropped from a product's core name.
NOISE_WORDS = [
    "protein", "powder", "the", "with", "and", "premium", "grass", "fed", "grassfed", "pure", "100", "new",
    "improved", "value", "size", "pack", "tub", "bag", "bottle", "jug", "supplement",
]

# Units that mark a size or a count inside a product name.
NAME_SIZE_UNITS = (
    "lbs?|pounds?|kgs?|kilograms?|oz|ounces?|g|grams?|servings?|serving|count|ct|packets?|sticks?"
)

# Category keywords, most specific first.
CATEGORY_KEYWORDS = [
    ("collagen", "collagen"),
    ("casein", "casein"),
    ("vegan", "plant"),
    ("plant", "plant"),
    ("pea protein", "plant"),
    ("soy", "plant"),
    ("isolate", "isolate"),
    ("concentrate", "concentrate"),
    ("whey", "whey"),
    ("blend", "blend"),
]

# Dietary label -> phrases.
DIETARY = {
    "vegan": ["vegan"],
    "vegetarian": ["vegetarian"],
    "gluten_free": ["gluten free", "gluten-free", "certified gluten", "no gluten"],
    "kosher": ["kosher"],
    "halal": ["halal"],
    "organic": ["organic"],
    "non_gmo": ["non-gmo", "non gmo", "no gmo", "gmo free", "gmo-free"],
    "keto": ["keto", "ketogenic"],
    "dairy_free": ["dairy free", "dairy-free", "no dairy"],
    "sugar_free": ["sugar free", "sugar-free", "no sugar added", "zero sugar"],
    "soy_free": ["soy free", "soy-free", "no soy"],
    "grass_fed": ["grass fed", "grass-fed"],
}

# Allergen -> ingredient words.
ALLERGENS = {
    "milk": ["milk", "whey", "casein", "caseinate", "lactose", "dairy"],
    "soy": ["soy", "soya", "soybean"],
    "gluten": ["gluten", "wheat", "barley", "rye", "malt"],
    "egg": ["egg", "albumen"],
    "tree_nuts": ["almond", "cashew", "walnut", "pecan", "hazelnut", "pistachio", "tree nut"],
    "peanut": ["peanut"],
    "fish": ["fish", "cod", "tuna"],
    "shellfish": ["shellfish", "shrimp", "crab", "lobster", "crustacean"],
    "sesame": ["sesame"],
}

# Sweetener -> ingredient words.
SWEETENERS = {
    "stevia": ["stevia", "rebaudioside", "reb a", "steviol", "reb-a"],
    "monk_fruit": ["monk fruit", "monkfruit", "luo han guo"],
    "erythritol": ["erythritol"],
    "xylitol": ["xylitol"],
    "allulose": ["allulose"],
    "sucralose": ["sucralose"],
    "aspartame": ["aspartame"],
    "acesulfame_k": ["acesulfame", "ace-k", "ace k", "acesulfame potassium"],
    "saccharin": ["saccharin"],
    "sugar": ["cane sugar", "organic sugar", "sucrose", "dextrose", "fructose"],
}
ARTIFICIAL_SWEETENERS = ["sucralose", "aspartame", "acesulfame_k", "saccharin"]

# Barcode-database tag leaf -> our tag.
BARCODE_ALLERGEN_TAGS = {
    "milk": "milk",
    "soybeans": "soy",
    "soy": "soy",
    "gluten": "gluten",
    "eggs": "egg",
    "egg": "egg",
    "nuts": "tree_nuts",
    "tree-nuts": "tree_nuts",
    "peanuts": "peanut",
    "fish": "fish",
    "crustaceans": "shellfish",
    "molluscs": "shellfish",
    "sesame-seeds": "sesame",
    "sesame": "sesame",
}
BARCODE_LABEL_TAGS = {
    "vegan": "vegan",
    "vegetarian": "vegetarian",
    "gluten-free": "gluten_free",
    "no-gluten": "gluten_free",
    "organic": "organic",
    "eu-organic": "organic",
    "usda-organic": "organic",
    "kosher": "kosher",
    "halal": "halal",
    "non-gmo": "non_gmo",
    "no-gmos": "non_gmo",
    "keto": "keto",
    "dairy-free": "dairy_free",
}

# Words that decide whether a listing is a protein powder.
POWDER_WORD = "protein"
FEED_EXCLUDE = [
    "bar", "rtd", "ready to drink", "shaker", "bottle", "t-shirt", "shirt", "hoodie", "gift card",
    "capsule", "tablet", "pill", "sample", "bundle",
]
AFFILIATE_EXCLUDE = [
    "bar", "ready to drink", "rtd", "shake", "drink", "snack", "cookie", "capsule", "tablet",
    "clif", "water", "coffee creamer",
]
MARKETPLACE_EXCLUDE = [
    "bar", "ready to drink", "rtd", "shake", "drink", "snack", "cookie", "capsule", "tablet",
    "clif", "water", "creamer", "sample",
]
GROCER_EXCLUDE = [
    "bar", "ready to drink", "rtd", "shake", "drink", "snack", "cookie", "capsule", "tablet",
    "clif", "water", "creamer",
]
AUCTION_EXCLUDE = [
    "bar", "ready to drink", "rtd", "shake", "drink", "snack", "cookie", "capsule", "tablet",
    "clif", "water", "creamer", "sample", "empty", "lot", "expired", "tub only", "container only",
]
MIN_SELLER_FEEDBACK = 95.0

# Feed option names that hold the flavor or the size.
FLAVOR_OPTIONS = ["flavor", "flavour", "taste"]
SIZE_OPTIONS = ["size", "weight", "servings", "container", "count", "bag size", "amount"]

# Grocer stock levels that mean out of stock; declared containment levels.
GROCER_OUT_OF_STOCK = ["TEMPORARILY_OUT_OF_STOCK", "OUT_OF_STOCK"]
GROCER_CONTAINMENT = ["Contains", "Derived From"]

# Words in an attribute name that mark a barcode.
BARCODE_ATTRIBUTES = ["upc", "ean", "gtin"]

# Validation thresholds and confidence by extraction method.
CONFIDENCE_BY_METHOD = {
    "manual": 1.0,
    "shopify_json": 0.9,
    "json_ld": 0.9,
    "html_parse": 0.7,
    "llm": 0.6,
}
DEFAULT_CONFIDENCE = 0.5
WARNING_PENALTY = 0.15
SERVING_SIZE_MIN_G, SERVING_SIZE_MAX_G = 5.0, 250.0
SERVINGS_MIN, SERVINGS_MAX = 1.0, 400.0
MIN_SERVINGS = 2.0
MAX_IMPLIED_SERVING_G = 200.0
CALORIE_TOLERANCE = 0.30
CONTAINER_TOLERANCE = 0.25
