import pytest
from pyspark.sql import functions as F

from larder.functions import facets, identity, nutrition, units
from larder.functions.text import collapse_ws, exact_round, let, number, stage
from larder.sources.retailers import json_block


def apply(spark, values, column, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def test_exact_round_matches_python(spark):
    values = [2.675, 30.85, 2.45, 0.125, 2.25, 1234 / 40, 61.25, -2.675, 1e-7, 30.65]
    for digits in (1, 2, 3):
        got = apply(spark, values, lambda x: exact_round(x, digits), "double")
        assert got == [round(v, digits) for v in values]


def test_weights(spark):
    texts = ["4 lb", "1.5lbs", "2 Pounds", "900 g", "1,5 kg", "16OZ tub", "a scoop (31 g) of 2 lb",
             "7 gallons", "no weight", None, "12 gré"]
    got = apply(spark, texts, units.parse_weight_g)
    want = [1814.369, 680.389, 907.185, 900.0, 1500.0, 453.592, 31.0, None, None, None, None]
    assert got == want


def test_container_ignores_claims(spark):
    texts = ["High 28g Protein, 4 lb", "Plain 800 g", "24g per scoop", "2 lb / 4 lb", "250 g and 310 g", None]
    assert apply(spark, texts, units.parse_container_g) == [1814.369, 800.0, None, 1814.369, 310.0, None]


def test_multipack_servings_cents_flavor(spark):
    texts = ["Tub (Pack of 3)", "3-pack", "Twin Pack", "Case of 12", "bundles", "a bundle", "packs", None]
    assert apply(spark, texts, units.is_multipack) == [True, True, True, True, False, True, False, False]
    assert apply(spark, ["About 25 servings", "1 serving", "servings", None], units.parse_servings) == [25.0, 1.0, None, None]
    assert apply(spark, ["$39.95", "-5.00", "1.2.3", "", None, "1,299.00"], units.cents_from_text) == [3995, 500, None, None, None, 129900]
    assert apply(spark, ["Default Title", "  Mint   Chip ", "N/A", "", None], units.clean_flavor) == [None, "Mint Chip", None, None, None]


def test_identity(spark):
    pairs = [
        ("ON", "ON Gold Bar 100% Whey 2 lb Vanilla"),
        ("Optimum Nutrition", "Optimum Nutrition Gold Bar Whey - Chocolate, 5 lb"),
        ("Acme", "Acme Vanilla 2 lb"),
        ("Acme", "Acme Elite Casein"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b string, n string")
    keys = [r.k for r in df.select("i", identity.product_dedup_key(F.col("b"), F.col("n")).alias("k")).orderBy("i").collect()]
    assert keys[0] == keys[1] == "optimum-nutrition:gold-bar-whey"
    assert keys[2] == "acme:acme-vanilla-2-lb"
    assert keys[3] == "acme:elite-casein"


def test_substring_facets_are_kept_as_they_are(spark):
    assert apply(spark, ["maltodextrin", "veggie", "dairy free", "plain"], facets.scan_allergens) == [
        ["gluten"], ["egg"], ["milk"], []]
    assert apply(spark, ["certified gluten free, keto"], facets.scan_dietary) == [["gluten_free", "keto"]]


def test_ingredient_section(spark):
    texts = ["Nice. Ingredients: Rice Protein, Cocoa; Directions: mix", "Ingredients: water", "none", None,
             "INGREDIENT - A, B. Contains: milk"]
    assert apply(spark, texts, facets.extract_ingredients) == ["Rice Protein, Cocoa", None, None, None, "A, B"]


def test_derive_facts(spark):
    rows = [(0, "Whey, Sucralose", "Keto", None), (1, None, None, None), (2, "Whey, Soy", None, ["Tree Nut"])]
    df = spark.createDataFrame(rows, "i int, t string, l string, a array<string>")
    out = facets.add_facts(df, F.col("t"), F.col("l"), F.col("a")).orderBy("i").collect()
    assert out[0].facts.allergens == ["milk"] and out[0].facts.sweeteners == ["sucralose"]
    assert out[0].facts.dietary_labels == ["keto"]
    assert out[1].facts is None
    assert out[2].facts.allergens == ["tree_nuts"]


def test_nutrition_text(spark):
    text = ("Serving Size: 1 Scoop (32 g) Servings Per Container 28 Calories about 130 Total Fat 2.5g "
            "Total Carbs 4 g Sugars 1g Protein - 24g")
    df = spark.createDataFrame([(text,), ("gives 27g of pure whey protein",), ("tasty",)], "t string")
    fields = nutrition.parse_nutrition_text(F.col("t"))
    a, b, c = df.select(*[v.alias(k) for k, v in fields.items()]).collect()
    assert (a.serving_size_g, a.servings_per_container, a.calories_kcal) == (32.0, 28.0, 130.0)
    assert (a.fat_g, a.carb_g, a.sugar_g, a.protein_g) == (2.5, 4.0, 1.0, 24.0)
    assert b.protein_g == 27.0 and c.protein_g is None


@pytest.mark.parametrize("html,text", [
    ("<p>Café&nbsp;au&amp;lait</p><script>var a='</p>'</script><b>5&lt;6</b>", "Café au&lait 5<6"),
    ("<head><title>x</title></head><!-- gone --><div>a<br>b</div>", "a b"),
    (None, ""),
])
def test_html_to_text(spark, html, text):
    assert apply(spark, [html], nutrition.html_to_text) == [text]


SPACES = {*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def test_whitespace_is_these_characters(spark):
    codes = [c for c in [*range(1, 0x3100), 0xFEFF, 0xFFFD] if not 0xD800 <= c < 0xE000]
    got = apply(spark, [f"a{chr(c)}b" for c in codes], lambda x: collapse_ws(x) == "a b")
    assert {c for c, y in zip(codes, got, strict=True) if y} == SPACES


def test_numbers_and_blocks_that_are_none(spark):
    assert apply(spark, ["", "1.5", "x", None, "07"], number) == [None, 1.5, None, None, 7.0]
    # an empty text is no number by a comparison, not by a cast that fails
    plan = spark.createDataFrame([("",)], "x string").select(number(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "if" in plan.lower() and "try_cast" in plan.lower()
    blocks = ["{broken", ' { "a": 1 }', "{}", "{ }", "[1]", "", "5", "{'a':1}", None, '{"a"', '\n{\n"a":{b}}']
    parsed = [False, True, True, True, True, False, True, False, False, False, False]
    assert apply(spark, blocks, lambda x: json_block(x).isNotNull()) == parsed


def test_a_stage_carries_columns_only(spark):
    df = spark.createDataFrame([("2 lb",)], "x string")
    staged = stage(df, {"y": let(F.upper("x"), lambda v: F.concat(v, v))}).filter("y <> ''")
    lines = staged._jdf.queryExecution().executedPlan().toString().splitlines()
    generated = [line for line in lines if "Generate inline" in line]
    assert len(generated) == 1 and "lambda" not in generated[0] and "upper" not in generated[0]
    assert sum("transform(" in line for line in lines) == 1 and staged.first().y == "2 LB2 LB"
