import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import enrich, grouping, metrics, quality, ranking, resolve, upserts
from larder.operators.filters import FilterSpec
from larder.sources import feeds, retailers

T = dt.datetime


def validate(spark, **values):
    base = dict(serving_size_g=30.0, servings_per_container=30.0, protein_g=24.0, fat_g=1.0, carb_g=3.0,
                calories_kcal=117.0, extraction_method="html_parse", size_g=900.0)
    base.update(values)
    schema = ", ".join(f"{k} {'string' if k == 'extraction_method' else 'double'}" for k in base)
    return quality.validate_nutrition(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_validation_rules(spark):
    clean = validate(spark)
    assert clean.ok and clean.confidence == 0.7 and clean.warnings == []
    assert validate(spark, extraction_method="open_food_facts").confidence == 0.5
    assert validate(spark, protein_g=None).errors == ["missing_required"]
    assert "negative_fat_g" in validate(spark, fat_g=-1.0).errors
    assert "protein_exceeds_serving" in validate(spark, protein_g=40.0).errors
    low = validate(spark, servings_per_container=0.5)
    assert "servings_below_min" in low.errors and "servings_range" in low.warnings and low.confidence == 0.0
    assert "implied_serving_too_big" in validate(spark, servings_per_container=4.0).errors
    two = validate(spark, calories_kcal=300.0, size_g=3000.0)
    assert two.warnings == ["calories_disagree", "container_disagrees"] and two.confidence == 0.4
    assert validate(spark, size_g=None, serving_size_g=None).ok


def test_latest_price_breaks_ties(spark):
    rows = [("a", 100, T(2024, 1, 1), 1), ("a", 90, T(2024, 1, 1), 2), ("b", 70, T(2023, 1, 1), 1)]
    df = spark.createDataFrame(rows, "variant_id string, price_cents int, captured_at timestamp_ntz, seq int")
    assert {r.variant_id: r.price_cents for r in metrics.latest_price(df).collect()} == {"a": 90, "b": 70}


def test_upsert_policies_and_replay(spark):
    policy = upserts.UpsertPolicy(("k",), ("v",), ("kind",), ("seen",), ("born",))
    old = spark.createDataFrame([("a", "x", "t1", 5, 5), ("b", "y", "t2", 5, 5)], "k string, v string, kind string, seen int, born int")
    new = spark.createDataFrame(
        [("a", None, "t9", 4, 4, 2), ("a", "z", "t8", 3, 3, 1), ("c", "n", "t3", 9, 9, 1)],
        "k string, v string, kind string, seen int, born int, seq int")
    once = upserts.upsert(old, new, policy)
    got = {r.k: (r.v, r.kind, r.seen, r.born) for r in once.collect()}
    assert got == {"a": (None, "t1", 5, 3), "b": ("y", "t2", 5, 5), "c": ("n", "t3", 9, 9)}
    twice = upserts.upsert(once, new, policy)
    assert sorted(map(tuple, twice.select(*once.columns).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_global_and_group_rank_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), rng.randrange(20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    order = [F.col("v").desc(), F.col("id").asc()]
    ranked = {r.id: r["rank"] for r in ranking.global_rank(df, order).collect()}
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert ranked == want
    placed = {r.id: r.pos for r in ranking.rank_within(df, ["g"], order).collect()}
    seen, expect = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        expect[i] = seen[g]
    assert placed == expect


def test_best_offer_counts_only_matching_rows(spark):
    rows = [("p", "s1", "v1", 200, 3.0), ("p", "s1", "v2", 100, 5.0), ("p", "s2", "v3", 90, 5.0), ("q", "s1", "v4", 10, 1.0)]
    df = spark.createDataFrame(rows, "product_id string, source_slug string, variant_id string, price_cents int, protein_per_dollar double")
    got = {r.product_id: (r.variant_id, r.retailer_count, r.offer_count) for r in grouping.best_offer_per_product(df, FilterSpec()).collect()}
    assert got == {"p": ("v3", 2, 3), "q": ("v4", 1, 1)}


def test_lookup_shapes_and_first_seen(spark):
    item = '{"itemId":7,"name":"Whey protein","salePrice":10.0}'
    df = spark.createDataFrame([(1, '{"items":[' + item + "]}"), (2, item), (3, '{"items":[]}'), (4, "{}")], "n int, payload string")
    assert sorted(r.n for r in feeds.unwrap_lookup(df).collect()) == [1, 2]


def page(spark, body):
    rows = [(1, "s", "Shop", "https://s.example", "US", "https://s.example/p", f'<html><body><script type="application/ld+json">{body}</script>1</body></html>')]
    return spark.createDataFrame(rows, "source_id int, source_slug string, source_name string, base_url string, market string, url string, html string")


def test_json_ld_shapes(spark):
    node = '{"@type":"Product","name":"Whey 2 lb","brand":"B","offers":%s}'
    for body, cents in [
        (node % '{"price":"54.99"}', 5499), ("[" + node % '[{"lowPrice":12.5}]' + "]", 1250),
        ('{"@graph":[' + node % '{"price":0,"lowPrice":"9.00"}' + "]}", 900), ("{broken", None), (node % "null", None),
    ]:
        got = [r.price_cents for r in retailers.normalize_pages(page(spark, body)).collect()]
        assert got == ([cents] if cents else [])


def test_enrichment_batch_is_ordered(spark):
    df = spark.createDataFrame([(f"v{i:03d}", "1", 1.0) for i in range(50)], "variant_id string, upc string, size_g double")
    assert [r.variant_id for r in enrich.next_batch(df.repartition(5), 3).collect()] == ["v000", "v001", "v002"]


SHOP = "source_id int, source_slug string, source_name string, base_url string, market string, pk int, sk int, "


def test_third_option_names_the_size(spark):
    product = (
        '{"id":1,"title":"Whey protein","handle":"whey","vendor":"V","product_type":"","tags":"","body_html":"",'
        '"options":[{"name":"Pack","position":1},{"name":"Flavor","position":2},{"name":"Size","position":3}],'
        '"variants":[{"id":9,"title":"x","option1":"1","option2":"Mint","option3":"2 lb","price":"30.00","grams":100}]}'
    )
    rows = spark.createDataFrame([(1, "s", "S", "https://s.example", "US", 1, 1, product)], SHOP + "payload string")
    got = retailers.normalize_feed(rows).first()
    assert (got.size_label, got.flavor, round(got.size_g, 3)) == ("2 lb", "Mint", 907.185)


def test_details_stay_in_their_market_and_the_newest_counts(spark):
    items = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "source_id int, asin string")
    body = '{"data":{"product_title":"%s"}}'
    details = spark.createDataFrame(
        [(1, "A", body % "zz old", 1), (1, "A", body % "new", 2), (2, "A", body % "other", 1)],
        "source_id int, asin string, payload string, landed_at int")
    got = {r.source_id: r.d and r.d.product_title for r in retailers.join_details(items, details).collect()}
    assert got == {1: "new", 2: "other", 3: None}


def test_a_listing_has_one_product(spark):
    offers = spark.createDataFrame(
        [("l1", 0, None, "own"), ("l1", 1, "u9", "own2"), ("l1", 2, "u2", "own3"), ("l1", 3, "u1", "own4"),
         ("l2", 0, "u9", "aaa"), ("l3", 0, "", "solo"), (None, 0, None, "loose")],
        "listing_id string, position int, upc string, dedup_key string")
    known = spark.createDataFrame([("u1", "p1"), ("u2", "p2"), ("u2", "p3")], "upc string, product_key string")
    got = {(r.listing_id, r.position): (r.product_key, r.by_existing_upc) for r in resolve.resolve_products(offers, known).collect()}
    assert got == {
        **{("l1", k): ("p2", True) for k in range(4)}, ("l2", 0): ("aaa", False), ("l3", 0): ("solo", False), (None, 0): ("loose", False)}
