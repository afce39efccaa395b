"""Ingestion runs over hand-made payloads: isolation per record, counts, replays, chained products."""

import json
import random
from collections import Counter, defaultdict

import pytest

from larder.operators import foreign_keys, ingest, metrics, quality
from larder.operators.components import connected
from larder.operators.ingest import COUNTERS, Ingestion
from larder.operators.resolve import resolve_chains
from larder.session import kept

SOURCES = "source_id int, slug string, name string, type string, market string, base_url string, enabled boolean"
LANDED = "source_id int, source_slug string, source_name string, base_url string, market string"
DETAIL = "struct<product_title:string,product_price:string,product_original_price:string,product_url:string,product_byline:string," \
    "product_availability:string,product_description:string,about_product:array<string>,product_information:map<string,string>," \
    "product_details:map<string,string>>"
KINDS = ["shopify", "walmart", "amazon", "kroger", "ebay", "jsonld"]


def sources(spark, extra=()):
    rows = [(i, f"s{i}", f"Shop {i}", kind, "US", f"https://s{i}.example", None) for i, kind in enumerate(KINDS)]
    return spark.createDataFrame(rows + [(9, "off", "Off", "shopify", "US", "https://off.example", False), *extra], SOURCES)


def owner(i, base="https://s.example"):
    return (i, f"s{i}", f"Shop {i}", base, "US")


def page(body):
    return f'<html><script type="application/ld+json">{body}</script><p>Protein 25g</p></html>'


FACTS = "<p>Serving Size: 1 Scoop (30 g) Servings Per Container 30 Protein 24g Calories 117 Total Fat 1g Total Carbohydrate 3g</p>"


def landed(spark, upc="111111111111"):
    feed = {"id": 1, "handle": "whey", "title": "Ghost Whey 2 lb", "vendor": "Ghost", "product_type": "Protein", "body_html": FACTS,
            "variants": [{"id": 11, "title": "Vanilla", "price": "30.00"}, {"id": 12, "title": "Cocoa", "price": "31.00"}]}
    rows = {
        "shopify": [json.dumps(feed), json.dumps(feed)[:-3], json.dumps({"id": 2, "title": "no handle"}), None],
        "walmart": [json.dumps({"itemId": 7, "name": "Iso Whey", "brandName": "Iso", "salePrice": 20.5, "upc": upc}), "[1,", json.dumps({"name": "x"})],
        "amazon": [json.dumps({"asin": "A1", "product_title": "Casein 2 lb", "product_price": "$25.00"}), "{"],
        "kroger": [json.dumps({"productId": upc, "brand": "Krog", "description": "Krog Whey", "items": [{"price": {"regular": 15.0}}]}), "nope"],
        "ebay": [json.dumps({"itemId": "v1", "title": "Used Whey", "price": {"value": "12.00", "currency": "USD"}}), '{"itemId":'],
    }
    made = {}
    for i, kind in enumerate(KINDS[:5]):
        more = {"amazon": f", d {DETAIL}", "ebay": ", upc string"}.get(kind, "")
        made[kind] = spark.createDataFrame([(*owner(i), p, *([None] if more else [])) for p in rows[kind]], f"{LANDED}, payload string{more}")
    pages = [page('{"@type":"Product","name":"Page Whey","sku":"p1","offers":{"price":"9.99"}}'), page("{broken"), None]
    made["jsonld"] = spark.createDataFrame([(*owner(5), f"https://p.example/{k}", h) for k, h in enumerate(pages)], f"{LANDED}, url string, html string")
    off = spark.createDataFrame([(*owner(9), json.dumps(feed))], f"{LANDED}, payload string")
    made["shopify"] = made["shopify"].union(off)
    return made


def totals(runs, run_id):
    row = runs.stats(run_id).filter("source_id IS NULL").first()
    return {c: row[c] for c in COUNTERS}


def rows_of(runs):
    names = ("sources", "brands", "products", "listings", "variants", "nutrition", "facts", "price_observations", "issues", "runs")
    return {t: Counter(map(str, runs.stored(t).select(sorted(runs.stored(t).columns)).collect())) for t in names}


def test_bad_records_become_issues(spark, tmp_path):
    runs = Ingestion(spark, str(tmp_path))
    counts = runs.run(landed(spark), sources(spark, [(8, "odd", "Odd", "fax", "US", "https://fax.example", True)]), "r1", "2030-01-01")
    assert counts == {"sources": 7, "products": 6, "variants": 7, "prices": 7, "nutrition_ok": 2, "issues": 12}
    assert totals(runs, "r1") == counts
    issues = runs.stored("issues").collect()
    assert Counter(i.stage for i in issues) == {"extract": 10, "validate": 1, "fetch": 1}
    assert Counter(i.source_id for i in issues if i.stage == "extract") == {0: 3, 1: 2, 2: 1, 3: 1, 4: 1, 5: 2}
    messages = {(i.source_id, i.message) for i in issues if i.stage == "extract"}
    assert {(0, "payload is not valid JSON"), (0, "payload has no handle"), (0, "payload is missing"), (1, "payload has no itemId"),
            (5, "page has no readable product data"), (5, "page is missing")} <= messages
    cut = next(i for i in issues if i.source_id == 4)
    assert cut.payload == '{"itemId":' and cut.severity == "error" and cut.resolved is False
    view = metrics.listing_metrics(runs.catalog()).collect()
    assert len(view) == 7 and {v.price_cents for v in view} == {3000, 3100, 2050, 2500, 1500, 1200, 999}


def test_replay_changes_nothing_and_a_second_run_appends(spark, tmp_path):
    runs = Ingestion(spark, str(tmp_path))
    first = runs.run(landed(spark), sources(spark), "r1", "2030-01-01")
    before = rows_of(runs)
    assert runs.run(landed(spark), sources(spark), "r1", "2030-01-01") == first and rows_of(runs) == before
    runs.run(landed(spark), sources(spark), "r2", "2030-01-02")
    assert runs.table("variants").count() == 7 and runs.table("price_observations").count() == 14
    seen = runs.table("listings").agg({"first_seen_at": "max", "last_seen_at": "min"}).first()
    assert str(seen[0])[:10] == "2030-01-01" and str(seen[1])[:10] == "2030-01-02"


def test_a_run_that_failed_is_not_there(spark, tmp_path):
    runs = Ingestion(spark, str(tmp_path))
    runs.run(landed(spark), sources(spark), "r1", "2030-01-01")
    runs._write("variants", runs.stored("variants").drop("run_id"), "r2")  # no row in runs
    assert runs.stored("variants").count() == 7 and totals(runs, "r1")["variants"] == 7


def test_barcodes_tie_products_within_and_between_runs(spark, tmp_path):
    runs = Ingestion(spark, str(tmp_path))
    runs.run(landed(spark), sources(spark), "r1", "2030-01-01")
    products = {x.source_id: x.product_id for x in runs.table("listings").collect()}
    assert products[1] == products[3] and len(set(products.values())) == 5  # the barcode of two shops
    later = {"ebay": spark.createDataFrame(
        [(*owner(4), json.dumps({"itemId": "v2", "title": "Other name", "price": {"value": "5.00"}}), "111111111111")], f"{LANDED}, payload string, upc string")}
    runs.run(later, sources(spark), "r2", "2030-01-02")
    assert {x.product_id for x in runs.table("listings").filter("source_sku = 'v2'").collect()} == {products[1]}
    assert runs.table("products").count() == 5


def test_lacking_columns_and_empty_landing(spark, tmp_path):
    runs = Ingestion(spark, str(tmp_path))
    none = {kind: rows.limit(0) for kind, rows in landed(spark).items()}
    counts = runs.run(none, sources(spark), "r0", "2029-01-01")
    assert counts == {"sources": 6, "products": 0, "variants": 0, "prices": 0, "nutrition_ok": 0, "issues": 0}
    feed = json.dumps({"id": 1, "handle": "h", "title": "T", "vendor": "V", "variants": [{"id": 3, "price": "9.00"}]})
    bare = {"shopify": spark.createDataFrame([(0, "s0", "Shop", None, "US", feed)], f"{LANDED}, payload string")}
    counts = runs.run(bare, sources(spark), "r1", "2030-01-01")
    issue = runs.stored("issues", only="r1").filter("stage = 'upsert'").first()
    assert counts["variants"] == 0 and issue.message == "record lacks url" and '"title":"T"' in issue.payload


def brute_chains(offers, known):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for listing, position, _, key in offers:
        first[listing] = min(first.get(listing, (position, key)), (position, key))
    own = {listing: key for listing, (_, key) in first.items()}
    for listing, _, upc, _ in offers:
        if upc:
            up[find(("u", upc))] = find(("k", own[listing]))
    for key, upc in known:
        if upc:
            up[find(("u", upc))] = find(("k", key))
    old = {key for key, _ in known}
    members = defaultdict(set)
    for key in set(own.values()) | old:
        members[find(("k", key))].add(key)
    best = {root: min(keys, key=lambda k: (k not in old, k)) for root, keys in members.items()}
    return {listing: best[find(("k", key))] for listing, key in own.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_like_union_find(spark, seed):
    rng = random.Random(seed)
    offers = [("l1", 0, "1", "a"), ("l1", 1, "2", "x"), ("l2", 0, "2", "b"), ("l2", 1, "3", "b"), ("l3", 0, "3", "c"), ("l4", 0, None, "c"), ("l5", 0, "", "z")]
    offers += [(f"m{rng.randrange(60)}", rng.randrange(5), rng.choice([None, "hub", *[f"u{i}" for i in range(80)]]), f"k{rng.randrange(50)}") for _ in range(120)]
    offers = list({(o[0], o[1]): o for o in offers}.values())
    known = [("known9", "u3"), ("known1", "u4"), ("known1", None), ("k7", None), ("known5", "")]
    got = resolve_chains(
        spark.createDataFrame(offers, "listing_id string, position int, upc string, dedup_key string"),
        spark.createDataFrame(known, "product_key string, upc string")).collect()
    want = brute_chains(offers, known)
    assert len(got) == len(offers) and {r.listing_id: r.product_key for r in got} == want
    assert all(r.existing == (r.product_key in {k for k, _ in known}) for r in got) and want["l1"] == want["l4"] == "a"


def test_hubs_are_split(spark, monkeypatch):
    from larder.operators import components

    monkeypatch.setattr(components, "LIGHT", 5)
    edges = [("hub", f"n{i:03d}") for i in range(200)] + [(f"n{i:03d}", f"m{i:03d}") for i in range(0, 200, 7)] + [("p", "q"), ("q", "r"), (None, "p"), ("s", "s")]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[n] == "hub" for n in got if n[0] in "hnm") and got["r"] == "p" and "s" not in got


def test_deletes_follow_declared_keys(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "sources": make([(1,), (2,)], "source_id int"), "brands": make([("b",)], "brand_id string"),
        "products": make([(1, "b"), (2, "b"), (3, None)], "product_id int, brand_id string"),
        "listings": make([("a", 1, 1), ("c", 2, 2), ("d", 2, 1), ("e", 2, 3)], "listing_id string, source_id int, product_id int"),
        "variants": make([("va", "a"), ("vc", "c"), ("vd", "d"), ("ve", "e"), ("vx", None)], "variant_id string, listing_id string"),
        "prices": make([("va", 1), ("vc", 2), ("vd", 3), ("vd", 4), ("ve", 5)], "variant_id string, cents int"),
        "issues": make([(1, "i"), (2, "j"), (None, "k")], "source_id int, message string"),
    }
    left = foreign_keys.delete(tables, {"sources": make([(1,)], "source_id int"), "products": make([(2,)], "product_id int")})
    ids = {name: sorted(map(str, (r[0] for r in rows.collect()))) for name, rows in left.items()}
    assert ids == {"sources": ["2"], "brands": ["b"], "products": ["1", "3"], "listings": ["d", "e"], "variants": ["vd", "ve", "vx"],
                   "prices": ["vd", "vd", "ve"], "issues": ["2", "None", "None"]}
    assert left["brands"] is tables["brands"]
    with pytest.raises(ValueError):
        foreign_keys.parents_first([foreign_keys.ForeignKey("a", "x", "b", "x"), foreign_keys.ForeignKey("b", "y", "a", "y")])


def test_issue_messages(spark):
    row = (None, 0.5, 40.0, -1.0, 3.0, 300.0, "html_parse", 900.0, "v")
    schema = "serving_size_g double, servings_per_container double, protein_g double, fat_g double, carb_g double, calories_kcal double, " \
        "extraction_method string, size_g double, variant_id string"
    other = (300.0, 3.0, 24.0, 1.0, 3.0, 300.0, "html_parse", None, "w")
    both = quality.route_validated(quality.validate_nutrition(spark.createDataFrame([row, other], schema)))[1].collect()
    told = {i.variant_id: (i.severity, i.message) for i in both}
    assert told["v"] == ("error", "fat_g is negative (-1.0); servings_per_container (0.5) is below 2; implied serving size 1800 g exceeds 200 g")
    assert told["w"] == ("warning", "serving_size_g 300.0 outside plausible range; calories 300.0 disagree with macros (~117 kcal, 61% off)")


def test_whole_records_are_shuffled_once(spark, tmp_path, monkeypatch):
    labels = []
    monkeypatch.setattr(ingest, "kept", lambda df, label: labels.append((label, df.columns)) or kept(df, label))
    runs = ingest.Ingestion(spark, str(tmp_path))
    runs.run(landed(spark), sources(spark), "r1", "2030-01-01")
    assert [label for label, _ in labels] == ["listed", "records", "keys"]
    assert "title" in labels[1][1] and labels[2][1] == ["listing_id", "product_key"]
