"""Late materialisation, bucketed history, view refresh, trigram search, SQL functions, source word lists, JSON-LD depth."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from larder.operators import grouping, metrics, ranking, refresh, search
from larder.operators.filters import FilterSpec
from larder.plans import catalog, sql_surface, writes
from larder.session import CLEANUP, cut_lineage, kept
from larder.sources import feeds, retailers
from larder.sources.adapter import StarCatalog

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cat(spark):
    return StarCatalog(spark, ROOT)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_is_ranked_on_keys(cat):
    text = plan(catalog.grid_page(cat, FilterSpec(market="UK")))
    for wide in ("Whey Protein Isolate", "shop.example", "Gluten-Free"):  # ingredient text, urls, label text
        assert wide not in text
    assert "Whey Protein Isolate" in plan(grouping.grouped_listings(cat, FilterSpec(market="UK")))


@pytest.mark.parametrize("spec", [
    lambda: FilterSpec(), lambda: FilterSpec(market="UK", metric="priceCents"), lambda: FilterSpec(metric="costPer30gProtein", order="worst", dietary=("vegan",)),
    lambda: FilterSpec(no_artificial=True, q="ring", in_stock_only=True, max_price_cents=6000, sources=("supplier-000000001", "supplier-000000004")),
    lambda: FilterSpec(extra=(F.col("size_g") > 500,), brands=("Brand#1", "Brand#2", "Brand#3"))])
def test_keys_and_whole_offers_rank_alike(cat, spec):
    spec = spec()
    whole = grouping.grouped_listings(cat, spec)
    columns = ["product_id", "variant_id", "price_cents", "retailer_count", "offer_count"]
    want = sorted(map(str, whole.select(columns).collect()))
    assert sorted(map(str, grouping.grid_keys(cat, spec).select(columns).collect())) == want
    page = catalog.grid_page_rows(cat, spec).collect()
    top = ranking.page_listings(whole, spec).collect()
    assert sorted(map(str, page)) == sorted(str(r) for r in [type(r)(**{c: r[c] for c in page[0].asDict()}) for r in top]) if page else not top


def test_history_by_variant_needs_no_exchange(cat):
    stored = writes.bucketed(cat)
    executed = lambda df: df._jdf.queryExecution().executedPlan().toString()
    latest = metrics.join_latest_price(stored.variants.select("variant_id", "flavor"), stored.prices)
    merge = latest.hint("merge")
    cat.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (metrics.latest_price(stored.prices), merge, stored.prices.join(stored.variants.select("variant_id"), "variant_id", "left_semi")):
            assert "Exchange" not in executed(df) and df.count() > 0
    finally:
        cat.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, metrics.latest_price(stored.prices).collect())) == sorted(map(str, metrics.latest_price(cat.prices).collect()))


def test_changed_keys_drive_the_refresh(cat):
    before = catalog.Yesterday(cat)
    deltas = {name: refresh.changed_keys(getattr(before, name), getattr(cat, name), key) for name, key in refresh.RELATION_KEYS.items()}
    given = before.deltas()
    for name in deltas:  # the keys a caller names must cover all that changed
        assert deltas[name].exceptAll(given[name].distinct()).isEmpty() and not deltas[name].isEmpty(), name
    old = cut_lineage(catalog.view(before))
    fresh = refresh.refresh(old, cat, deltas)
    assert sorted(map(str, catalog.flat(fresh).collect())) == sorted(map(str, catalog.flat(catalog.view(cat)).collect()))
    touched = refresh.touched_variants(old, cat, {"brands": given["brands"]}).count()
    assert 0 < touched < catalog.view(cat).count() / 4
    assert refresh.touched_variants(old, cat, {}).count() == 0


def test_trigrams_find_what_a_scan_finds(cat):
    table = search.postings(cat.products, cat.brands)
    names = cat.products.join(cat.brands.select("brand_id", F.col("name").alias("brand_name")), "brand_id")
    for q in ("RING", "brand#1", "an", "", "zzz", "lace b", "d#2"):
        hit = F.contains(F.lower("name"), F.lit(q.lower())) | F.contains(F.lower("brand_name"), F.lit(q.lower()))
        want = sorted(r.product_id for r in names.filter(hit).collect())
        assert sorted(r.product_id for r in search.search(cat.products, cat.brands, table, q).collect()) == want, q
    assert search.candidates(table, "ring").count() < cat.products.count()


def test_sql_functions_are_inlined(cat):
    sql_surface.register(cat.spark, cat, "shop_")
    both = [
        cat.spark.sql("SELECT variant_id, ratio(fat_g, protein_g) AS r, total_protein(servings_per_container, protein_g) AS t FROM shop_nutrition"),
        cat.nutrition.select("variant_id", metrics.ratio(F.col("fat_g"), F.col("protein_g")).alias("r"),
                             metrics.total_protein(F.col("servings_per_container"), F.col("protein_g")).alias("t"))]
    assert both[0].sameSemantics(both[1]) or both[0]._jdf.queryExecution().optimizedPlan().sameResult(both[1]._jdf.queryExecution().optimizedPlan())
    page = sql_surface.grid_page_sql(cat, FilterSpec(market="UK"))
    assert sorted(map(str, page.select(sorted(page.columns)).collect())) == sorted(
        map(str, catalog.grid_page(cat, FilterSpec(market="UK")).select(sorted(page.columns)).collect()))


def test_word_lists_come_from_the_source(spark):
    configs = [(1, None), (2, '{"include_keywords":["SHAKER"],"exclude_keywords":["Whey"]}'), (3, '{"exclude_keywords":[]}'), (4, '{"include_keywords":[]}'), (5, "not json")]
    words = feeds.source_words(spark.createDataFrame(configs, "source_id int, config string"))
    titles = ["Whey Protein", "Steel Shaker", "Protein Bar"]
    rows = spark.createDataFrame([(s, json.dumps({"id": i, "title": t})) for s, _ in configs for i, t in enumerate(titles)], "source_id int, payload string")
    kept = feeds.powder_by_source(feeds.parse(rows, feeds.FEED_PRODUCT), words)
    got = {(r.source_id, r["item"]["id"]) for r in kept.collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (3, 2), (5, 0)} and kept.columns == ["source_id", "payload", "item"]


def collect(node):
    """Product names in document order, as a plain recursive walk gives them."""
    if isinstance(node, list):
        return [n for child in node for n in collect(child)]
    if not isinstance(node, dict):
        return []
    graph = node.get("@graph")
    kinds = node.get("@type")
    mine = [node.get("name")] if kinds == "Product" or (isinstance(kinds, list) and "Product" in kinds) else []
    return [n for child in (graph if isinstance(graph, list) else []) for n in collect(child)] + mine


def product(name, **more):
    return {"@type": "Product", "name": name, **more}


def test_json_ld_of_any_depth(spark):
    deep = product("d0")
    for i in range(1, 12):
        deep = [deep, product(f"d{i}")] if i % 2 else {"@type": ["Product", "Thing"], "name": f"d{i}", "@graph": [deep, [[]], 5]}
    trees = [
        product("one"), [product("a"), [product("b"), [product("c")]], {"@graph": [[product("x")], {"@graph": [product("y")]}], "name": "no"}],
        {"@graph": {"@type": "Product", "name": "not a list"}}, {"@graph": [], "@type": "Product", "name": "hollow"}, deep, [[[[]]]], 7, "[[[",
        product("text", description="[[[[ brackets ]]")]
    rows = [(i, "<script type='application/ld+json'>" + (json.dumps(t) if t != "[[[" else t) + "</script>") for i, t in enumerate(trees)]
    both = "".join(h for _, h in rows)
    pages = spark.createDataFrame([*rows, (99, both), (100, "<p>none</p>"), (101, None)], "n int, html string")
    got = {}
    for r in retailers.jsonld_products(pages).select("n", "pos", F.try_variant_get("node", "$.name", "string").alias("name")).collect():
        got.setdefault(r.n, {})[r.pos] = r.name
    want = {i: collect(t) for i, t in enumerate(trees) if t != "[[["} | {99: [n for t in trees if t != "[[[" for n in collect(t)]}
    assert {n: [names[k] for k in sorted(names)] for n, names in got.items()} == {n: names for n, names in want.items() if names}
    assert os.sep


def test_refresh_works_out_the_touched_variants_once(cat):
    brand = cat.brands.filter("name = 'Brand#7'").select("brand_id")
    fresh = refresh.refresh(cut_lineage(catalog.view(cat)), cat, {"brands": brand})
    assert any("/touched-" in path for path in fresh.inputFiles())


def files_below(folder):
    return sum(len(files) for _, _, files in os.walk(folder))


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    rows = spark.range(50_000).repartition(7).groupBy((F.col("id") % 1000).alias("k")).count()
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    before = files_below(folder)
    table = kept(rows, "counted")
    for _ in range(50):  # files are deleted beside the job
        if files_below(folder) <= before:
            break
        time.sleep(0.1)
    assert files_below(folder) <= before and table.count() == 1000
    assert spark.conf.get(CLEANUP) == "false"


def test_refreshed_rows_are_stored_before_the_view_is_shuffled(cat):
    fresh = refresh.refresh(cut_lineage(catalog.view(cat)), cat, {"brands": cat.brands.filter("name = 'Brand#7'").select("brand_id")})
    assert {path.rsplit("/", 2)[1].split("-")[0] for path in fresh.inputFiles()} == {"touched", "fresh"}
