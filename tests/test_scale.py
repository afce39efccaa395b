"""Work that must grow no faster than its input: stored tables, numbering within groups, pages."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import detail, grouping, metrics, ranking
from larder.operators.filters import FilterSpec
from larder.plans import catalog, payloads, text
from larder.sources.adapter import StarCatalog

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cat(spark):
    return StarCatalog(spark, ROOT)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prices_meet_stored_sources(cat):
    assert any("/sources-" in path for path in cat.prices.inputFiles())
    assert "BroadcastHashJoin" in executed(cat.prices) and "Exchange hashpartitioning" not in executed(cat.prices)


@pytest.mark.parametrize("huge", [1_000_000, 40])
def test_small_and_huge_groups_are_numbered_alike(spark, monkeypatch, huge):
    monkeypatch.setattr(ranking, "HUGE", huge)
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 9 + [None] * 5 + ["a", "b", "c"]), rng.randrange(30), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r.id: r.pos for r in ranking.rank_within(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    seen, want = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want


def test_points_join_and_number_in_one_shuffle(cat):
    points = detail.series_points(catalog.history(cat))
    assert any("/history-" in path for path in points.inputFiles())
    cat.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert executed(detail.series_points(catalog.history(cat))).count("Exchange hashpartitioning") == 2  # points, spans
    finally:
        cat.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_detail_rows_store_only_what_they_show(cat):
    rows = catalog.QUERIES["product_detail_rows"](cat)
    stored = cat.spark.read.parquet(*rows.inputFiles())
    assert sorted(stored.columns) == ["market", "product_id", "protein_per_dollar", "variant_id"]


def test_names_meet_listings_before_offers(cat):
    plan = metrics.listing_metrics(cat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("product_id#") < plan.index("p_name")
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "source_id" in joins[0] and "product_id" not in joins[0]  # the last join of whole offers is by source


def test_a_page_is_ranked_once_and_cuts_the_listings(cat):
    keys = ranking.page_listings(grouping.grid_keys(cat, FilterSpec()), FilterSpec())
    page = grouping.fetch_offers(cat, keys.select("variant_id", "offer_count"))
    assert any("/page-" in path for path in page.inputFiles())
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and page.count() == 50


def test_titles_are_parsed_once_for_resolution(cat):
    for query in (text.resolved, text.resolved_chains):
        rows = query(cat)
        assert all("/titles_" in path for path in rows.inputFiles())
        assert "regexp_extract_all" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_every_family_is_dealt_over_all_tasks(spark, cat):
    """Even where the keys come dealt by variant from an aggregate, whose partitions adaptive execution joins."""
    for kind in ("shopify", "jsonld"):
        assert "REPARTITION_BY_NUM" in executed(payloads.landed_families(cat)[kind])
    df = payloads.landed_families(cat)["walmart"]
    df.write.format("noop").mode("overwrite").save()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
