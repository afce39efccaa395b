"""Expensive payload expressions stand in a plan once."""

import pytest
from pyspark.sql import functions as F

from larder.operators.ingest import payload_problem
from larder.plans import writes
from larder.sources import retailers as shops
from larder.sources.adapter import StarCatalog


def times(spark, column, function):
    rows = spark.createDataFrame([("", "")], "html string, payload string").select(column.alias("x"))
    return rows._jdf.queryExecution().analyzed().toString().count(f"{function}(")


def test_a_page_is_searched_once(spark):
    offer = shops.pick_offer(shops.pick_node(shops.product_nodes(F.col("html"))))
    assert times(spark, offer, "regexp_extract_all") == 1
    assert times(spark, payload_problem("jsonld"), "regexp_extract_all") == 1


@pytest.mark.parametrize("kind", ["shopify", "ebay"])
def test_a_payload_is_parsed_once(spark, kind):
    found = times(spark, payload_problem(kind), "parse_json")
    assert max(found, times(spark, payload_problem(kind), "try_parse_json")) == 1


def test_runs_read_payloads_that_landed(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(writes.Ingestion, "run", lambda self, landed, *rest: seen.append(landed))
    writes.ingested(StarCatalog(spark, "/root/testdata/sf0.001"), writes.FIRST, writes.SECOND)
    assert seen[0] is seen[1] and all("/landed-" in path for rows in seen[0].values() for path in rows.inputFiles())
