"""All queries by key, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.operators.filters import FilterSpec
from larder.oracle import catalog as catalog_sql
from larder.oracle import payloads as payloads_sql
from larder.oracle import sql_surface as surface_sql
from larder.oracle import text as text_sql
from larder.oracle import writes as writes_sql
from larder.plans import catalog, payloads, sql_surface, text, writes
from larder.sources.adapter import StarCatalog

GROUPS = [catalog.QUERIES, payloads.QUERIES, text.QUERIES, writes.QUERIES, sql_surface.QUERIES]
ORACLES = [catalog_sql.ORACLE, payloads_sql.ORACLE, text_sql.ORACLE, writes_sql.ORACLE, surface_sql.ORACLE]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.grid_page(StarCatalog(spark, sf_dir), FilterSpec())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(fn):
        return lambda spark, sf_dir: fn(StarCatalog(spark, sf_dir))

    return {key: bound(fn) for group in GROUPS for key, fn in group.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for group in ORACLES for key, sql in group.items()}
