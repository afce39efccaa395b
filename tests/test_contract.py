import duckdb
import pytest

import __spark_entry__ as contract

ROOT = "/root/testdata/sf0.001"
SAMPLE = ["latest_price", "best_offer_per_product", "rank_offers", "upsert_listings", "derive_facts",
          "normalize_walmart", "stream_validate_route"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 50


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for table in ("nation", "supplier", "part", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    df = contract.queries()[key](spark, ROOT)
    names = sorted(df.columns)
    got = sorted(map(str, [tuple(r) for r in df.select(*names).collect()]))
    cur = con.execute(contract.oracle_sql()[key])
    place = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted(str(tuple(r[place[n]] for n in names)) for r in cur.fetchall())
    assert got == want
