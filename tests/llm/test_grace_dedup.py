"""Grace hash deduplication against brute force, with tables small enough to spill."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larder.llm import grace_dedup
from tests.llm.fixtures import edge, edge_rows, empty, save

LEAST = -(1 << 70)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: LEAST if i is None else i)
        left = 1
        for i in ids:
            stays = left and i == keep
            left -= bool(stays)
            out[(i, keep, len(ids), bool(stays), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def found(df):
    return Counter(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def copies(seed=3, n=3000):
    rng = random.Random(seed)
    texts = [f"text {i} " + "pad " * rng.randrange(40) for i in range(400)]
    rows = [(i, "hot " * 50 if rng.random() < 0.35 else rng.choice(texts)) for i in range(n)]
    return rows + [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (None, None), (None, ""), (None, None)]


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 3000, "table_bytes": 4000}, {"chunk_bytes": 1, "table_bytes": 1}])
def test_copies_and_levels(spark, limits):
    rows = copies(n=20 if limits.get("table_bytes") == 1 else 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = grace_dedup.mark(docs, **limits)
    assert found(got) == brute(rows)
    one = grace_dedup.distinct(docs, **limits)
    assert one.columns == ["doc_id", "text"]
    assert Counter(t or "" for _, t in one.collect()) == Counter({t or "" for _, t in rows})


def test_equal_hashes_are_told_apart_by_content():
    table = grace_dedup.ContentTable(1 << 20)
    made = [table.entry(7, f"c{i}".encode()) for i in range(3000)]
    assert made == list(range(3000)) and [table.entry(7, f"c{i}".encode()) for i in range(3000)] == made
    full = grace_dedup.ContentTable(2 * (grace_dedup.ENTRY_BYTES + 1))
    assert [full.entry(1, b"a"), full.entry(2, b"b"), full.entry(3, b"c"), full.entry(1, b"a"), full.entry(3, b"c")] == [0, 1, -1, 0, -1]


def test_edges(spark, tmp_path):
    marked = grace_dedup.mark(edge(spark).withColumn("KEPT", F.lit(1)))
    assert found(marked) == brute([r[:2] for r in edge_rows()])
    assert {"lang", "size", "_row", "_text"} <= set(marked.columns) and "KEPT" not in marked.columns
    assert marked.filter("kept").count() == len({r[1] or "" for r in edge_rows()})
    assert grace_dedup.mark(empty(spark)).count() == 0
    assert found(grace_dedup.query(spark, save(spark, edge_rows(), tmp_path))) == brute([r[:2] for r in edge_rows()])


def test_query_is_whole(spark):
    import duckdb

    root = "/root/testdata/sf0.001"
    docs = duckdb.connect()
    docs.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    assert found(grace_dedup.query(spark, root)) == Counter(docs.execute(grace_dedup.ORACLE).fetchall())
