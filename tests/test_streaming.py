"""Streams over many small batches that arrive out of order, with replays."""

from pyspark.sql import functions as F

from larder.operators.upserts import UpsertPolicy
from larder.plans import writes
from larder.sources.adapter import StarCatalog
from larder.streaming import jobs

PRICES = "variant_id string, price_cents long, captured_at timestamp_ntz, seq long, event_id long"


def landed(spark, path):
    """Ten days apart, newest first, one file a batch; every row comes again in a later file."""
    rows = spark.range(60).select(
        F.concat(F.lit("v"), F.col("id") % 7).alias("variant_id"), (F.col("id") * 10).alias("price_cents"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id * 10 as int))").alias("captured_at"),
        F.col("id").alias("seq"), F.col("id").alias("event_id"))
    for turn in range(2):
        for part in range(5, -1, -1):
            rows.filter(f"event_id div 10 = {part}").coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, spark.createDataFrame([], PRICES).schema)


def test_append_keeps_late_rows_and_drops_replays(spark, tmp_path):
    run = jobs.price_append(landed(spark, f"{tmp_path}/in"), ["event_id"], f"{tmp_path}/out", f"{tmp_path}/ckpt")
    run.awaitTermination()
    assert run.lastProgress["batchId"] >= 8
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(60))


def test_latest_price_in_any_order(spark, tmp_path):
    stream = landed(spark, f"{tmp_path}/in")
    run = jobs.latest_price(stream, "variant_id", f"{tmp_path}/table", f"{tmp_path}/ckpt")
    run.awaitTermination()
    want = {f"v{k}": max(i for i in range(60) if i % 7 == k) * 10 for k in range(7)}
    assert {r.variant_id: r.price_cents for r in jobs.read_latest(spark, f"{tmp_path}/table", "variant_id").collect()} == want
    # replays and late rows change no state: later batches write fewer keys
    counts = {r["batch"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/table").groupBy("batch").count().collect()}
    assert max(counts.values()) <= 7 and run.lastProgress["batchId"] >= 8


def test_upserts_in_any_order_and_again(spark, tmp_path):
    policy = UpsertPolicy(("k",), ("name",), ("first_name",), ("seen",))
    schema = "k long, name string, first_name string, seen int, seq long"
    batches = [[(1, "b", "b", 5, 2), (2, "x", "x", 1, 1)], [(1, None, "c", 3, 3)], [(1, "a", "a", 4, 1)], [(1, None, "c", 3, 3)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    for _ in range(2):  # a second start finds nothing new
        jobs.catalog_upsert(stream, policy, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
        got = jobs.read_upserted(spark, f"{tmp_path}/out", policy).collect()
        assert sorted((r.k, r.name, r.first_name, r.seen) for r in got) == [(1, None, "a", 5), (2, "x", "x", 1)]


def test_a_batch_holds_no_state_and_is_landed_by_many_tasks(spark, tmp_path):
    run = jobs.latest_price(landed(spark, f"{tmp_path}/in"), "variant_id", f"{tmp_path}/table", f"{tmp_path}/ckpt")
    run.awaitTermination()
    assert run.lastProgress["stateOperators"] == []
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        cat = StarCatalog(spark, "/root/testdata/sf0.001")
        rows = writes._stream(cat, spark.range(4000), "rows")
        run = jobs.run_batches(rows, lambda batch, k: batch.write.parquet(f"{tmp_path}/seen/batch={k}"), f"{tmp_path}/ckpt2")
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    assert sorted(r.id for r in seen.collect()) == list(range(4000))
    sizes = [r["count"] for r in seen.groupBy("batch").count().collect()]
    assert len(sizes) == 8 and len(seen.inputFiles()) > 8
