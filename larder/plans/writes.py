"""Writer queries: upserts, appends, expiry, and the streaming jobs run to completion."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import identity
from larder.operators import detail, foreign_keys, metrics, upserts
from larder.operators.ingest import Ingestion
from larder.operators.upserts import POLICIES, upsert
from larder.plans.catalog import flat, validated
from larder.plans.payloads import landed_families
from larder.operators.quality import route_validated, validate_nutrition
from larder.session import kept, shared_folder
from larder.sources import fixtures as fx
from larder.sources.adapter import StarCatalog
from larder.sources.bucketed import BucketedCatalog
from larder.streaming import jobs

SPLIT = "1998-01-01"


def upsert_sources(cat: StarCatalog) -> DataFrame:
    """Every source renamed by a new definition file that also brings new sources."""
    columns = ["slug", "name", "base_url", "market", "enabled", "type"]
    old = cat.sources.select(*columns)
    renamed = old.select(
        "slug", F.concat("name", F.lit(" v2")).alias("name"), "base_url", "market",
        F.coalesce("enabled", F.lit(True)).alias("enabled"), F.lit("jsonld").alias("type"), F.lit(1).alias("seq"),
    )
    fresh = cat.table("nation").select(
        identity.slugify(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"),
        F.lit("https://new.example").alias("base_url"), F.lit("US").alias("market"),
        F.lit(True).alias("enabled"), F.lit("shopify").alias("type"), F.lit(2).alias("seq"),
    )
    return upsert(old, renamed.unionByName(fresh), POLICIES["sources"])


def upsert_brands(cat: StarCatalog) -> DataFrame:
    """Brand spellings as products arrive; the last one seen names the brand."""
    name = F.when(F.col("p_partkey") % 2 == 1, F.upper("p_brand")).otherwise(F.col("p_brand"))
    seen = cat.table("part").select(
        identity.slugify(identity.normalize_brand(F.col("p_brand"))).alias("slug"), name.alias("name"),
        F.col("p_partkey").alias("seq"),
    )
    return upsert(seen.select("slug", "name").limit(0), seen, POLICIES["brands"])


def upsert_products(cat: StarCatalog) -> DataFrame:
    part = cat.table("part")
    rows = part.select(
        identity.product_dedup_key(F.col("p_brand"), F.col("p_name")).alias("dedup_key"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 10 != 0, F.lower("p_type")).alias("category"),
        F.col("p_brand").alias("brand_id"), F.col("p_partkey").alias("seq"), "p_size",
    )
    small = upserts.fold_batch(rows.filter("p_size <= 25"), POLICIES["products"])
    return upsert(small, rows.filter("p_size > 25"), POLICIES["products"])


def arrivals(cat: StarCatalog) -> DataFrame:
    """Listings as they are seen over time, with a total order of arrival."""
    lines = cat.table("lineitem")
    return lines.select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").cast("string").alias("source_sku"),
        F.concat(F.lit("https://shop.example/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(F.col("l_linenumber") % 3 != 0, F.to_json(F.struct("l_orderkey"))).alias("raw_payload"),
        F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("last_seen_at"),
        F.col("l_shipdate").alias("first_seen_at"), F.struct("l_shipdate", *fx.TIE_COLUMNS).alias("seq"),
    )


def upsert_listings(cat: StarCatalog) -> DataFrame:
    policy = POLICIES["listings"]
    seen = arrivals(cat)
    before = seen.filter(F.col("first_seen_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    after = seen.filter(F.col("first_seen_at") >= F.lit(SPLIT).cast("timestamp_ntz"))
    return upsert(upserts.fold_batch(before, policy), after, policy)


def upsert_variants(cat: StarCatalog) -> DataFrame:
    """All variants again: sizes measured anew, and some barcodes lost."""
    old = cat.variants
    new = old.select(
        "listing_id", "source_variant_id", "flavor", (F.col("size_g") + 1.0).alias("size_g"), "size_label",
        F.when(F.length("variant_id") % 2 == 0, F.col("upc")).alias("upc"), "compare_at_price_cents",
        F.lit(1).alias("seq"),
    )
    return upsert(old, new, POLICIES["variants"])


def upsert_nutrition(cat: StarCatalog) -> DataFrame:
    """A second run with more protein. Its rejects do not delete what was accepted before."""
    second = cat.nutrition_candidates.withColumn("protein_g", F.col("protein_g") + 3.0)
    accepted = accepted_rows(second).withColumn("seq", F.lit(1))
    return upsert(cat.nutrition, accepted, POLICIES["nutrition"])


def accepted_rows(candidates: DataFrame) -> DataFrame:
    return route_validated(validate_nutrition(candidates))[0]


def upsert_facts(cat: StarCatalog) -> DataFrame:
    new = cat.facts.withColumns(
        {"ingredients_text": F.concat("ingredients_text", F.lit(", Salt")), "seq": F.lit(1)}
    )
    return flat(upsert(cat.facts, new, POLICIES["facts"]))


RUN_AT = "2030-01-01"


def appended_prices(cat: StarCatalog) -> DataFrame:
    """The history after one more run: each variant's price is observed again though unchanged."""
    old = cat.prices.drop("seq")
    run = metrics.latest_price(cat.prices).withColumn("captured_at", F.lit(RUN_AT).cast("timestamp_ntz"))
    return old.unionByName(run)


def written_prices(cat: StarCatalog) -> DataFrame:
    """The same through the partitioned sink, read back and counted per capture month."""
    path = os.path.join(shared_folder(cat.spark), f"prices-{uuid.uuid4().hex}")
    upserts.append_price_observations(appended_prices(cat), path)
    return cat.spark.read.parquet(path).groupBy("captured_month").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("price_cents").alias("cents")
    )


def written_issues(cat: StarCatalog) -> DataFrame:
    """The issues of a run through their sink, written twice, read back and counted."""
    path = os.path.join(shared_folder(cat.spark), f"issues-{uuid.uuid4().hex}")
    issues = route_validated(validated(cat))[1]
    for run in ("1", "1"):
        upserts.append_issues(issues, path, run)
    return cat.spark.read.parquet(path).groupBy("stage", "severity", "codes").agg(F.count(F.lit(1)).alias("issues"))


BROKEN = "(pk + sk) % 61 = 0"  # payloads that arrive cut off


def cut_off(cat: StarCatalog) -> dict[str, DataFrame]:
    """The landed payloads of every family; some of each end in the middle."""
    def cut(rows: DataFrame) -> DataFrame:
        body = "html" if "html" in rows.columns else "payload"
        if body == "html":
            half = F.regexp_replace("html", r"\}+\]?\}*</script>", "</script>")
        else:
            half = F.expr("left(payload, length(payload) - 1)")
        return rows.withColumn(body, F.when(F.expr(BROKEN), half).otherwise(F.col(body)))

    return {kind: cut(rows) for kind, rows in landed_families(cat).items()}


def ingested(cat: StarCatalog, *runs: tuple[str, str]) -> Ingestion:
    """The landed payloads taken in by runs of these ids and times."""
    made = Ingestion(cat.spark, os.path.join(shared_folder(cat.spark), f"catalog-{uuid.uuid4().hex}"))
    landed = {kind: kept(rows, f"landed-{kind}") for kind, rows in cut_off(cat).items()}
    for run_id, captured_at in runs:
        made.run(landed, cat.sources, run_id, captured_at)
    return made


FIRST, SECOND = ("r1", "2030-01-01"), ("r2", "2030-01-02")


def ingest_catalog(cat: StarCatalog) -> DataFrame:
    """Every offer of the catalog that one run made, read through the listing view."""
    view = metrics.listing_metrics(ingested(cat, FIRST).catalog())
    return view.select("source_slug", "market", "url", "price_cents", "currency", "in_stock", "compare_at_price_cents", "size_g",
                       "protein_g", "servings_per_container", "confidence")


def ingest_issues(cat: StarCatalog) -> DataFrame:
    issues = ingested(cat, FIRST).stored("issues")
    reason = F.when(F.col("stage") == "extract", F.col("message"))
    return issues.groupBy("source_id", "stage", "severity", reason.alias("reason")).agg(
        F.count("payload").alias("issues"), F.count("url").alias("with_url"))


def ingest_replay(cat: StarCatalog) -> DataFrame:
    """Rows of the tables after two runs, the first of them taken in twice."""
    made = ingested(cat, FIRST, FIRST, SECOND)
    parts = [made.table(t).select(F.lit(t).alias("table")) for t in ("listings", "variants", "price_observations", "issues")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def surviving(cat: StarCatalog) -> DataFrame:
    """Variants left after deleting the sources that are switched off."""
    alive = cat.sources.filter(F.coalesce("enabled", F.lit(True)))
    listings = upserts.expire_orphans(cat.listings, alive, "source_id")
    return upserts.expire_orphans(cat.variants, listings, "listing_id").select("variant_id")


def issues_after_delete(cat: StarCatalog) -> DataFrame:
    alive = cat.sources.filter(F.coalesce("enabled", F.lit(True)))
    owner = F.split_part("variant_id", F.lit("-"), F.lit(2)).cast("long")
    issues = route_validated(validated(cat))[1].select("variant_id", "codes", owner.alias("source_id"))
    return upserts.forget_parent(issues, alive, "source_id").select("variant_id", "codes", "source_id")


def delete_cascade(cat: StarCatalog) -> DataFrame:
    """What every table holds after deleting sources that are switched off, some products and some listings."""
    owner = F.split_part("variant_id", F.lit("-"), F.lit(2)).cast("long")
    issues = route_validated(validated(cat))[1].select("variant_id", owner.alias("source_id"))
    tables = {name: getattr(cat, name) for name in ("sources", "brands", "products", "listings", "variants", "nutrition", "facts", "prices")}
    doomed = {
        "sources": cat.sources.filter("NOT coalesce(enabled, true)"), "products": cat.products.filter("product_id % 50 = 0"),
        "listings": cat.listings.filter("(product_id + source_id) % 90 = 0"), "brands": cat.brands.filter("name = 'Brand#3'"),
    }
    left = foreign_keys.delete(tables | {"issues": issues}, doomed)
    ids = {"sources": "source_id", "brands": "brand_id", "products": "product_id", "listings": "listing_id", "issues": "source_id"}
    parts = [
        rows.groupBy(F.col(ids.get(name, "variant_id")).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table"), "id", "n")
        for name, rows in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def bucketed(cat: StarCatalog) -> BucketedCatalog:
    name = f"history_{uuid.uuid4().hex}"
    return BucketedCatalog(cat, name, os.path.join(shared_folder(cat.spark), name))


def bucketed_latest(cat: StarCatalog) -> DataFrame:
    """Latest price and nutrition of every variant, from tables laid out by variant."""
    stored = bucketed(cat)
    priced = metrics.join_latest_price(stored.variants.select("variant_id", "flavor"), stored.prices)
    return metrics.join_optional_nutrition(priced, stored.nutrition).select("variant_id", "flavor", "price_cents", "captured_at", "protein_g")


def bucketed_history(cat: StarCatalog) -> DataFrame:
    stored = bucketed(cat)
    return detail.history_for_variants(stored.prices, stored.variants.filter("flavor = 'Vanilla'")).select(
        "variant_id", "price_cents", "captured_at")


# ---- Streams, run over everything that is available and then stopped ----------------------------


def _scratch(cat: StarCatalog, name: str) -> str:
    return os.path.join(shared_folder(cat.spark), f"{name}-{uuid.uuid4().hex}")


BATCHES = 8


def _stream(cat: StarCatalog, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` landed in files without regard to their order, and read back in eight batches.

    As many tasks land them as the session shuffles into, so that no task writes a whole batch.
    """
    path = _scratch(cat, name)
    per_batch = -(-int(cat.spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES)
    rows.repartition(BATCHES * per_batch).write.parquet(path)
    return jobs.read_stream(cat.spark, path, rows.schema, per_batch)


def stream_price_append(cat: StarCatalog) -> DataFrame:
    """Events as price observations, every one delivered twice; the replays are dropped."""
    events = cat.table("events").select(
        F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("variant_id"),
        F.floor(F.col("value") * 100).alias("price_cents"), F.col("ts").alias("captured_at"), "event_id",
    )
    incoming = _stream(cat, events.unionAll(events), "events")
    out = _scratch(cat, "appended")
    jobs.price_append(incoming, ["event_id"], out, _scratch(cat, "ckpt")).awaitTermination()
    return cat.spark.read.parquet(out).select("event_id", "variant_id", "price_cents")


def stream_latest_price(cat: StarCatalog) -> DataFrame:
    incoming, out = _stream(cat, cat.prices, "prices"), _scratch(cat, "latest")
    jobs.latest_price(incoming, "variant_id", out, _scratch(cat, "ckpt")).awaitTermination()
    return jobs.read_latest(cat.spark, out, "variant_id").drop("seq")


def stream_catalog_upsert(cat: StarCatalog) -> DataFrame:
    incoming, out = _stream(cat, arrivals(cat), "arrivals"), _scratch(cat, "listings")
    policy = POLICIES["listings"]
    jobs.catalog_upsert(incoming, policy, out, _scratch(cat, "ckpt")).awaitTermination()
    return jobs.read_upserted(cat.spark, out, policy).select(*policy.columns)


def stream_validate_route(cat: StarCatalog) -> DataFrame:
    """What lies in both sinks afterwards."""
    incoming = _stream(cat, cat.nutrition_candidates, "candidates")
    accepted, issues = _scratch(cat, "accepted"), _scratch(cat, "issues")
    jobs.validate_route(incoming, accepted, issues, _scratch(cat, "ckpt")).awaitTermination()
    none = F.lit(None).cast("string")
    good = cat.spark.read.parquet(accepted).select(
        F.lit("accepted").alias("sink"), "variant_id", none.alias("severity"), none.alias("codes"))
    return good.unionByName(cat.spark.read.parquet(issues).select(F.lit("issues").alias("sink"), "variant_id", "severity", "codes"))


QUERIES = {
    "upsert_sources": upsert_sources,
    "upsert_brands": upsert_brands,
    "upsert_products": upsert_products,
    "upsert_listings": upsert_listings,
    "upsert_variants": upsert_variants,
    "upsert_nutrition": upsert_nutrition,
    "upsert_facts": upsert_facts,
    "append_price_observations": appended_prices,
    "append_price_sink": written_prices,
    "append_issues": written_issues,
    "ingest_run": lambda cat: ingested(cat, FIRST).stats("r1"),
    "ingest_catalog": ingest_catalog,
    "ingest_issues": ingest_issues,
    "ingest_replay": ingest_replay,
    "expire_orphans": surviving,
    "expire_orphans_issues": issues_after_delete,
    "delete_cascade": delete_cascade,
    "latest_price_bucketed": bucketed_latest,
    "history_for_variants_bucketed": bucketed_history,
    "stream_price_append": stream_price_append,
    "stream_latest_price": stream_latest_price,
    "stream_catalog_upsert": stream_catalog_upsert,
    "stream_validate_route": stream_validate_route,
}
