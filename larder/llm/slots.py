"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots that never changes. Bytes are summed per
slot, and a versioned map says which shard owns which slot. Rebalancing edits the map, never the
hash: ``first_map`` deals slots to shards by bytes, ``grow`` gives slots to one new shard and moves
no other slot, ``rebalance`` moves few slots from heavy to light shards.

The map has one row per slot, a number fixed by the parameter and not by the data, so planning on
the driver is bounded: 8,192 rows here. ``save_map`` and ``load_map`` keep its versions at a caller's
path; ``edit_map`` reads the newest, edits it and stores the next; ``assign`` follows a given one.

Law of the query: ``bytes``. Slots are dealt largest first to the lightest shard, so shards differ
by at most one slot's bytes. Edge cases: a null text counts 8 bytes and has a null crc; a null id
is a key like any other; rows of equal id and text are numbered, and the number goes into the key, so
that they spread over the slots; an empty table gives an empty map and result. Columns whose names
clash are replaced.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import documents, fresh, stored, work_folder

SLOTS = 8192
ROW_BYTES = 8
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def record_key(doc_id: Column, text: Column) -> Column:
    """Hash of id and text, so that an id repeated over many records doesn't fill one slot."""
    return F.xxhash64(doc_id, text)


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(key, F.lit(slots)).cast("int")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def slot_bytes(sized: DataFrame) -> list[tuple[int, int]]:
    """Bytes of every slot in use: at most the fixed number of slots, whatever the table's size."""
    return [(r[0], r[1]) for r in sized.groupBy("vslot").agg(F.sum("size")).collect()]


def first_map(sums: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Largest slot first to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    owner = {}
    for slot, size in sorted(sums, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return owner


def grow(owner: dict[int, int], sums: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version with shard number ``shards`` added: slots move into it only."""
    size = dict(sums)
    goal = sum(size.values()) / (shards + 1)
    loads = dict.fromkeys(range(shards), 0)
    for slot, shard in owner.items():
        loads[shard] += size.get(slot, 0)
    new, filled = dict(owner), 0
    by_shard: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot in sorted(owner, key=lambda s: (size.get(s, 0), s)):
        by_shard[owner[slot]].append(slot)
    heap = [(-load, s) for s, load in loads.items()]
    heapq.heapify(heap)
    while heap and filled < goal:
        load, shard = heapq.heappop(heap)
        fits = [s for s in by_shard[shard][-8:] if filled + size.get(s, 0) <= goal * 1.02]
        if -load <= goal or not fits:
            continue
        slot = fits[-1]
        by_shard[shard].remove(slot)
        new[slot] = shards
        filled += size.get(slot, 0)
        heapq.heappush(heap, (load + size.get(slot, 0), shard))
    return new


def rebalance(owner: dict[int, int], sums: list[tuple[int, int]], shards: int, slack: float = 0.02) -> dict[int, int]:
    """Moves slots from the heaviest to the lightest shard until all lie within ``slack``."""
    size = dict(sums)
    new = dict(owner)
    loads = dict.fromkeys(range(shards), 0)
    for slot, shard in new.items():
        loads[shard] += size.get(slot, 0)
    goal = sum(loads.values()) / max(1, shards)
    for _ in range(len(new)):
        heavy, light = max(loads, key=loads.get), min(loads, key=loads.get)
        gap = loads[heavy] - loads[light]
        fits = [s for s, shard in new.items() if shard == heavy and 0 < size.get(s, 0) < gap]
        if gap <= slack * goal or not fits:
            break
        slot = min(fits, key=lambda s: (abs(size[s] - gap / 2), s))
        new[slot] = light
        loads[heavy] -= size[slot]
        loads[light] += size[slot]
    return new


def save_map(spark: SparkSession, path: str, owner: dict[int, int], sums: list[tuple[int, int]], version: int) -> DataFrame:
    """Stores one version of the map at ``path``, which keeps all of them."""
    size = dict(sums)
    rows = [(version, slot, shard, size.get(slot, 0)) for slot, shard in sorted(owner.items())]
    table = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    table.write.mode("overwrite").parquet(f"{path}/at={version}")
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/at={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """A stored version of the map, the newest unless one is named: (version, slot to shard)."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    found = version if version is not None else table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == found).collect()  # one row a slot
    if not rows:
        raise ValueError(f"no version {found} of a slot map at {path}")
    return found, {r["vslot"]: r["shard"] for r in rows}


def edit_map(spark: SparkSession, path: str, sums: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Reads the newest version, edits it for today's bytes by slot and stores the next version.

    With more shards than the map knows, each new one takes slots and nothing else moves; else slots
    move from heavy to light shards. Slots that were empty so far go to the lightest shards first.
    """
    version, owner = load_map(spark, path)
    known = max(owner.values()) + 1
    loads = dict.fromkeys(range(known), 0)
    size = dict(sums)
    for slot, shard in owner.items():
        loads[shard] += size.get(slot, 0)
    for slot, weight in sorted(sums, key=lambda x: (-x[1], x[0])):
        if slot not in owner:
            owner[slot] = min(loads, key=loads.get)
            loads[owner[slot]] += weight
    if shards > known:
        for count in range(known, shards):
            owner = grow(owner, sums, count)
    else:
        owner = rebalance(owner, sums, known)
    save_map(spark, path, owner, sums, version + 1)
    return owner


def _numbered(rows: DataFrame, key: str, work: dict[str, str]) -> DataFrame:
    """Mixes into the key of rows with equal keys the row's number among them. They are numbered task
    by task and the tasks' counts are summed, so that very many equal rows don't meet; the numbers are
    0, 1, 2 ... however the rows are dealt, so reruns give the same keys."""
    again = rows.groupBy(key).count().filter("count > 1").select(key)
    if again.isEmpty():
        return rows
    place, part, nth, before = (work[w] for w in ("place", "part", "nth", "before"))
    held = stored(rows.join(again, key, "left_semi").withColumn(place, F.monotonically_increasing_id()), "slot-repeats")
    held = held.withColumn(part, F.shiftright(place, 33))
    counts = held.groupBy(key, part).agg(F.count(F.lit(1)).alias(nth))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, part, F.coalesce(F.sum(nth).over(earlier), F.lit(0)).alias(before))
    local = F.row_number().over(Window.partitionBy(key, part).orderBy(place)) - 1
    held = held.withColumn(nth, local).join(counts, [key, part]).withColumn(nth, F.col(nth) + F.col(before))
    mixed = held.withColumn(key, F.when(F.col(nth) == 0, F.col(key)).otherwise(F.xxhash64(key, nth)))
    return rows.join(again, key, "left_anti").select(rows.columns).union(mixed.select(rows.columns))


def _owner(spark: SparkSession, path: str | None, sums: list[tuple[int, int]], shards: int) -> DataFrame:
    """The map table to follow."""
    if path is None:
        return save_map(spark, f"{work_folder(spark)}/slot-map-{uuid.uuid4().hex}", first_map(sums, shards), sums, 1)
    try:
        version, owner = load_map(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return save_map(spark, path, first_map(sums, shards), sums, 1)
    if any(slot not in owner for slot, _ in sums):
        loads = dict.fromkeys(range(max(owner.values()) + 1), 0)
        for slot, size in sorted(sums, key=lambda x: (x[0] not in owner, -x[1], x[0])):
            owner.setdefault(slot, min(loads, key=loads.get))
            loads[owner[slot]] += size
        return save_map(spark, path, owner, sums, version + 1)
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/at={version}")


def assign(docs: DataFrame, shards: int, slots: int = SLOTS, key: Column | None = None,
           size: Column | None = None, map_path: str | None = None) -> DataFrame:
    """All rows of ``docs`` with ``size, vslot, shard, slot``; ``slot`` counts from 0 in each shard.

    With ``map_path`` the newest map there decides; where there is none yet, the first one is stored
    there. Slots that the map doesn't know yet, since they were empty, are dealt and stored as its next version.
    ``key`` and ``size`` default to the hash of ``doc_id`` and ``text`` and to the text's bytes.
    Positions come from two levels, rows before in the slot and rows before the slot in its shard,
    so that no task holds a whole shard.
    """
    key = record_key(F.col("doc_id"), F.col("text")) if key is None else key
    size = byte_size(F.col("text")) if size is None else size
    made = ("size", "vslot", "shard", "slot")
    kept = [c for c in docs.columns if c.lower() not in made]
    work = fresh(docs, "key", "at", "first", "place", "part", "nth", "before")
    sized = _numbered(docs.select(*kept, size.alias("size"), key.alias(work["key"])), work["key"], work)
    sized = sized.withColumn("vslot", virtual_slot(F.col(work["key"]), slots))
    sums = slot_bytes(sized)
    owner = _owner(docs.sparkSession, map_path, sums, shards)
    counts = sized.groupBy("vslot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = owner.join(counts, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(work["first"]))
    inside = Window.partitionBy("vslot").orderBy(work["key"])
    return (
        sized.withColumn(work["at"], F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(places), "vslot")  # one row per slot, at most the fixed number
        .select(*kept, "size", "vslot", "shard", (F.col(work["first"]) + F.col(work["at"])).alias("slot"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text stays at the scan: key, bytes and checksum are all that the digest needs
    slim = documents(spark, sf_dir).select(
        "doc_id", F.crc32("text").alias("text_crc32"), byte_size(F.col("text")).alias("bytes"),
        record_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    slim = stored(slim, "slot-records")
    return assign(slim, 24, key=F.col("key"), size=F.col("bytes")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
