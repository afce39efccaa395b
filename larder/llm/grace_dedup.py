"""Exact deduplication by Grace hash partitioning; equality is that of complete contents.

1. Every map task collapses its own rows first, ``CHUNK_BYTES`` of text at a time, in an
   open-addressing table. Of a chunk's equal texts one goes on, with their number and the row that
   would stay. So a text that a third of all rows hold is sent once a chunk, not once a row.
2. These records are dealt by content hash into as many buckets as the session has shuffle
   partitions. A bucket's task fills an open-addressing table of at most ``TABLE_BYTES`` of distinct
   contents. A record whose content is not in a full table is spilled; all its copies are too,
   since a table never takes in later what it once refused.
3. Spilled records are written, dealt again by another hash, and so on until nothing is spilled.
   Every bucket settles at least one content a level, and sizes only bound memory, never rows.

A slot's entry counts as found only when its stored bytes equal the record's, byte by byte.

Edge cases: a null text is an empty one; a null id is less than any other; of rows equal in text
and id the one read first stays, so that each group keeps exactly one row; a text larger than a
table is taken by an empty one; an empty table gives an empty result. Own columns stay, except
those named like a result column, which are replaced.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, fresh, stored

CHUNK_BYTES = 16 << 20
TABLE_BYTES = 64 << 20
ENTRY_BYTES = 100  # what an entry takes besides its content
NO_ID = -(1 << 63) - 1
MADE = ("keep_id", "group_size", "kept", "text_sha256")


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, room: int):
        self.room = room
        self.slots = array("i", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, h: int, content: bytes) -> int:
        """The content's entry, made if there is room for it; -1 if there is none."""
        mask = len(self.slots) - 1
        at = h & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == h and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        need = len(content) + ENTRY_BYTES
        if need > self.room and self.contents:
            return -1
        self.room -= need
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = array("i", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _contents(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Chunk:
    """Rows of one map task, collapsed until they are sent on."""

    def __init__(self, part: int):
        self.part, self.pos, self.no = part, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.size, self.slices, self.entries = 0, [], []
        self.table = ContentTable(1 << 62)
        self.counts: list[int] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, content: bytes) -> None:
        known = len(self.counts)
        entry = self.table.entry(xxhash.xxh3_64_intdigest(content), content)
        place = (NO_ID if doc_id is None else doc_id, -self.pos)  # the first of rows with one id
        if entry == known:
            self.counts.append(1)
            self.tops.append(place)
        else:
            self.counts[entry] += 1
            self.tops[entry] = max(self.tops[entry], place)
        self.entries.append(entry)
        self.size += len(content)
        self.pos += 1

    def rows(self, names: list[str]):
        """The held slices with their working columns; the chunk is empty afterwards."""
        at, seen, start = 0, 0, self.pos - len(self.entries)
        digests = [hashlib.sha256(c).hexdigest() for c in self.table.contents]
        for piece in self.slices:
            mine = self.entries[at:at + piece.num_rows]
            first = []
            for entry in mine:
                first.append(entry == seen)
                seen += entry == seen
            tops = [self.tops[e] for e in mine]
            yield pa.RecordBatch.from_arrays([
                *piece.columns[:-1],
                pa.array([self.part] * len(mine), pa.int32()),
                pa.array([self.no + e for e in mine], pa.int64()),
                pa.array(range(start + at, start + at + len(mine)), pa.int64()),
                pa.array(first, pa.bool_()),
                pa.array([self.counts[e] for e in mine], pa.int64()),
                pa.array([None if i == NO_ID else i for i, _ in tops], pa.int64()),
                pa.array([-p for _, p in tops], pa.int64()),
                pa.array(np.array([self.table.hashes[e] for e in mine], dtype=np.uint64).view(np.int64)),
                pa.array([digests[e] for e in mine], pa.string()),
            ], names=names)
            at += len(mine)
        self.no += len(self.counts)
        self._clear()


def collapsed(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """All rows with their place, the chunk's group they fall in, and that group's totals."""
    kept = [c for c in docs.columns if c.lower() not in MADE]
    work = fresh(docs, "part", "no", "pos", "first", "n", "top_id", "top_pos", "h", "sha")
    key = fresh(docs, "key")["key"]
    text_at = kept.index(text_col)
    names = [*kept, *work.values()]

    def run(batches):
        from pyspark import TaskContext

        chunk = Chunk(TaskContext.get().partitionId())
        for batch in batches:
            start = 0
            ids, contents = batch.column(batch.num_columns - 1).to_pylist(), _contents(batch.column(text_at))
            for i, (doc_id, content) in enumerate(zip(ids, contents, strict=True), 1):
                chunk.add(doc_id, content)
                if chunk.size >= chunk_bytes:
                    chunk.slices.append(batch.slice(start, i - start))
                    start = i
                    yield from chunk.rows(names)
            if start < batch.num_rows:
                chunk.slices.append(batch.slice(start))
            if len(chunk.entries) >= 1 << 16:  # short texts: rows weigh more than their contents
                yield from chunk.rows(names)
        if chunk.entries:
            yield from chunk.rows(names)

    kinds = ["int", "long", "long", "boolean", "long", "long", "long", "long", "string"]
    schema = docs.select(*kept, *[F.lit(None).cast(k).alias(n) for n, k in zip(work.values(), kinds, strict=True)]).schema
    rows = docs.select(*kept, F.col(id_col).cast("long").alias(key))
    return stored(rows.mapInArrow(run, schema), "grace-rows"), work


SPILL = "part int, no long, n long, top_id long, top_part int, top_pos long, h long, content string"


def settle(records: DataFrame, table_bytes: int) -> DataFrame:
    """Records of (SPILL) -> per record its whole group's ``n`` and top row; ``content`` is null.

    One level per pass: each bucket's task settles what its table can hold and spills the rest.
    """

    def run(batches):
        table = ContentTable(table_bytes)
        place, counts, tops = (array("i"), array("q"), array("i")), [], []
        for batch in batches:
            spill = []
            part, no, n, top_id, top_part, top_pos, h, _ = (batch.column(i) for i in range(8))
            hashes = h.to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            rows = zip(part.to_pylist(), no.to_pylist(), n.to_pylist(), top_id.to_pylist(), top_part.to_pylist(),
                       top_pos.to_pylist(), hashes, _contents(batch.column(7)), strict=True)
            for i, (p, o, many, top, in_part, at, code, content) in enumerate(rows):
                entry = table.entry(code, content)
                if entry < 0:
                    spill.append(i)
                    continue
                found = (NO_ID if top is None else top, -in_part, -at)
                if entry == len(counts):
                    counts.append(many)
                    tops.append(found)
                else:
                    counts[entry] += many
                    tops[entry] = max(tops[entry], found)
                for column, value in zip(place, (p, o, entry), strict=True):
                    column.append(value)
            if spill:
                yield pa.RecordBatch.from_arrays(batch.take(pa.array(spill)).columns, names=batch.schema.names)
        parts, nos, entries = place
        for at in range(0, len(entries), 1 << 16):
            mine = entries[at:at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(parts[at:at + (1 << 16)], pa.int32()), "no": pa.array(nos[at:at + (1 << 16)], pa.int64()),
                "n": pa.array([counts[e] for e in mine], pa.int64()),
                "top_id": pa.array([None if tops[e][0] == NO_ID else tops[e][0] for e in mine], pa.int64()),
                "top_part": pa.array([-tops[e][1] for e in mine], pa.int32()),
                "top_pos": pa.array([-tops[e][2] for e in mine], pa.int64()),
                "h": pa.nulls(len(mine), pa.int64()), "content": pa.nulls(len(mine), pa.string()),
            })

    buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled, level, left = None, 0, records
    while True:
        dealt = left.repartition(buckets, F.xxhash64("h", F.lit(level)))
        out = stored(dealt.mapInArrow(run, SPILL), f"grace-level-{level}")
        done, left = out.filter("content IS NULL"), out.filter("content IS NOT NULL")
        settled = done if settled is None else settled.union(done)
        if left.isEmpty():
            return settled
        level += 1


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
         table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All rows of ``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Rows find their group again by task and chunk group, a key that holds one task's rows at most.
    """
    rows, w = collapsed(docs, id_col, text_col, chunk_bytes)
    kept = [c for c in docs.columns if c.lower() not in MADE]
    records = rows.filter(F.col(w["first"])).select(
        F.col(w["part"]).alias("part"), F.col(w["no"]).alias("no"), F.col(w["n"]).alias("n"), F.col(w["top_id"]).alias("top_id"),
        F.col(w["part"]).alias("top_part"), F.col(w["top_pos"]).alias("top_pos"), F.col(w["h"]).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    groups = settle(records, table_bytes).select(
        F.col("part").alias(w["part"]), F.col("no").alias(w["no"]), F.col("top_id").alias("keep_id"),
        F.col("n").alias("group_size"), F.col("top_part").alias(w["top_id"]), F.col("top_pos").alias(w["top_pos"]))
    mine = rows.drop(w["n"], w["top_id"], w["top_pos"], w["h"], w["first"])
    stays = (F.col(w["part"]) == F.col(w["top_id"])) & (F.col(w["pos"]) == F.col(w["top_pos"]))
    return mine.join(groups, [w["part"], w["no"]]).select(
        *kept, "keep_id", "group_size", stays.alias("kept"), F.col(w["sha"]).alias("text_sha256"))


def distinct(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` per text, the one of the largest id; a null text counts as an empty one."""
    return mark(docs.select(*docs.columns), **options).filter("kept").select(*[c for c in docs.columns if c.lower() not in MADE])


def query(spark, sf_dir: str) -> DataFrame:
    marked = mark(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
