"""Token ids in Simple-8b words: the selector in a word's top four bits says how many ids of what
width its other 60 bits hold.

File format (a Parquet table, written by Spark's committer, one row per block): ``part`` and
``block`` place the block, ``first_id`` counts the ids before it in its part, ``doc_ids``,
``doc_lens`` and ``doc_words`` give each document's id, its number of ids and the offset of its
first word, and ``words`` holds the little-endian words. Documents begin at a word of their own, so
one can be decoded alone; a block takes whole documents until it has ``BLOCK_IDS`` ids, and all its
words are decoded at once by selector. Selector 0 is the escape: the next word is one raw 64-bit id.

Parts are ranges of ``doc_id`` in ascending order, nulls first, equal ids by text hash.

Edge cases: the string of a special token in a text is that token, as the library has it by default;
a null or empty text is the end id alone; repeated rows are documents of their own;
a very long text is a block of its own; an empty table gives an empty file; a table's own columns
with clashing names don't matter, since only id and text are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.chunks import JoinedMemo
from larder.llm.common import documents, stored

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
GROUP_BYTES = 1 << 23  # of texts that are encoded together

# Ids per word and bits per id for selectors 2 to 15; 0 is the escape, 1 is unused.
COUNTS = [1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

FILE_SCHEMA = (
    "part int, block int, first_id long, n_ids int, doc_ids array<long>, doc_lens array<int>, "
    "doc_words array<int>, words binary"
)


def _widest(known: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The greatest of each ``count`` values in a row, from two overlapping shorter runs."""
    if count not in known:
        half = (count + 1) // 2
        run = _widest(known, half)
        out = run.copy()
        shift = count - half
        if shift < len(run):
            np.maximum(run[:-shift], run[shift:], out=out[:-shift])
        known[count] = out
    return known[count]


def pack(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive documents -> the words, and the word offset of each document.

    Greedy: each word takes the most ids that fit. Which selectors fit at each place is found for
    all places at once; only the walk from word to word is a loop.
    """
    ids = ids.astype(np.uint64)
    n = len(ids)
    ends = np.cumsum(lens)
    room = np.minimum(np.repeat(ends, lens) - np.arange(n), 255).astype(np.uint8)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    widest = {1: bits}  # over that many ids from each place on; places near the end lack room
    selector = np.zeros(n, dtype=np.uint8)
    for s in range(15, 1, -1):  # wide to narrow: the last that fits holds the most
        selector[(_widest(widest, COUNTS[s]) <= WIDTHS[s]) & (room >= COUNTS[s])] = s
    take = np.array(COUNTS)[selector]
    hops, starts, first = take.tolist(), array("q"), []
    i = 0
    for end in ends.tolist():
        first.append(len(starts))
        while i < end:
            starts.append(i)
            i += hops[i]
    starts = np.frombuffer(starts, dtype=np.int64)
    chosen = selector[starts]
    used = 1 + (chosen == 0)
    place = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), dtype=np.uint64)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        if s == 0:
            words[place[mine] + 1] = ids[starts[mine]]
            continue
        at, packed = starts[mine], np.uint64(s) << np.uint64(60)
        for k in range(COUNTS[s]):
            packed = packed | ids[at + k] << np.uint64(k * WIDTHS[s])
        words[place[mine]] = packed
    place = np.append(place, len(words))
    return words, place[np.array(first, dtype=np.int64)]


def unpack(words: np.ndarray, lens: np.ndarray, doc_words: np.ndarray) -> np.ndarray:
    """The ids of a block, all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, dtype=bool)
    for z in np.flatnonzero(selector == 0).tolist():
        if not raw[z]:
            raw[z + 1] = True
    raw = raw[:-1]
    held = np.where(raw, 0, np.array(COUNTS)[selector])
    upto = np.cumsum(held) - held
    per_doc = np.diff(np.append(doc_words, len(words)))
    full = doc_words[per_doc > 0]
    doc_at = np.repeat(upto[full] if len(full) else np.zeros(0, dtype=np.int64), per_doc[per_doc > 0])
    ends = np.cumsum(lens)
    base = np.repeat((ends - lens)[per_doc > 0], per_doc[per_doc > 0])
    limit = np.repeat(ends[per_doc > 0], per_doc[per_doc > 0])
    target = base + upto - doc_at
    out = np.zeros(int(lens.sum()), dtype=np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[target[mine]] = words[mine + 1]
            continue
        at, held, end = target[mine], words[mine], limit[mine]
        full = bool((at + COUNTS[s] <= end).all())
        for k in range(COUNTS[s]):
            values = held >> np.uint64(k * WIDTHS[s]) & np.uint64((1 << WIDTHS[s]) - 1)
            inside = slice(None) if full else at + k < end
            out[(at + k)[inside]] = values[inside]
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> JoinedMemo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {i for i, token in tokenizer.get_added_tokens_decoder().items()}
    # a character of a byte-level token stands for one byte; a special token is its own text
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token.encode()) if i in special else len(token)

    def encode(text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    return JoinedMemo(encode, sizes)


def _block(part: int, block: int, first: int, doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
    lens = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    words, doc_words = pack(np.frombuffer(b"".join(parts), dtype=np.int32), lens)
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
        "first_id": pa.array([first], pa.int64()), "n_ids": pa.array([int(lens.sum())], pa.int32()),
        "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "doc_lens": pa.array([lens.tolist()], pa.list_(pa.int32())),
        "doc_words": pa.array([doc_words.tolist()], pa.list_(pa.int32())),
        "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
    })


def _groups(batches):
    """(ids, texts) of the rows in order, some ``GROUP_BYTES`` of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + GROUP_BYTES - size)) + 1, batch.num_rows)
            ids += batch.column(0).slice(at, to - at).to_pylist()
            texts.append(batch.column(1).slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= GROUP_BYTES:
                yield ids, pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def write_ids(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` and writes the file; gives back the written table."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoder(path)
        end = np.array([end_id], dtype=np.int32).tobytes()
        block = first = held = 0
        doc_ids, parts = [], []
        for ids_of, texts in _groups(batches):
            for doc_id, ids in zip(ids_of, encoder(texts), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_ids:
                    yield _block(part, block, first, doc_ids, parts)
                    block, first, held, doc_ids, parts = block + 1, first + held, 0, [], []
        if doc_ids:
            yield _block(part, block, first, doc_ids, parts)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(run, FILE_SCHEMA), "simple8b")


def read_ids(files: DataFrame) -> DataFrame:
    """The documents of the file in order: ``doc_id, start, n_tokens, ids``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["doc_lens"], dtype=np.int64)
                ids = unpack(np.frombuffer(row["words"], dtype="<u8"), lens, np.array(row["doc_words"], dtype=np.int64))
                ends = np.cumsum(lens)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(lens), row["part"], dtype=np.int32)),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(row["first_id"] + ends - lens), "n_tokens": pa.array(lens),
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))),
                })

    return _shifted(files, files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids array<long>"))


def checksums(files: DataFrame) -> DataFrame:
    """As ``read_ids``, with the crc32 of each document's ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["doc_lens"], dtype=np.int64)
                ids = unpack(np.frombuffer(row["words"], dtype="<u8"), lens, np.array(row["doc_words"], dtype=np.int64)).astype("<u4")
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(lens), row["part"], dtype=np.int32)),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["first_id"] + ends - lens),
                    "n_tokens": pa.array(lens), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return _shifted(files, files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"))


def _shifted(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the ids of all parts before; there is one row per part, as many as shuffle partitions."""
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy(F.col("part").alias("at")).agg(F.sum("n_ids").alias("n"))
    parts = parts.select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rest = [c for c in rows.columns if c not in ("part", "start")]
    return rows.join(F.broadcast(parts), rows["part"] == parts["at"]).withColumn("start", F.col("start") + F.col("shift")).select(
        rest[0], "start", *rest[1:])


def query(spark, sf_dir: str) -> DataFrame:
    return checksums(write_ids(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))
