"""Phrase collocations by dynamic itemset counting.

The documents fall by hash into ``SHARDS`` shards, stored apart once, that are scanned in a cycle, one a step. Words are
counted from the first step on. A phrase of two words is activated once both words have reached the
threshold, one of three once both its two-word parts have. A phrase is counted from the step after
that, through one full cycle, so that lengths interleave and each shard counts once for it.

1. When a phrase is activated is kept in two tables of 2^``SLOT_BITS`` bytes, one for words and one for
   pairs: the first step that counts what holds them, at a place given by their hash. A phrase
   starts at the later step of its two parts, whether or not the parts themselves are counted yet, so
   that its start never changes once it is known. Two parts in one place can only start a phrase
   early; it is still counted for exactly one cycle. The tables never grow with the data.
2. A task counts the active phrases of its rows in blocks of about ``BLOCK_WORDS`` words at most. Counts
   are written by step, with the phrase's start.
3. Sums of counts over one in a block show early which phrases have reached the threshold. When a
   start has been through its cycle, its phrases' counts are summed; then they are complete, and
   what has reached the threshold and was not yet known to is activated. Steps that no phrase waits
   for are not taken. Words are complete after one cycle, the last phrases of three words after three.

All phrases are counted as text, so hashes change no result. Scores are computed in decimals of 38
digits, enough for counts up to 10^16.

Edge cases: a null text is empty, a null language is ``und`` and shares the rows of that name;
repeated rows count as often as they occur; a very long text is cut into blocks of words but never
into pieces; ties in the cut go to the smallest first part and ties in rank to the count and then
the phrase; an empty table gives an empty result; own columns don't matter, since only language and
text are read.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import documents, drop, stored, work_folder, worker_tool

SHARDS = 4
THRESHOLD = 10
TOP = 2000
SLOT_BITS, CHUNK_BITS = 24, 15  # 16 MB a table; bitmaps of Spark's size bring its changes
NEVER = 255
BLOCK_WORDS, BLOCK_BYTES = 3_000_000, 1 << 26
BATCH_ROWS = 1 << 17
BREAK = b"\xff"  # in no text's UTF-8: stands between pieces
# letters in lower case, ends of pieces as breaks, tabs as blanks
CLEAN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\t", bytes(range(97, 123)) + BREAK * 10 + b" ")
K = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "lang string, phrase string, words int, start int, n long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K
    return x ^ (x >> np.uint64(29))


def _place(x: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(x) >> np.uint64(64 - bits)).astype(np.int64)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * K + second)


@lru_cache(maxsize=64)
def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, _seed(lang))


def tokens_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Words with ASCII letters in lower case, and ``BREAK`` where a piece ends: their bytes one after
    the other, and where each begins."""
    raw = np.frombuffer((text or "").encode().translate(CLEAN) + BREAK, dtype=np.uint8)
    full, ends = raw != 32, raw == BREAK[0]
    first = full.copy()
    first[1:] &= ~full[:-1] | ends[:-1] | ends[1:]
    return raw[full], np.flatnonzero(first[full])


class Block:
    """The words of one language that a task has read since the last counts it gave."""

    def __init__(self, lang: str):
        self.lang, self.size, self.bytes = lang, 0, 1
        self.data, self.starts = [np.frombuffer(BREAK, dtype=np.uint8)], [np.zeros(1, dtype=np.int64)]  # the break is number 0

    def add(self, text: str | None) -> tuple[int, int]:
        """Takes in a text; how many words and breaks that is, and how many bytes."""
        if not text:
            return 0, 0
        data, starts = tokens_of(text)
        self.data.append(data)
        self.starts.append(starts + self.bytes)
        self.size += len(starts)
        self.bytes += len(data)
        return len(starts), len(data)

    def _numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """The words as numbers, and the words that these stand for."""
        offsets = np.concatenate([*self.starts, [self.bytes]]).astype(np.int32)
        data = np.concatenate(self.data)
        self.data.clear()
        self.starts.clear()
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_pylist()

    def counts(self, step: int, shards: int, tables: tuple, longest: int):
        """Batches of (COUNTED) for the phrases that this step counts."""
        words_at, pairs_at, bits = tables
        ids, names = self._numbered()
        seed, digest = _seed(self.lang), xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w, seed) for w in names), np.uint64, len(names))
        names[0] = b""
        text = pa.array(names, pa.binary()).cast(pa.string())
        if step < shards:
            n = np.bincount(ids, minlength=len(names))
            found = 1 + np.flatnonzero(n[1:])
            yield from self._batches([found], n[found], 0, text)
        start = words_at[_place(hashes, bits)]
        start[0] = NEVER
        a, b = ids[:-1], ids[1:]
        yield from self._counted([a, b], np.maximum(start[a], start[b]), step, shards, text)
        if longest > 2 and len(ids) > 2:
            pair_at = np.full(len(a), NEVER, dtype=np.uint8)
            for at in range(0, len(a), BATCH_ROWS):
                x, y = a[at:at + BATCH_ROWS], b[at:at + BATCH_ROWS]
                pair_at[at:at + BATCH_ROWS] = np.where((x != 0) & (y != 0), pairs_at[_place(_pair(hashes[x], hashes[y]), bits)], NEVER)
            yield from self._counted([ids[:-2], ids[1:-1], ids[2:]], np.maximum(pair_at[:-1], pair_at[1:]), step, shards, text)

    def _counted(self, columns: list, begins: np.ndarray, step: int, shards: int, text: pa.Array):
        for start in range(max(0, step - shards + 1), step + 1):
            mine = np.flatnonzero(begins == start)
            if not len(mine):
                continue
            bits = len(text).bit_length()
            if bits * len(columns) < 64:
                code = columns[0][mine].astype(np.int64)
                for c in columns[1:]:
                    code <<= bits
                    code |= c[mine]
                del mine
                code, n = np.unique(code, return_counts=True)
                parts = [(code >> (bits * k)) & ((1 << bits) - 1) for k in range(len(columns) - 1, -1, -1)]
            else:
                parts, n = np.unique(np.stack([c[mine] for c in columns]), axis=1, return_counts=True)
            yield from self._batches(parts, n, start, text)

    def _batches(self, parts, n: np.ndarray, start: int, text: pa.Array):
        for at in range(0, len(n), BATCH_ROWS):
            many = n[at:at + BATCH_ROWS]
            words = [text.take(pa.array(p[at:at + BATCH_ROWS])) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(self.lang), len(many)), words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " "),
                 pa.repeat(pa.scalar(len(words), pa.int32()), len(many)), pa.repeat(pa.scalar(start, pa.int32()), len(many)),
                 pa.array(many, pa.int64())],
                names=["lang", "phrase", "words", "start", "n"])


def _unpacked(shared) -> tuple[np.ndarray, np.ndarray, int]:
    """A step's tables, unpacked once in a worker."""
    key, words, pairs, bits = shared.value
    return worker_tool(("phrases", key), lambda: (*(np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (words, pairs)), bits))


class Activation:
    """The driver's part: the two tables, and which phrases' cycles are still to be completed."""

    def __init__(self, spark, bits: int):
        self.spark, self.bits = spark, bits
        self.tables = {words: np.full(1 << max(bits, CHUNK_BITS), NEVER, dtype=np.uint8) for words in (1, 2)}

    def shared(self):
        """The tables for a step's tasks; mostly one value, they pack to little."""
        return self.spark.sparkContext.broadcast((uuid.uuid4().hex, zlib.compress(self.tables[1], 1), zlib.compress(self.tables[2], 1), self.bits))

    def add(self, phrases: DataFrame, words: int, start: int) -> bool:
        """Marks the places of ``phrases`` (lang, phrase) that are new; whether there are any."""
        bits = self.bits

        def run(batches):
            for batch in batches:
                langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                hashes = [[word_hash(lang, w) for w in text.encode().split(b" ")] for lang, text in zip(langs, texts, strict=True)]
                x = np.array(hashes, dtype=np.uint64).reshape(-1, words)
                yield pa.RecordBatch.from_pydict({"place": pa.array(_place(x[:, 0] if words == 1 else _pair(x[:, 0], x[:, 1]), bits))})

        places = phrases.select("lang", "phrase").mapInArrow(run, "place long")
        at = F.col("place") + 1  # buckets of these functions start at one
        chunks = places.groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        table, new = self.tables[words].reshape(-1, 1 << CHUNK_BITS), False
        for row in chunks.toLocalIterator():  # at most 2 MB in all
            marked = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little").astype(bool)
            fresh = marked & (table[row["chunk"] - 1] == NEVER)
            table[row["chunk"] - 1][fresh] = start
            new = new or bool(fresh.any())
        return new


def _sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` (lang, text) with the ``shard`` of each row, stored so that one is read without the others."""
    spark = docs.sparkSession
    path = f"{work_folder(spark)}/phrase-docs-{uuid.uuid4().hex}"
    docs.withColumn("shard", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    table = spark.read.schema("lang string, text string, shard int").parquet(path)
    table._stored_at = path
    return table


def _scan(rows: DataFrame, step: int, shards: int, tables, longest: int, block_words: int) -> DataFrame:
    """The counts of one step, block by block."""

    def run(batches):
        blocks: dict[str, Block] = {}

        held = held_bytes = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = blocks.get(lang)
                if block is None:
                    block = blocks[lang] = Block(lang)
                words, size = block.add(text.as_py())
                held, held_bytes = held + words, held_bytes + size
                if held >= block_words or held_bytes >= BLOCK_BYTES:  # the largest goes first, so that the others gather more
                    block = blocks.pop(max(blocks, key=lambda x: blocks[x].bytes))
                    held, held_bytes = held - block.size, held_bytes - block.bytes + 1
                    yield from block.counts(step, shards, _unpacked(tables), longest)
        for block in blocks.values():
            if block.size:
                yield from block.counts(step, shards, _unpacked(tables), longest)

    return rows.mapInArrow(run, COUNTED)


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, longest: int = 3,
                  lang_col: str = "lang", text_col: str = "text", block_words: int = BLOCK_WORDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) for phrases of 1 to ``longest`` (2 or 3) words that occur
    ``threshold`` times or more, and (lang, n) with the number of all words."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = _sharded(docs, shards)
    # a step reads a shard's rows only: fewer, fuller tasks find more equal phrases before the shuffle
    tasks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    active = Activation(spark, slot_bits)
    steps: dict[int, DataFrame] = {}
    seen: dict[tuple[int, int], DataFrame] = {}  # by length and step: sums of the counts over one
    starts = {1: {0}, 2: set(), 3: set()}  # by length: the steps at which phrases of that length start
    complete: list[DataFrame] = []
    totals = None
    step = 0
    while any(s + shards > step for group in starts.values() for s in group):
        rows = docs.filter(F.col("shard") == step % shards).select("lang", "text").coalesce(tasks)
        tables = active.shared()
        steps[step] = stored(_scan(rows, step, shards, tables, longest, block_words), f"phrases-{step}")
        tables.destroy()
        ended = step - shards + 1  # phrases that started there have seen every shard
        new = []
        for words in range(1, longest + 1):
            if ended in starts[words]:
                held = [steps[s] for s in range(ended, step + 1)]
                mine = held[0]
                for more in held[1:]:
                    mine = mine.union(more)
                mine = mine.filter((F.col("words") == words) & (F.col("start") == ended))
                if words == 1:
                    totals = stored(mine.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
                sums = mine.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold)
                sums = stored(sums.withColumn("words", F.lit(words)), "phrases-frequent")
                complete.append(sums)
                if words < longest and active.add(sums, words, step + 1):
                    new.append(words + 1)
            if words < longest and any(s <= step < s + shards - 1 for s in starts[words]):
                # a lower bound of what has been counted so far, from what this step and those before it found often
                often = steps[step].filter((F.col("words") == words) & (F.col("n") > 1)).select("lang", "phrase", "n")
                if (words, step - 1) in seen:
                    often = often.union(seen[words, step - 1])
                seen[words, step] = stored(often.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrases-often")
                if active.add(seen[words, step].filter(F.col("n") >= threshold), words, step + 1):
                    new.append(words + 1)
        for words in new:
            starts[words].add(step + 1)
        if ended in steps:  # no later start needs what that step counted
            drop(steps.pop(ended))
        step += 1
    drop(docs)
    counts = complete[0]
    for more in complete[1:]:
        counts = counts.union(more)
    return counts, totals


def score(a, left, right):
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    wide = [x.cast("decimal(38,0)") for x in (a, left, right)]
    square = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(38,0)")
    product = (wide[1] * wide[2]).cast("decimal(38,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), product)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, inside_percent: int = 50, **options) -> DataFrame:
    """Per language the ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    counts, totals = phrase_counts(docs, threshold, **options)
    counts = stored(counts, "phrase-counts")
    known = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    cuts = counts.filter("words > 1").select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    words_of = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.array_join(F.slice(words_of, F.lit(1), F.col("k")), " ")).withColumn(
        "rest", F.array_join(F.slice(words_of, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known, (F.col("lang") == F.col("of")) & (F.col(part) == F.col("part"))).withColumn(name, F.col("part_n")).drop(*known.columns)
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "words").agg(F.first("a").alias("a"), lowest)

    longer = counts.filter("words = 3").select(
        F.col("lang").alias("of"), F.col("n").alias("longer_n"),
        F.explode(F.array(F.array_join(F.slice(words_of, 1, 2), " "), F.array_join(F.slice(words_of, 2, 2), " "))).alias("part"))
    longer = longer.groupBy("of", "part").agg(F.max("longer_n").alias("longer_n"))
    held = (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (F.col("words") == 2)
    free = scored.join(longer, held, "left").filter(
        F.col("longer_n").isNull() | (100 * F.col("longer_n") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    best = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
tokens AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM tokens
  UNION ALL
  SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM tokens
  UNION ALL
  SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM tokens),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
cuts AS (
  SELECT lang, words, phrase, f AS a, k, string_split(phrase, ' ') AS w
  FROM counts, range(1, 3) AS t(k) WHERE words > k AND f >= 10),
parts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM cuts),
scored AS (
  SELECT p.lang, p.words, p.phrase, p.a, p.k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * p.a * p.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts p
  JOIN counts x ON x.lang = p.lang AND x.phrase = p.first_part AND x.words = p.k
  JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest AND y.words = p.words - p.k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, words ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part, a
    FROM cuts WHERE words = 3 AND k = 1) GROUP BY ALL),
free AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase AND s.words = 2
  WHERE g.a IS NULL OR 100 * g.a < 50 * s.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""
