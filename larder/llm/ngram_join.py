"""N-gram Jaccard self-join with signature trees: groups of documents linked by shingle overlap.

1. Each text becomes its set of distinct shingles, as 64-bit hashes. Equal sets share one node.
2. Trees need small, complete neighbourhoods. Two sets that link differ in at most a ninth of the
   smaller one's shingles, so when shingles are dealt by hash into more parts than that, some part
   is equal in both. Below ``PARTS_FROM`` percent the parts would be too small to tell texts apart;
   there, the shingles come in one order, those of more texts later, and sets that link share one of their
   first ones (prefix filter). So texts that only share a passage with many others don't meet by it.
   Sets that share a part or a first shingle, directly or through others, form a neighbourhood: no
   link leaves one.
3. In a neighbourhood, a signature tree holds at each node the OR and AND of its token bitmaps and
   its range of sizes. Two trees are walked together; a pair of nodes is dropped when its greatest
   possible overlap cannot reach the threshold, or when all its documents are in one component
   already. Pairs that stay are compared exactly.
4. A neighbourhood above ``BLOCK`` documents or ``BLOCK_SHINGLES`` shingles is dealt into blocks that
   share a pivot. After the blocks, only documents outside the largest component meet the others
   again, those of like size only, chunk by chunk: a large group of near copies costs one pass, and
   no link is lost.

Links are exact up to collisions of 64-bit hashes. Edge cases: a null or empty text has an empty
set and is linked with nothing; with fewer words than a shingle has, the whole sequence is the one
shingle; a null id gets its set's size and no component; rows that share an id are one vertex in
``groups``, whatever sets they hold, and vertices of their own in ``leaders``; ties cannot arise,
since the smallest id names a group; an empty table gives an empty result; own columns don't
matter, since only id and text are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, drop, stored, worker_tool
from larder.llm.components import connected

BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
PARTS_FROM = 90
TABLE_BITS, PART_BITS = 27, 12  # 32 MB of marks of two bits, made in 4,096 parts by hash
COMMON = (2, 8, 64)  # from so many texts on a shingle comes later in the order
COUNT_BLOCK = 1 << 22
LEAF = 16
FANOUT = 8
WORD_MEMO = 100_000
SLICE = 512
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K1
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased words in runs of ``size``."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def _word(self, word: bytes) -> int:
        if len(self.memo) >= WORD_MEMO:
            self.memo.clear()
        known = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return known

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes know ASCII case and spaces only
        memo = self.memo
        hashes = np.fromiter((memo.get(w) or self._word(w) for w in words), dtype=np.uint64, count=len(words))
        if not len(hashes):
            return hashes
        run = min(self.size, len(hashes))
        x = np.full(len(hashes) - run + 1, run, dtype=np.uint64)
        for k in range(run):
            x = _mix(x + hashes[k:len(hashes) - run + 1 + k]) * K2
        return np.unique(x)


class Bands:
    """Which sizes share a dealing of shingles into parts, and into how many.

    For a threshold of p percent, sets that link differ in at most (100 - p) / p of the smaller
    one. A band of sizes is wider than the sizes may differ, so linked sets meet in the band of the
    larger one. With ``spare`` parts more than needed, parts of fewer than two shingles, which many
    sets share by chance, need not be used unless a set has more of them than that.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.least = math.ceil(percent / (100 - percent))  # smaller sets link only when equal
        self.edges = [self.least]

    def differ(self, size: int) -> int:
        return size * (100 - self.percent) // self.percent

    def band(self, size: int) -> int:
        ratio = 1.125 * 100 / self.percent
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + self.least, math.ceil(self.edges[-1] * ratio)))
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        need = self.differ(self.edges[band + 1] - 1) + 1
        spare = need // 12
        return need + spare, spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """One hash per usable part, in the set's own band and the next if a partner may be there."""
        n = len(s)
        if n < self.least:
            return np.zeros(0, dtype=np.uint64)
        own = self.band(n)
        self.band(self.edges[own + 1])
        bands = [own] + ([own + 1] if n * 100 >= self.percent * self.edges[own + 1] else [])
        mixed, place = _mix(s * K2), s >> np.uint64(7)
        out = []
        for band in bands:
            count, spare = self.parts(band)
            part = (place % np.uint64(count)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            held = np.bincount(part, minlength=count)
            sums = np.zeros(count, dtype=np.uint64)
            full = held > 0
            sums[full] = np.add.reduceat(mixed[order], (np.cumsum(held) - held)[full])
            weak = held < 2
            use = ~weak if int(weak.sum()) <= spare else np.ones(count, dtype=bool)
            index = np.flatnonzero(use).astype(np.uint64)
            out.append(_mix(_mix(sums[use] + index * K1) + np.uint64(band + 1) * K2))
        return np.concatenate(out)


def _tools(size: int, percent: int) -> tuple[Shingler, Bands]:
    shingles, bands = worker_tool(("shingles", size, percent), lambda: (Shingler(size), Bands(percent)))
    shingles.memo.clear()  # a task's words are soon hashed again; idle workers should hold none
    return shingles, bands


def _sliced(batches):
    """The rows in order, ``SLICE`` at a time, so that a task holds the sets of so many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _counted(batches, shingles: Shingler):
    """(part, low, many) rows: per part of the hash range its distinct shingles of a block of texts,
    40 bits each below the part's, and which of them occur in how many texts if not in one."""
    held, size = [], 0

    def block():
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        found, last = every[first], len(every)
        del every
        n = np.diff(np.append(first, last))
        del first
        edges = np.searchsorted(found, np.arange(1 << PART_BITS, dtype=np.uint64) << np.uint64(64 - PART_BITS))
        edges = np.append(edges, len(found)).tolist()
        found >>= np.uint64(24 - PART_BITS)
        found &= np.uint64((1 << 40) - 1)
        low = found.view(np.uint8).reshape(-1, 8)[:, :5]
        parts, lows, many = [], [], []
        for part, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if i < j:
                several = np.flatnonzero(n[i:j] > 1)
                parts.append(part)
                lows.append(low[i:j].tobytes())
                many.append(np.stack([several, n[i:j][several]]).astype(np.uint32).tobytes())
        return pa.RecordBatch.from_pydict({
            "part": pa.array(parts, pa.int32()), "low": pa.array(lows, pa.binary()), "many": pa.array(many, pa.binary())})

    for batch in batches:
        for text in batch.column(0):
            s = shingles(text.as_py())
            if len(s):
                held.append(s)
                size += len(s)
            if size >= COUNT_BLOCK:
                yield block()
                size = 0
    if held:
        yield block()


def _marked(batches):
    """Sorted (part, low, many) rows -> (part, marks): two bits per place of the part's range."""
    def marks(part, lows, many):
        total = sum(len(x) // 5 for x in lows)
        codes, n, at = np.zeros((total, 8), dtype=np.uint8), np.ones(total, dtype=np.int64), 0
        for low, extra in zip(lows, many, strict=True):
            rows = np.frombuffer(low, dtype=np.uint8).reshape(-1, 5)
            codes[at:at + len(rows), :5] = rows
            index, count = np.frombuffer(extra, dtype=np.uint32).reshape(2, -1)
            n[at + index.astype(np.int64)] = count
            at += len(rows)
        codes, back = np.unique(codes.view(np.uint64).reshape(-1), return_inverse=True)
        n = np.bincount(back, weights=n)
        place = (codes >> np.uint64(40 - (TABLE_BITS - PART_BITS))).astype(np.int64)
        level = np.zeros(1 << (TABLE_BITS - PART_BITS), dtype=np.uint8)
        for low_end in COMMON:
            level[place[n >= low_end]] += 1  # one step up per limit, however many shingles share a place
        level = level.reshape(-1, 4)
        packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "marks": pa.array([packed.tobytes()], pa.binary())})

    now, lows, many = None, [], []
    for batch in batches:
        for part, low, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and lows:
                yield marks(now, lows, many)
                lows, many = [], []
            now = part
            lows.append(low)
            many.append(extra)
    if lows:
        yield marks(now, lows, many)


def common_shingles(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """A table of fixed size that marks the shingles of several, many and very many texts.

    All texts are counted. Shingles travel packed, sorted and without repeats within a block. The
    table doesn't grow: a fuller one marks more shingles as common that are not, which then come
    late in the order; that costs time, never a link.
    """

    def count(batches):
        yield from _counted(batches, _tools(size, percent)[0])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("text").mapInArrow(count, "part int, low binary, many binary")
    marks = blocks.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_marked, "part int, marks binary")
    out = np.zeros((1 << PART_BITS, 1 << (TABLE_BITS - PART_BITS - 2)), dtype=np.uint8)
    for row in marks.toLocalIterator():  # the table's own size in all, one part a row
        out[row["part"]] = np.frombuffer(row["marks"], dtype=np.uint8)
    return out.reshape(-1)


def first_shingles(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first of the set in the order: as many as a linked set can lack, and one more."""
    take = len(s) - (percent * len(s) + 99) // 100 + 1
    place = (s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    level = (common[place >> 2] >> ((place & 3) << 1).astype(np.uint8)) & 3
    first = np.argsort(level, kind="stable")[:take]
    # what only one text has meets nothing: it fills its place in the order and need not be sent
    return s[first[level[first] > 0]]


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, text) -> ``doc_id, h, n_shingles, d1, d2, sigs``; d1 and d2 identify the set, h the text."""
    common = None
    if percent < PARTS_FROM:
        common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size, percent))

    def run(batches):
        shingles, bands = _tools(size, percent)
        for batch in _sliced(batches):
            n, d1, d2, sigs = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                first, second = digest(s)
                n.append(len(s))
                d1.append(first)
                d2.append(second)
                sigs.append(bands.signatures(s) if common is None else first_shingles(s, common.value, percent) if len(s) else s)
            ends = np.cumsum([0] + [len(x) for x in sigs]).astype(np.int32)
            flat = np.concatenate([*sigs, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "h", "n_shingles", "d1", "d2", "sigs"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        run, "doc_id long, h long, n_shingles long, d1 long, d2 long, sigs array<long>")


def neighbourhoods(nodes: DataFrame) -> DataFrame:
    """(node, sigs) -> (node, hood) for nodes that share a part with another."""
    rows = nodes.select("node", F.explode("sigs").alias("sig"))
    shared = rows.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    edges = rows.join(shared, "sig").filter("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return connected(edges).select("node", F.col("root").alias("hood"))


class Forest:
    """Components of the documents in one task, by index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(y)] = self.find(x)


class Node:
    def __init__(self, docs, either, both, low, high, children=()):
        self.docs, self.either, self.both, self.low, self.high, self.children = docs, either, both, low, high, children


def tree(members: list[int], sets: list[np.ndarray], bitmaps: np.ndarray) -> Node:
    """A signature tree over ``members``; neighbours in order of least hash and size share leaves."""
    members = sorted(members, key=lambda i: (int(sets[i][0]), len(sets[i])))
    level = []
    for at in range(0, len(members), LEAF):
        part = members[at:at + LEAF]
        rows = bitmaps[part]
        sizes = [len(sets[i]) for i in part]
        level.append(Node(part, np.bitwise_or.reduce(rows), np.bitwise_and.reduce(rows), min(sizes), max(sizes)))
    while len(level) > 1:
        level = [
            Node([d for c in group for d in c.docs], np.bitwise_or.reduce([c.either for c in group]),
                 np.bitwise_and.reduce([c.both for c in group]), min(c.low for c in group), max(c.high for c in group), group)
            for group in (level[at:at + FANOUT] for at in range(0, len(level), FANOUT))
        ]
    return level[0]


def bitmaps_of(sets: list[np.ndarray]) -> np.ndarray:
    """Token bitmaps, about two bits per token of the largest set."""
    bits = 1 << max(7, min(14, (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits), dtype=np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[(s >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def walk(left: Node, right: Node, sets: list[np.ndarray], bitmaps: np.ndarray, forest: Forest, percent: int) -> list[tuple[int, int]]:
    """Links between the documents of two trees that join components."""
    links, stack, ratio = [], [(left, right)], percent / (100 + percent)
    while stack:
        a, b = stack.pop()
        # of each document of ``a``, its bits that no document of ``b`` has are lost tokens
        most = min(a.high - int(np.bitwise_count(a.both & ~b.either).sum()), b.high - int(np.bitwise_count(b.both & ~a.either).sum()))
        if most < ratio * (a.low + b.low) - 1e-9 or 100 * min(a.high, b.high) < percent * max(a.low, b.low):
            continue
        roots = {forest.find(d) for d in a.docs}
        if len(roots) == 1 and all(forest.find(d) in roots for d in b.docs):
            continue
        if a.children or b.children:
            if a is b:
                kids = a.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif a.children and (not b.children or len(a.docs) >= len(b.docs)):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
            continue
        rows, cols = bitmaps[a.docs], bitmaps[b.docs]
        n, m = np.array([len(sets[d]) for d in a.docs])[:, None], np.array([len(sets[d]) for d in b.docs])[None, :]
        bound = np.minimum(
            n - np.bitwise_count(rows[:, None] & ~cols[None]).sum(axis=2, dtype=np.int64),
            m - np.bitwise_count(cols[None] & ~rows[:, None]).sum(axis=2, dtype=np.int64))
        for i, j in zip(*np.nonzero(bound >= ratio * (n + m) - 1e-9), strict=True):
            x, y = a.docs[i], b.docs[j]
            if (a is b and j <= i) or forest.find(x) == forest.find(y):
                continue
            both = overlap(sets[x], sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                forest.join(x, y)
                links.append((x, y))
    return links


def linked(sets: list[np.ndarray], percent: int, groups: list[int] | None = None, sides: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links among ``sets`` that join components; ``groups`` are known ones. With ``sides``, only
    pairs of a True and a False member are looked at."""
    forest = Forest(len(sets))
    if groups is not None:
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            forest.join(first.setdefault(g, i), i)
    bitmaps = bitmaps_of(sets)
    if sides is None:
        top = tree(list(range(len(sets))), sets, bitmaps)
        return walk(top, top, sets, bitmaps, forest, percent)
    ours, theirs = ([i for i, s in enumerate(sides) if s is want] for want in (True, False))
    if not ours or not theirs:
        return []
    return walk(tree(ours, sets, bitmaps), tree(theirs, sets, bitmaps), sets, bitmaps, forest, percent)


def _tasks(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Rows of (*keys, node, tokens, known, side), one task per key -> links (a, b).

    Rows arrive sorted by key and are handled run by run, so that a task holds one group.
    """

    def links(held):
        nodes, tokens, known, sides = zip(*held, strict=True)
        sets = [np.frombuffer(t, dtype=np.uint64) for t in tokens]
        cross = sides[0] is not None
        found = linked(sets, percent, list(known) if cross else None, list(sides) if cross else None)
        return pa.RecordBatch.from_pydict({
            "a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    def run(batches):
        held, now = [], None
        for batch in _sliced(batches):
            # tokens stay where Arrow has them
            columns = [[t.as_buffer() for t in batch.column(c)] if c == "tokens" else batch.column(c).to_pylist() for c in ("node", "tokens", "known", "side")]
            keyed = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for key, row in zip(keyed, zip(*columns, strict=True), strict=True):
                if key != now and held:
                    if len(held) > 1:
                        yield links(held)
                    held = []
                now = key
                held.append(row)
        if len(held) > 1:
            yield links(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "node", "tokens", "known", "side").repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def token_sets(docs: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """The wanted (node, least, d1, d2, ...) rows with ``tokens``, the node's shingles as bytes.

    ``least`` is the id that holds the set. Rows of that id with another set are left out.
    """
    extra = [c for c in wanted.columns if c not in ("node", "least", "d1", "d2")]

    def run(batches):
        shingles, _ = _tools(size, percent)
        for batch in _sliced(batches):
            sets = [shingles(t.as_py()) for t in batch.column(3)]
            same = [digest(s) == d for s, d in zip(sets, zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True), strict=True)]
            mine = batch.filter(pa.array(same))
            tokens = pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())
            yield pa.RecordBatch.from_arrays([mine.column(0), tokens, *mine.columns[4:]], names=["node", "tokens", *extra])

    rows = docs.select(F.col("doc_id").cast("long").alias("least"), "text").join(wanted, "least")
    schema = wanted.select("node", F.lit(None).cast("binary").alias("tokens"), *extra).schema
    return rows.select("node", "d1", "d2", "text", *extra).mapInArrow(run, schema)


def _one_of_equal(docs: DataFrame) -> DataFrame:
    """One of the rows that are equal in id and text."""
    return docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("doc_id", "text")


def linked_sets(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of every row, the distinct sets (``d1, d2, node, least``) and links (a, b) among
    their nodes. ``least`` is the smallest id that holds the set; nodes are numbers of their own, so
    sets that share an id are told apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(sketches(docs, size, percent), "shingles")
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    held = usable.groupBy("d1", "d2", "doc_id").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
    sets = held.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "copies")).alias("of"), F.first("n_shingles").alias("n_shingles"))
    sets = sets.select("d1", "d2", F.col("of.doc_id").alias("least"), F.col("of.copies").alias("copies"), "n_shingles",
                       F.monotonically_increasing_id().alias("node"))
    sets = stored(sets, "sets")
    if (sets.agg(F.max("copies")).first()[0] or 0) > 1:
        docs = _one_of_equal(docs)
    known = sets.select("d1", "d2", "node", F.col("least").alias("doc_id"))
    hoods = stored(neighbourhoods(usable.join(known, ["d1", "d2", "doc_id"]).select("node", "sigs")), "hoods")

    sized = hoods.join(sets.select("node", "least", "d1", "d2", "n_shingles"), "node")
    load = sized.groupBy("hood").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    load = load.select("hood", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("load") / BLOCK_SHINGLES)).alias("blocks"))
    placed = sized.join(load, "hood")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the hood's own node, its least one, is the pivot in every block
    at = F.when(F.col("node") == F.col("hood"), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(own))
    # linked sets differ in size by less than one step
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100.5 / percent)).cast("int").alias("step")
    dealt = placed.select("node", "least", "d1", "d2", "hood", "blocks", step, own.alias("own"), F.explode(at).alias("block"))
    rows = stored(token_sets(docs, dealt, size, percent), "tokens")
    none = {"known": F.lit(None).cast("long"), "side": F.lit(None).cast("boolean")}
    links = stored(_tasks(rows.withColumns(none), ["hood", "block"], percent), "links")
    links = links.union(_across(rows, links, percent))
    drop(rows)
    drop(hoods)
    return sketch, sets, links


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(d1, d2, node, root): the component of every set."""
    roots = connected(links)
    return sets.join(roots, "node", "left").select("d1", "d2", "node", "least", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    sketch, sets, links = linked_sets(docs, size, percent)
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    several = usable.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi"))
    several = several.filter("lo <> hi").select("doc_id")
    tied = usable.join(several, "doc_id", "left_semi").distinct().join(sets.select("d1", "d2", "node"), ["d1", "d2"])
    first = tied.groupBy("doc_id").agg(F.min("node").alias("b"))
    same_id = tied.join(first, "doc_id").select(F.col("node").alias("a"), "b")
    members = _labelled(sets, links.union(same_id))
    named = members.groupBy("root").agg(F.min("least").alias("component"))
    final = members.join(named, "root").select("d1", "d2", "component")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    empty = F.col("n_shingles") == 0
    return sketch.join(final, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(component).alias("component_id"))


def leaders(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, h`` of one row per component of texts, that of the smallest id: h is ``xxhash64`` of its
    text. Rows with a null id or an empty set have no component and are not named."""
    sketch, sets, links = linked_sets(docs, size, percent)
    members = _labelled(sets, links)
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    best = usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    return best.join(members, ["d1", "d2"]).groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.h")


def _across(rows: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of one neighbourhood: documents outside its largest component against
    all others of like size. Outsiders are dealt into chunks by step of size; a chunk meets only the
    members of its own and the neighbouring steps, block by block."""
    many = rows.filter("blocks > 1 AND block = own")
    if many.isEmpty():
        return links.limit(0)
    known = many.select("node", "hood", "blocks", "own", "step").join(connected(links), "node", "left")
    known = stored(known.withColumn("known", F.coalesce("root", "node")).drop("root"), "known")
    counts = known.groupBy("hood", "known").agg(F.count("*").alias("n"))
    main = counts.groupBy("hood").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    outside = known.join(main, "hood").filter("known <> main")
    chunks = outside.groupBy("hood", F.col("step").alias("at")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    near = known.withColumn("at", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    blocks = near.join(chunks, ["hood", "at"]).select("node", "hood", "at", "known", F.col("own").alias("block"), every, F.lit(False).alias("side"))
    one = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("chunks")).cast("int").alias("chunk")
    apart = outside.withColumn("at", F.col("step")).join(chunks, ["hood", "at"]).select(
        "node", "hood", "at", "known", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), one, F.lit(True).alias("side"))
    wanted = blocks.union(apart.select(blocks.columns))
    tasks = wanted.join(many.select("node", "tokens"), "node")
    return stored(_tasks(tasks, ["hood", "at", "block", "chunk"], percent), "links")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
