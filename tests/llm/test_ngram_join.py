"""The n-gram join against all pairs by brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from larder.llm import ngram_join
from larder.llm.components import connected
from tests.llm.fixtures import edge_rows, empty, save

ROOT = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, percent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                up[find(i)] = find(j)
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((str(d), len(s), str(least.get(find(i)) if d is not None else None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def near(rng, n, words=60, edits=3, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w[:len(w) - rng.randrange(3)]))
    return out


def answer(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("case", ["given", "edge"])
def test_query(spark, case, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()] if case == "given" else [r[:2] for r in edge_rows()]
    folder = save(spark, [(*r, None, None, 0) for r in rows], tmp_path)
    assert answer(ngram_join.query(spark, folder)) == brute(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_near_copies_of_all_sizes(spark, percent):
    rng = random.Random(percent)
    texts = [t for words in (4, 9, 10, 11, 12, 14, 20, 28, 40, 90, 200, 400) for _ in range(3) for t in near(rng, 6, words, 1 + words // 25)]
    rows = list(enumerate(texts + ["a b", "a B", "a", "A", "", None]))
    rng.shuffle(rows)
    assert answer(ngram_join.groups(table(spark, rows), 3, percent)) == brute(rows, percent)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    rng = random.Random(5)
    rows = list(enumerate(near(rng, 150, 80, 9) + near(rng, 80, 50, 4)))
    assert answer(ngram_join.groups(table(spark, rows))) == brute(rows)


def test_ids_with_several_rows(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, None), (4, None), (4, ""), (5, a + " end"), (5, a + " end"), (None, a), (6, None), (6, a)]
    assert answer(ngram_join.groups(table(spark, rows))) == brute(rows)
    kept = ngram_join.leaders(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


def passages(rng, n, shared):
    """Texts that each hold one of a few passages between words of their own, and near copies of some."""
    out = []
    for i in range(n):
        own = [f"o{rng.randrange(10**7)}" for _ in range(rng.randrange(20, 140))]
        out.append(own + list(shared[i % len(shared)]) + own[::-1][:10])
        if i % 3 == 0:
            copy = list(out[-1])
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**7)}"
            out.append(copy)
    return [" ".join(w) for w in out]


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(8)
    shared = [[f"p{k}x{i}" for i in range(60)] for k in range(3)]
    texts = passages(rng, 240, shared) + near(rng, 60, 70, 12) + near(rng, 50, 90, 20)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert answer(ngram_join.groups(table(spark, rows), 5, 80)) == brute(rows, 80, 5)


def test_common_shingles_come_last():
    shingles = ngram_join.Shingler(2)
    texts = [f"own{i} common words here" for i in range(100)] + [f"pair{i // 2} of texts" for i in range(20)]
    batch = [ngram_join.pa.RecordBatch.from_pydict({"t": texts[k::3]}) for k in range(3)]
    rows = [r for b in batch for r in ngram_join.pa.Table.from_batches(list(ngram_join._counted([b], shingles))).to_pylist()]
    rows.sort(key=lambda r: r["part"])
    blocks = [ngram_join.pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in ("part", "low", "many")})]
    table = np.zeros((1 << ngram_join.PART_BITS, 1 << (ngram_join.TABLE_BITS - ngram_join.PART_BITS - 2)), dtype=np.uint8)
    for out in ngram_join._marked(blocks):
        for r in out.to_pylist():
            table[r["part"]] = np.frombuffer(r["marks"], dtype=np.uint8)
    table = table.reshape(-1)

    def level(text):
        place = (shingles(text) >> np.uint64(64 - ngram_join.TABLE_BITS)).astype(np.int64)
        return ((table[place >> 2] >> ((place & 3) << 1).astype(np.uint8)) & 3).tolist()

    assert level("common words") == [3] and level("words here") == [3] and level("own3 common") == [0]
    assert level("pair3 of") == [1] and level("of texts") == [2] and level("never seen") == [0]


def test_tree_walk_finds_all_components():
    rng = random.Random(1)
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], dtype=np.uint64)) for g in range(40) for t in near(rng, 8, 50, 3, 60)]
    forest, want = ngram_join.Forest(len(sets)), ngram_join.Forest(len(sets))
    for i, j in ngram_join.linked(sets, 90):
        forest.join(i, j)
    for i in range(len(sets)):
        for j in range(i):
            both = ngram_join.overlap(sets[i], sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    assert all((forest.find(i) == forest.find(j)) == (want.find(i) == want.find(j)) for i, j in pairs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, n) for n in range(2, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b) and got[260] == 200 and got[49] == 1
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert ngram_join.groups(empty(spark)).count() == 0


def test_shingles_are_counted_in_little_memory():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 1000, 1200).tolist())) for _ in range(300)]
    shingles, batch = ngram_join.Shingler(5), ngram_join.pa.RecordBatch.from_pydict({"t": texts})
    size = sum(shingles(t).nbytes for t in texts)
    tracemalloc.start()
    rows = [r for out in ngram_join._counted([batch], shingles) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.6 * size
    assert sum(len(r["low"]) // 5 for r in rows) == len(np.unique(np.concatenate([shingles(t) for t in texts])))


def test_batches_go_by_the_slice(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 3)
    batches = [ngram_join.pa.RecordBatch.from_pydict({"t": list(range(n))}) for n in (7, 0, 3)]
    assert [b.column(0).to_pylist() for b in ngram_join._sliced(batches)] == [[0, 1, 2], [3, 4, 5], [6], [0, 1, 2]]
