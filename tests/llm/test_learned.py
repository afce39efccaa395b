"""The weak-label classifier on held-out labels, and top-k search against scoring everything."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.llm import bm25_wand, quality_cascade, weak_labels
from larder.llm.lattice_lm import words_of
from tests.llm.fixtures import edge, edge_rows, empty, save

ROOT = "/root/testdata/sf0.01"


def test_estimation_recovers_accuracies():
    rng = random.Random(1)
    true = [(0.9, 0.95), (0.6, 0.9), (0.8, 0.7), (0.95, 0.9), (0.7, 0.8), (0.85, 0.9), (0.6, 0.7)]
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        patterns["".join("2" if rng.random() < 0.2 else str(int((rng.random() < acc[good]) == good)) for acc in true)] += 1
    share, right, _ = weak_labels.estimate(patterns)
    assert abs(share - 0.7) < 0.03 and all(abs(a - b) < 0.05 for x, y in zip(true, right, strict=True) for a, b in zip(x, y, strict=True))


def test_classifier_on_labels(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    got = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    assert len(got) == docs.count()
    right = sum(got[i].kept == bool(q) for i, q in labels.items()) / len(labels)
    print("accuracy", right)
    assert right > 0.9
    assert weak_labels.classify(edge(spark)).count() == len(edge_rows()) and weak_labels.classify(empty(spark)).count() == 0


def test_profiles_measure_as_the_rules_do(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").union(edge(spark).select("doc_id", "text"))
    names = ["doc_id", *weak_labels.MEASURES]
    got = Counter(map(tuple, weak_labels.profiles(docs).select(*names).collect()))
    assert got == Counter(map(tuple, quality_cascade.measures(docs, F.col("text")).select(*names).collect()))


def test_shapes():
    want = {"word": "a0", "Word,": "a0,", "NASA": "A", "NASA.": "A.", "I": "a0", "a1b22": "a0a0", "x--y": "a0-+a0", "12": "0", "...": ".+", ",": ",", "漢字!": "a0!"}
    assert {w: weak_labels.shape(w) for w in want} == want


def brute(rows, top, terms):
    texts = [(i, Counter(words_of(t))) for i, t in rows]
    n, df = len(rows), Counter(w for _, c in texts for w in c)
    mean = sum(c.total() for _, c in texts) / n
    idf = lambda w: math.log1p((n - df[w] + .5) / (df[w] + .5))
    out = set()
    for q, c in texts:
        if q is None or q % 50:
            continue
        best = sorted(c, key=lambda w: (-c[w] * idf(w), w))[:terms]
        scored = []
        for d, x in texts:
            s = sum(idf(w) * x[w] * 2.2 / (x[w] + 1.2 * (.25 + .75 * x.total() / mean)) for w in best if x[w])
            if s > 0:
                scored.append((-round(s, 7), d is None, d))
        out |= {(q, d, k + 1, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top])}
    return out


def test_search_equals_scoring_all(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(.6)), 900)}" for _ in range(rng.randrange(3, 120)))) for i in range(1200)] + [(None, "w1 w7 w8"), (5000, None), (5050, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bm25_wand, "BLOCK", 16)
    got = {(r.query_id, r.doc_id, r.rank, round(r.score, 7)) for r in bm25_wand.search(docs, per_block=7).collect()}
    assert {(q, k, s) for q, _, k, s in got} == {(q, k, s) for q, _, k, s in brute(rows, 10, 12)}
    assert len(got ^ brute(rows, 10, 12)) <= 4  # ties within rounding may change places
    assert bm25_wand.search(empty(spark)).count() == 0 and bm25_wand.search(edge(spark)).count() >= 0


def test_query_asks_with_every_word(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]  # in every text, so each alone weighs next to nothing
    rows = [(50 * q, " ".join([f"q{q}x{i}" for i in range(12)] * 2 + rng.sample(common, 30) + [f"t{q}"])) for q in range(1, 5)]
    rows += [(1000 + i, " ".join(rng.sample(common, rng.randrange(5, 40)) + [f"t{i % 9}"] * (i % 3))) for i in range(1, 49)]
    rows += [(None, "c1 c2 t1"), (5000, None), (5050, "")]
    monkeypatch.setattr(bm25_wand, "BLOCK", 4)
    folder = save(spark, [(i, t, None, None, 0) for i, t in rows], tmp_path)
    got = {(r.query_id, r.doc_id, r.rank, round(r.score, 7)) for r in bm25_wand.query(spark, folder).collect()}
    want = brute(rows, 10, None)
    assert {(q, k, s) for q, _, k, s in brute(rows, 10, 12)} != {(q, k, s) for q, _, k, s in want}
    assert {(q, k, s) for q, _, k, s in got} == {(q, k, s) for q, _, k, s in want}
    assert len(got ^ want) <= 4  # ties within rounding may change places
    in_blocks = bm25_wand.search(spark.read.parquet(f"{folder}/documents.parquet"), terms=None, per_block=50).collect()
    assert {(r.query_id, r.doc_id, r.rank, round(r.score, 7)) for r in in_blocks} == got


def test_first_batches_are_pruned(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(.6)), 900)}" for _ in range(rng.randrange(3, 60)))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    merged, plain = [], bm25_wand.hits_of

    def hits_of(*args):
        merged.append(plain(*args))
        return merged[-1]

    monkeypatch.setattr(bm25_wand, "hits_of", hits_of)
    got = {(r.query_id, r.rank): r.score for r in bm25_wand.search(docs, terms=None).collect()}
    want = {(q, k): s for q, _, k, s in brute(rows, 10, None)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert merged[-1].count() < 0.75 * 16 * len(got)  # not the best ten of each of 16 tasks


def test_words_are_counted_once_a_batch():
    texts = ["B a\tb\x0b c ", None, "", " \n", "É é e b", "a"]
    words, numbers, texts_of, tf, lengths = bm25_wand.counted(pa.array(texts, pa.string()))
    want = {(w.decode(), i, c) for i, t in enumerate(texts) for w, c in Counter(words_of(t)).items()}
    assert {(words[w].as_py(), i, c) for w, i, c in zip(numbers.tolist(), texts_of.tolist(), tf.tolist(), strict=True)} == want
    assert lengths.tolist() == [4, 0, 0, 0, 3, 1] and bm25_wand.counted(pa.array([], pa.string()))[4].tolist() == []


def test_common_words_are_a_product_and_rare_ones_lists(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{min(int(rng.paretovariate(.6)), 900)}" for _ in range(rng.randrange(0, 90))) for _ in range(700)]
    queries = [np.array(sorted({min(int(rng.paretovariate(.5)), 900) - 1 for _ in range(rng.randrange(1, 40))})) for _ in range(150)]
    words, weights = pa.array([f"w{i + 1}" for i in range(900)]), np.array([1 + rng.random() for _ in range(900)])
    asked = np.bincount(np.concatenate(queries), minlength=900) / len(queries)
    least = [rng.choice([0.0, 3.0, 9.0, 1e9]) for _ in queries]
    monkeypatch.setattr(bm25_wand, "BLOCK", 16)
    found, dense = [], []
    for share, short in ((0.01, 8), (2.0, 0), (0.0, 8)):
        monkeypatch.setattr(bm25_wand, "DENSE", share)
        monkeypatch.setattr(bm25_wand, "SHORT", short)
        shard = bm25_wand.Shard(pa.array(texts), words, weights, 40.0, asked)
        dense.append(len(shard.dense))
        found.append([dict(hits) for hits in shard.search(queries, least, 10)])
    assert 0 < dense[0] < dense[2] and dense[1] == 0
    for q, low, *hits in zip(queries, least, *found, strict=True):
        scores = []
        for d, t in enumerate(texts):
            c = Counter(t.split())
            scores.append((d, sum(weights[w] * c[f"w{w + 1}"] * 2.2 / (c[f"w{w + 1}"] + 1.2 * (.25 + .75 * c.total() / 40)) for w in q.tolist())))
        floor = max(low, sorted((s for _, s in scores), reverse=True)[9] - 1e-7, 1e-12)
        want = {d: s for d, s in scores if s >= floor}
        assert all(h.keys() == want.keys() and all(abs(h[d] - want[d]) < 1e-6 for d in want) for h in hits)


def test_popular_words_stay_within_the_matrix(monkeypatch):
    monkeypatch.setattr(bm25_wand, "CELLS", 30)
    texts = pa.array(["a b c d e"] * 10)
    shard = bm25_wand.Shard(texts, pa.array(list("abcde")), np.ones(5), 5.0, np.ones(5))
    assert shard.dense.size == 30 and [len(h) for h in shard.search([np.arange(5)], [0.0], 10)] == [10]


def test_counting_words_takes_memory_by_the_slice(monkeypatch):
    texts = pa.array([" ".join(f"w{(i + k) % 40}" for k in range(3000)) for i in range(1200)])
    tracemalloc.start()
    words, numbers, texts_of, tf, lengths = bm25_wand.counted(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * texts.nbytes
    assert len(words) == 40 and len(numbers) == 40 * 1200 and tf.tolist() == [75] * 48_000 and set(lengths.tolist()) == {3000}
    texts, want = ["b a", "c b b", None, "", "a" * 30, "a c"], {("b", 0, 1), ("a", 0, 1), ("c", 1, 1), ("b", 1, 2), ("a" * 30, 4, 1), ("a", 5, 1), ("c", 5, 1)}
    for size in (1, 7, 100):
        monkeypatch.setattr(bm25_wand, "SLICE", size)
        words, numbers, texts_of, tf, lengths = bm25_wand.counted(pa.array(["x y", *texts]).slice(1))
        assert {(words[w].as_py(), i, c) for w, i, c in zip(numbers.tolist(), texts_of.tolist(), tf.tolist(), strict=True)} == want
        assert len(words) == 4 and lengths.tolist() == [2, 3, 0, 0, 1, 2]
