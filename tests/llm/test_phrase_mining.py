"""Phrase mining by dynamic itemset counting against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import phrase_mining
from tests.llm.fixtures import edge, edge_rows, empty, save


def brute(rows, threshold=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= threshold]
        kept = []
        for p in found:
            a = f[p]
            if any(len(q) > len(p) and 100 * f[q] >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q in found):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def made(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def babble(seed, n, words=12):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["É", "A", "Don't"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(names) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "fr", None]), text + rng.choice(["", "New York city", "a rare pair"])))
    return rows


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 3, "block_words": 50}, {"threshold": 3, "shards": 5, "top": 7}])
def test_like_plain_counting(spark, options):
    rows = babble(1, 400)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, options.get("threshold", 10), options.get("top", 2000))
    assert len(want) > 20 and made(phrase_mining.collocations(docs, **options)) == want


def test_few_places_for_all(spark):
    """With two places for all phrases most start early, and counts stay right."""
    rows = babble(2, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert made(phrase_mining.collocations(docs, threshold=4, slot_bits=1, shards=3)) == brute(rows, 4)


def test_shared_places_lose_no_count(spark):
    """Pairs whose places early pairs took before their own words were frequent; their longer phrases are counted whole."""
    rng, bits = random.Random(3), 8
    place = lambda w: int(phrase_mining._place(np.array([phrase_mining.word_hash("en", w.encode())], dtype=np.uint64), bits)[0])
    early = [f"w{i}" for i in range(30)]
    taken = {place(w) for w in early}
    late = [w for w in (f"z{i}" for i in range(300)) if place(w) not in taken][:60]
    rows = [("en", " ".join(rng.choice(early) for _ in range(100))) for _ in range(300)]
    rows += [("en", f"{' '.join(late[k:k + 3])} . x{k}y{n}") for k in range(0, 60, 3) for n in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert made(phrase_mining.collocations(docs, threshold=4, slot_bits=bits)) == brute(rows, 4)


def test_late_words_are_caught(spark):
    """Words that reach the threshold with the last shard only, and phrases that do so later still."""
    rows = [("en", f"alpha{i} beta{i} gamma{i}") for i in range(6) for _ in range(10)]
    rows = [(lang, f"{text} . x{n}") for n, (lang, text) in enumerate(rows)]  # each row in a shard of its own
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert made(phrase_mining.collocations(docs, shards=7)) == brute(rows) and len(brute(rows)) == 6


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_007
    row = spark.range(1).select(phrase_mining.score(F.lit(big), F.lit(big + 5), F.lit(2 * big)).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 5) * 2 * big)


def test_edges(spark, tmp_path):
    rows = [(r[2], r[1]) for r in edge_rows()]
    got = phrase_mining.collocations(edge(spark).withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)), threshold=2)
    assert made(got) == brute(rows, 2)
    assert made(phrase_mining.query(spark, save(spark, edge_rows(), tmp_path))) == brute(rows)
    assert phrase_mining.collocations(empty(spark)).count() == 0


def test_query_is_whole(spark):
    import duckdb

    root = "/root/testdata/sf0.001"
    docs = duckdb.connect()
    docs.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    want = docs.execute(phrase_mining.ORACLE).fetchall()
    assert len(want) > 100 and made(phrase_mining.query(spark, root)) == sorted(want)


def test_words_of_a_block_are_numbered_at_once():
    texts = ["Ab a\tB.c", None, "", "  ", "x  ab", "É É...", "a\n\nb", "end."]
    block = phrase_mining.Block("en")
    sizes = [block.add(t) for t in texts]
    ids, names = block._numbered()
    want = [b"\xff"]
    for text in filter(None, texts):
        want += phrase_mining.BREAK.join(re.split(b"[.,;:!?\x0a-\x0d]", re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode()))).replace(b"\xff", b" \xff ").split() + [b"\xff"]
    assert [names[i] for i in ids.tolist()] == want and ids[0] == 0 and len(set(names)) == len(names)
    assert sum(n for n, _ in sizes) == block.size == len(want) - 1 and sum(n for _, n in sizes) + 1 == block.bytes == sum(map(len, want))


def test_a_step_reads_only_its_shard(spark):
    docs = spark.createDataFrame([("en", f"text {i}") for i in range(200)] + [("en", "text 1"), ("fr", "")], "lang string, text string")
    table = phrase_mining._sharded(docs, 3)
    files = [set(table.filter(F.col("shard") == k).select("text").inputFiles()) for k in range(3)]
    assert sum(table.filter(F.col("shard") == k).count() for k in range(3)) == table.count() == 202
    one = table.filter(F.col("shard") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in one and all(files)
    assert phrase_mining._sharded(docs.limit(0), 3).count() == 0
