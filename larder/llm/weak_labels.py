"""Quality classifier from weak labels.

One pass over the texts takes each document's measures, the same as the quality rules', and its hashed
word shapes with their counts; all else works on this small table. Seven heuristic labellers vote good, bad
or nothing on the measures. Expectation-maximisation
over the counts of their vote patterns, at most 3^7 whatever the table's size, estimates each
labeller's accuracy on good and on bad documents, and gives every pattern a posterior. A linear
scorer over hashed word shapes learns the posteriors of a sample of ``SAMPLE`` documents, its bound,
and scores all documents.

Edge cases: a null or empty text is voted bad and scores by its bias alone; repeated rows are
documents each; a null id counts as any; an empty table gives an empty result; a table's own
columns don't matter, since only id and text are read.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, stored, worker_tool
from larder.llm.quality_cascade import WINDOW

SAMPLE = 4000
FEATURES = 4096
MEMO = 50_000
CLOSING = ",.;:!?"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_stutter", "n_repeat_words"]
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]

# (name, bad when, good when) over the measures; neither: no vote.
LABELLERS = [
    ("length", "n_words < 10", "n_words >= 30"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols = 0"),
    ("windows", "100 * n_repeat_words > 20 * n_words", "n_repeat_words = 0"),
    ("lines", "n_dup_lines > 0.4 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("variety", "n_distinct < 0.35 * n_words", "n_distinct > 0.5 * n_words"),
    ("word_length", "word_chars < 2.6 * n_words OR word_chars > 9 * n_words", "word_chars BETWEEN 3.5 * n_words AND 7 * n_words"),
    ("stutter", "n_stutter > 0.25 * n_words", "n_stutter < 0.02 * n_words"),
]


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """Share of good documents, each labeller's accuracy on (bad, good), posterior by pattern."""
    share, right = 0.8, [(0.7, 0.8)] * len(LABELLERS)
    total, post = max(1, sum(patterns.values())), {}
    for _ in range(rounds):
        for p in patterns:
            good, bad = math.log(share), math.log(1 - share)
            for v, (on_bad, on_good) in zip(p, right, strict=True):
                if v != "2":
                    good += math.log(on_good if v == "1" else 1 - on_good)
                    bad += math.log(on_bad if v == "0" else 1 - on_bad)
            post[p] = 1 / (1 + math.exp(min(500, bad - good)))
        share = min(0.999, max(0.001, sum(n * post[p] for p, n in patterns.items()) / total))
        fresh = []
        for k in range(len(LABELLERS)):
            hit = [1.0, 1.0]
            seen = [1.5, 1.5]  # smoothing keeps each labeller better than chance at first
            for p, n in patterns.items():
                if p[k] != "2":
                    for side, mass in ((0, n * (1 - post[p])), (1, n * post[p])):
                        seen[side] += mass
                        hit[side] += mass * (p[k] == str(side))
            fresh.append(tuple(min(0.999, max(0.001, h / s)) for h, s in zip(hit, seen, strict=True)))
        right = fresh
    return share, right, post


def shape(word: str) -> str:
    """Letters, digits and runs reduced to classes; other characters stay. A plain word, perhaps
    with a mark after it, needs no pattern."""
    body = word[:-1] if word[-1] in CLOSING else word
    if body.isalpha():
        return ("A" if len(body) > 1 and body.isupper() else "a0") + word[len(body):]
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a0", word)
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"\d+", "0", word))


def features(counts: Counter, n_stutter: int, memo: dict[str, int], width: int = FEATURES) -> dict[int, int]:
    """Hashed features and how often each occurs: every word's shape, whether the text had the word
    before or just now, and whether there is next to nothing."""
    held: dict[int, int] = defaultdict(int)
    for word, n in counts.items():
        kind = shape(word.decode())
        at = memo.get(kind)
        if at is None:
            if len(memo) >= MEMO:
                memo.clear()
            at = memo[kind] = xxhash.xxh32_intdigest(kind) % (width - 3)
        held[at] += n
    again = counts.total() - len(counts)
    if n_stutter:
        held[width - 1] += n_stutter
    if again > n_stutter:
        held[width - 2] += again - n_stutter
    if counts.total() + again < 10:
        held[width - 3] += 1
    return held


def repeated_words(words: list[bytes], counts: Counter) -> int:
    """Words in windows of ``WINDOW`` that the text has twice or more."""
    n = len(words)
    if n <= WINDOW or len(counts) == n:
        return 0
    place = dict(zip(counts, range(len(counts)), strict=True))
    ids = np.fromiter(map(place.__getitem__, words), dtype=np.uint64, count=n)
    x = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + ids[k:n - WINDOW + 1 + k]
    ordered = np.sort(x)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(x, twice).astype(np.int64)
    reach = np.zeros(n + 1, dtype=np.int64)
    reach[:len(hit)] += hit
    reach[WINDOW:] -= hit
    return int(np.count_nonzero(np.cumsum(reach[:n])))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> ``doc_id, draw``, the measures, and the features as ``ids, counts``."""

    def run(batches):
        memo = worker_tool("shapes", dict)
        for batch in batches:
            found = {name: [] for name in MEASURES}
            ids, counts = [], []
            texts = pc.fill_null(batch.column(2), "")
            for chars, text in zip(pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary()), strict=True):
                text = text.as_py()
                words = text.split()  # bytes know the six ASCII spaces only
                seen = Counter(words)
                stutter = sum(map(operator.eq, words, islice(words, 1, None)))
                lines = [x for x in text.split(b"\n") if x.strip()]
                spaces = len(text) - sum(map(len, words))
                values = (len(words), chars - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines),
                          len(seen), stutter, repeated_words(words, seen))
                for column, value in zip(found.values(), values, strict=True):
                    column.append(value)
                held = features(seen, stutter, memo)
                ids.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in found.values()],
                 pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "draw", *MEASURES, "ids", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("draw"), "text")
    columns = ", ".join(f"{name} long" for name in MEASURES)
    return rows.mapInArrow(run, f"doc_id long, draw long, {columns}, ids array<int>, counts array<int>")


def fit(rows: list[tuple[list[int], list[int], float]], width: int = FEATURES, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of posteriors on feature shares, by gradient steps."""
    weights, bias = np.zeros(width), 0.0
    if not rows:
        return weights, bias
    flat = np.concatenate([np.array(x, dtype=np.int64) for x, _, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
    want = np.array([p for _, _, p in rows])
    share = np.concatenate([np.array(c, dtype=np.float64) / sum(c) for _, c, _ in rows])
    pace = np.full(width + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(owner, weights[flat] * share, minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - want
        slope = np.append(np.bincount(flat, error[owner] * share, minlength=width) + 0.01 * weights, error.sum())
        pace += slope**2
        step = 0.5 * slope / np.sqrt(pace)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, pattern, posterior, score, kept`` per row of ``docs``."""
    spark = docs.sparkSession
    one = [F.when(F.expr(bad), "0").when(F.expr(good), "1").otherwise("2") for _, bad, good in LABELLERS]
    # a digit per labeller: 0 bad, 1 good, 2 no vote
    voted = stored(profiles(docs), "profiles").select("doc_id", "draw", "ids", "counts", F.concat(*one).alias("pattern"))
    tally = {r[0]: r[1] for r in voted.groupBy("pattern").count().collect()}  # at most 3^7 patterns
    _, _, post = estimate(tally)
    total = sum(tally.values())
    # an even draw by hash of about the sample's size; the limit is its documented bound
    edge = min((1 << 63) - 1, -(1 << 63) + int(sample / max(1, total) * (1 << 64)))
    rows = voted.filter(F.col("draw") <= F.lit(edge)).limit(2 * sample).select("pattern", "ids", "counts").collect()
    weights, bias = fit([(r["ids"], r["counts"], post[r["pattern"]]) for r in rows])
    model = spark.sparkContext.broadcast(weights)  # one number per hashed feature

    def scores(batches):
        for batch in batches:
            ids, counts = batch.column(2), batch.column(3)
            owner = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy())
            n = counts.flatten().to_numpy()
            mass = np.bincount(owner, n, minlength=len(ids))  # no document is without a feature
            found = np.bincount(owner, model.value[ids.flatten().to_numpy()] * n, minlength=len(ids)) / mass + bias
            found = 1 / (1 + np.exp(-np.clip(found, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "pattern", "score"])

    scored = voted.select("doc_id", "pattern", "ids", "counts").mapInArrow(scores, "doc_id long, pattern string, score double")
    by_pattern = spark.createDataFrame(list(post.items()), "p string, posterior double")
    return scored.join(F.broadcast(by_pattern), F.col("pattern") == F.col("p")).select(
        "doc_id", "pattern", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
