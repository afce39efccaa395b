"""Language-model scores by subword lattices over an existing vocabulary.

A text is its lower-cased words and an end. A word is either one the training texts hold, drawn by
its frequency, or spelled in pieces of a public vocabulary: the lattice of all its segmentations is
summed by the forward recursion in log space, so no single segmentation is chosen. The pieces'
probabilities start from the vocabulary's own scores and are re-estimated by forward-backward over
all training words; the share of spelled words is that of words seen once (Good-Turing). A score
is the log10 of the marginal probability, summed over words and end.

Counts, pieces and scores live in tables. The words with a share of at least 1/``HEAD`` of all
training tokens, so at most ``HEAD`` of them, go to the tasks as a broadcast; all others are joined.

Edge cases: a null or empty text is the end alone; a null id is never held out; characters that the
vocabulary lacks are spelled in its byte pieces; repeated rows are scored each and all counted; no
training texts leave only spelled words; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, stored

VOCABULARY = "piece_bpe_32k.model"
HEAD = 500_000
FLUSH = 200_000
FOLDS, HELD_OUT = 5, 1
LOG10 = math.log(10)
START = "▁"
SHORT, TINY = 24, 1e-250  # places of a word that is summed as products, unless they get this small
NOTHING = object()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_key(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Pieces with probabilities from the vocabulary's own scores, which fall with the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i)):
            raw[model.id_to_piece(i)] = 1.0 / (10.0 + abs(model.get_score(i)))
    total = sum(raw.values())
    return {piece: x / total for piece, x in raw.items()}


class Lattice:
    """Sums over the segmentations of a word; ``stop`` is the chance that a piece is the last."""

    def __init__(self, pieces: dict[str, float], stop: float):
        self.logs = {p: math.log(x * (1 - stop)) for p, x in pieces.items() if x > 0}
        self.end = math.log(stop / (1 - stop))
        self.floor = min(self.logs.values()) - 10
        # every beginning of a piece, with the weight of those that are pieces themselves
        self.table: dict[str, float | None] = {p[:n]: None for p in self.logs for n in range(1, len(p))} | self.logs

    def arcs(self, text: str) -> list[list[tuple[int, float, str]]]:
        """For each end place the arcs (start, log weight, piece) that reach it."""
        table, size = self.table, len(text)
        out: list[list] = [[] for _ in text]
        for i, first in enumerate(text):
            weight = table.get(first, NOTHING)
            if weight is NOTHING or weight is None:
                spelled = sum(self.logs.get(f"<0x{b:02X}>", self.floor) for b in first.encode())
                out[i].append((i, spelled, ""))
                if weight is NOTHING:
                    continue
            else:
                out[i].append((i, weight, first))
            for j in range(i + 2, size + 1):
                piece = text[i:j]
                weight = table.get(piece, NOTHING)
                if weight is NOTHING:  # no piece begins like this
                    break
                if weight is not None:
                    out[j - 1].append((i, weight, piece))
        return out

    @staticmethod
    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum([math.exp(v - top) for v in values])) if len(values) > 1 else top

    def forward(self, arcs) -> list[float]:
        alpha = [0.0]
        for found in arcs:
            alpha.append(self.total([alpha[i] + w for i, w, _ in found]))
        return alpha

    def log_probability(self, word: str) -> float:
        return self.forward(self.arcs(START + word))[-1] + self.end

    def expect(self, word: str, counts: dict[str, float]) -> float:
        """Adds the expected number of times each piece is used in ``word``; their sum. Short words are
        summed as plain products, which are exact enough there and need no logarithms."""
        arcs = self.arcs(START + word)
        if len(arcs) > SHORT:
            return self._expect_long(arcs, counts)
        logs, arcs = arcs, [[(i, math.exp(w), piece) for i, w, piece in found] for found in arcs]
        alpha = [1.0]
        for found in arcs:
            alpha.append(sum([alpha[i] * w for i, w, _ in found]))
        if alpha[-1] < TINY:
            return self._expect_long(logs, counts)
        beta = [0.0] * len(alpha)
        beta[-1], used = 1.0 / alpha[-1], 0.0
        for j in range(len(arcs), 0, -1):
            after = beta[j]
            for i, w, piece in arcs[j - 1]:
                beta[i] += w * after
                share = alpha[i] * w * after
                counts[piece] += share
                used += share
        return used

    def _expect_long(self, arcs, counts: dict[str, float]) -> float:
        alpha = self.forward(arcs)
        leaving = [[] for _ in alpha]
        for j, found in enumerate(arcs, 1):
            for i, w, piece in found:
                leaving[i].append((j, w, piece))
        beta = [0.0] * len(alpha)
        for i in range(len(alpha) - 2, -1, -1):
            beta[i] = self.total([w + beta[j] for j, w, _ in leaving[i]]) if leaving[i] else -1e300
        whole, used = alpha[-1], 0.0
        for i, out in enumerate(leaving):
            for j, w, piece in out:
                share = math.exp(alpha[i] + w + beta[j] - whole)
                counts[piece] += share
                used += share
        return used


def word_counts(docs: DataFrame) -> DataFrame:
    """(train, text) -> (word, c): every word of all texts with its count in training texts."""

    def run(batches):
        def out(held):
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_pydict({"word": words, "c": pa.array(list(held.values()), pa.int64())})

        held: Counter = Counter()
        for batch in batches:
            for train, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if train:
                    held.update(words)
                else:
                    for w in words:
                        held.setdefault(w, 0)
                if len(held) >= FLUSH:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    return docs.select("train", "text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_pieces(words: DataFrame, path: str, rounds: int = 1) -> tuple[dict[str, float], float]:
    """Piece probabilities by ``rounds`` of expectation-maximisation over all training words.

    Only sums by piece come to the driver, at most one per piece of the fixed vocabulary.
    """
    pieces, stop = vocabulary(path), 0.3
    prior = pieces
    for _ in range(rounds):
        def run(batches, pieces=pieces, stop=stop):
            lattice, counts, used, seen = Lattice(pieces, stop), defaultdict(float), 0.0, 0
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    used += lattice.expect(word, counts)
                    seen += 1
            counts["\n"], counts[" "] = used, float(seen)  # all pieces together, and words
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.float64())})

        sums = words.filter("c > 0").select("word").mapInArrow(run, "piece string, n double")
        found = {r[0]: r[1] for r in sums.groupBy("piece").agg(F.sum("n")).collect()}
        used, seen = found.pop("\n", 0.0), found.pop(" ", 0.0)
        if not used:
            break
        known = sum(x for p, x in found.items() if p)
        pieces = {p: (found.get(p, 0.0) + 100 * x) / (known + 100) for p, x in prior.items()}
        stop = min(0.9, max(0.05, seen / used))
    return pieces, stop


def score(docs: DataFrame, path: str, head: int = HEAD, rounds: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    words = stored(word_counts(rows.select((~F.col("held_out")).alias("train"), "text")), "words")
    ends = rows.filter("NOT held_out").count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    total, kinds, once = seen[0] + ends, seen[1] + (ends > 0), seen[2]
    pieces, stop = learn_pieces(words, path, rounds)
    spelled = min(0.5, max(0.001, once / total)) if total else 1.0
    below = total + 0.5 * (kinds + 1)

    def word_scores(batches):
        lattice = Lattice(pieces, stop)
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            base = [math.log10((c + 0.5) / below) for c in counts]
            full = []
            for w, c in zip(names, counts, strict=True):
                log = lattice.log_probability(w) + math.log(spelled)
                if c:
                    own = math.log((1 - spelled) * c / total)
                    log = own + math.log1p(math.exp(log - own)) if log < own else log + math.log1p(math.exp(own - log))
                full.append(log / LOG10)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array([word_key(w.encode()) for w in names], pa.int64()), "word": batch.column(0), "c": batch.column(1),
                "w_base": pa.array(base, pa.float64()), "w_score": pa.array(full, pa.float64())})

    scored = stored(words.mapInArrow(word_scores, "h long, word string, c long, w_base double, w_score double"), "word-scores")
    # counts sum to ``total``: no more than ``head`` words can have a share of 1 / head
    top = scored.filter(F.col("c") * head >= F.lit(total)).filter("c > 0").select("word", "w_base", "w_score").collect()
    known = spark.sparkContext.broadcast({r[0].encode(): (r[1], r[2]) for r in top})
    end_base = math.log10((ends + 0.5) / below)
    end_score = math.log10((1 - spelled) * ends / total) if ends else math.log10(0.5)

    def run(batches):
        from pyspark import TaskContext

        table, at = known.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "held_out", "h", "n", "n_tokens", "known", "base", "score")}
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = Counter(words_of(text.as_py()))
                at += 1
                base, full, familiar, rest = end_base, end_score, int(ends > 0), []
                for word, n in counts.items():
                    hit = table.get(word)
                    if hit is None:
                        rest.append((word_key(word), n))
                    else:
                        base += n * hit[0]
                        full += n * hit[1]
                        familiar += n
                add = [(at, doc_id, held, xxhash.xxh3_64_intdigest(str(at)) >> 1, 0, counts.total() + 1, familiar, base, full)]
                add += [(at, None, None, h, n, 0, 0, 0.0, 0.0) for h, n in rest]
                for column, values in zip(out.values(), zip(*add, strict=True), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_pydict({
                k: pa.array(v, pa.bool_() if k == "held_out" else pa.float64() if k in ("base", "score") else pa.int64()) for k, v in out.items()})

    parts = rows.mapInArrow(run, "row long, doc_id long, held_out boolean, h long, n long, n_tokens long, known long, base double, score double")
    joined = parts.join(scored.select("h", "c", "w_base", "w_score"), "h", "left")
    tail = F.col("n") > 0
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(tail & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(tail, F.col("n") * F.col("w_base")).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.when(tail, F.col("n") * F.col("w_score")).otherwise(0.0)).alias("score"),
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
