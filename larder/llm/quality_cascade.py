"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is a failing condition and an estimate of its work per document. One aggregate over a
bounded sample gives every rule's mean work and rejection rate; the rules then run in order of
rejections per unit of work, as one CASE chain that stops at the first failure. The order changes
what is computed, never the verdict. The share of distinct words falls as any text grows, so it is
taken over consecutive windows of ``SPREAD`` words, the last one shorter, and weighted by their length.

Edge cases: a null or empty text has no words and fails; ratios of a text without words or lines
count as 0; ties in the order fall back to the rule's name; an empty table keeps the given order;
a table's own columns with the names of the measures are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import stage
from larder.llm.common import NOT_SPACE, documents, fresh, words

SAMPLE_ROWS = 2000
WINDOW = 5
MIN_WORDS = 10
SPREAD = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` and ``work`` are expressions over the measures named in ``MEASURES``."""

    name: str
    fails: str
    work: str


# Work counts the characters, words or hashes that the measures behind a rule touch.
RULES = [
    Rule("few_words", f"n_words < {MIN_WORDS}", "n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "chars"),
    Rule("repeated_lines", "n_dup_lines > 0.4 * n_lines", "chars + 4 * n_lines"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 20 * n_words", "chars"),
    Rule("distinct_words", "n_spread < 0.35 * n_words", "8 * n_words"),
    Rule("stutter", "n_stutter > 0.25 * n_words", "6 * n_words"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", "40 * n_words"),
]


def _base(df: DataFrame, text: Column) -> DataFrame:
    """Word and line arrays; the rest is made of them."""
    text = F.coalesce(text, F.lit(""))
    return df.withColumns({
        "_text": text,
        "_words": words(text),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)),
    })


def n_words() -> Column:
    return F.size("_words").cast("long")


def word_chars() -> Column:
    return F.length(F.array_join("_words", "")).cast("long")


def n_symbols() -> Column:
    return F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long")


def n_dup_lines() -> Column:
    return (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")


def n_distinct() -> Column:
    return F.size(F.array_distinct("_words")).cast("long")


def n_spread() -> Column:
    """Distinct words of each window of ``SPREAD`` words, added up; of a shorter text, ``n_distinct``."""
    starts = F.sequence(F.lit(1), F.size("_words"), F.lit(SPREAD))
    per_window = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("_words", i, SPREAD))).cast("long"))
    total = F.aggregate(per_window, F.lit(0).cast("long"), lambda acc, n: acc + n)
    return F.when(F.size("_words") > SPREAD, total).otherwise(n_distinct())


def n_stutter() -> Column:
    """Words equal to the word before."""
    pairs = F.zip_with("_words", F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))), lambda a, b: a == b)
    return F.size(F.filter(pairs, lambda same: same)).cast("long")


def window_hashes() -> Column:
    """A 64-bit hash of each run of five words."""
    at = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    return F.when(F.size("_words") > WINDOW, hashes)


def with_repeats(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """``out``: the words in windows found twice or more.

    Texts without a repeated hash, nearly all, stop at the distinct count. Otherwise windows are
    sorted by hash, those with an equal neighbour are put back in text order, and each adds the
    words that the one before did not reach.
    """
    w = F.col(hashes)
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct(w)) < F.size(w),
        F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    s = F.col("_sorted")

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    df = df.withColumn("_places", F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.col("_places"), start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted", "_places")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "chars", "n_distinct", "n_spread", "n_stutter", "n_repeat_words"]


def measures(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with every measure as a column."""
    df = _base(df.drop(*[c for c in df.columns if c.lower() in MEASURES]), text)
    df = df.withColumns({
        "n_words": n_words(), "word_chars": word_chars(), "n_symbols": n_symbols(), "n_dup_lines": n_dup_lines(),
        "n_lines": F.size("_lines").cast("long"), "chars": F.length("_text").cast("long"),
        "n_distinct": n_distinct(), "n_spread": n_spread(), "n_stutter": n_stutter(), "_hashes": window_hashes(),
    })
    return with_repeats(df, "_hashes", "n_repeat_words").drop("_text", "_words", "_lines", "_hashes")


def plan(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per unit of work, both measured on a bounded sample."""
    sample = measures(docs.select(F.col(text_col).alias("text")).limit(sample_rows), F.col("text"))
    row = sample.agg(*[
        x for i, r in enumerate(rules) for x in (
            F.avg(F.coalesce(F.expr(r.fails), F.lit(False)).cast("int")).alias(f"rate{i}"),
            F.avg(F.expr(r.work)).alias(f"work{i}"),
        )
    ]).first()
    if row["rate0"] is None:
        return list(rules)
    order = [(-row[f"rate{i}"] / max(1.0, row[f"work{i}"]), r.name, r) for i, r in enumerate(rules)]
    return [r for _, _, r in sorted(order, key=lambda x: x[:2])]


def verdict(rules: list[Rule]) -> Column:
    """True when no rule fails; later conditions of the chain are not evaluated after a failure."""
    chain = F.when(F.expr(rules[0].fails), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(F.expr(rule.fails), F.lit(False))
    return chain.otherwise(F.lit(True))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    order = plan(docs, rules, text_col=text_col)
    work = fresh(docs, "kept", "row")
    whole = docs.select(F.struct(*docs.columns).alias(work["row"]), F.col(text_col).alias(work["kept"]))
    judged = stage(
        measures(whole, F.col(work["kept"])).select(work["row"], verdict(order).alias(work["kept"])),
        {work["kept"]: F.col(work["kept"])},
    )
    return judged.filter(work["kept"]).select(f"{work['row']}.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = measures(docs.select("doc_id", "text"), F.col("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judged.select("doc_id", *[m for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                           failed.alias("base_failed"), "n_lines", "n_spread", "n_stutter")
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(plan(docs))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT *, [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)] AS g5 FROM w
), r AS (
  SELECT doc_id, unnest(g5) AS x, generate_subscripts(g5, 1) AS i FROM g
), d AS (
  SELECT doc_id, x FROM r GROUP BY doc_id, x HAVING count(*) > 1
), p AS (
  SELECT r.doc_id, i, lag(i) OVER (PARTITION BY r.doc_id ORDER BY i) AS b FROM r JOIN d ON r.doc_id = d.doc_id AND r.x = d.x
), c AS (
  SELECT doc_id, sum(least(5, i - coalesce(b, i - 5)))::BIGINT AS n FROM p GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(ls) AS n_lines,
         coalesce(list_sum([len(list_distinct(ws[i:i + 1999])) for i in range(1, len(ws) + 1, 2000)]), 0) AS n_spread,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM g LEFT JOIN c ON g.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR n_dup_lines > 0.4 * n_lines
         OR word_chars < 2.5 * n_words OR word_chars > 20 * n_words
         OR n_spread < 0.35 * n_words OR n_stutter > 0.25 * n_words) AS kept
FROM b
"""
