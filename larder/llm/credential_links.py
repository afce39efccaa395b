"""Secret scans with multipart credential linking, in SQL functions and joins only.

Strong findings are reported as they stand: assignments, access identifiers, long hex runs. Weak
candidates - an account identifier, a mixed token, an endpoint - mean nothing alone. They are put
into scopes of ``SCOPE`` code points and interval-joined with the parts near them; one is reported
only when complementary parts co-occur: an identifier beside a secret, a secret beside an
identifier, an endpoint beside both. Strong findings count as parts (access: identifier; assign,
hex: secret).

Kinds in order: assign, access, hex, id, secret, endpoint. Spans are code points, end exclusive.

Edge cases: a null or empty text has no spans; spans of different kinds may overlap and all stay;
equal texts have equal spans, so the join works on texts and repeated rows cost nothing; an
empty table gives an empty result; own columns with clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import documents, fresh

# The base patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
LEAST_ACCESS = 16

IDENTIFIER = r"""(?i:user_?name|user_?id|login|account_?id|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
SCOPE = 300
SPAN = "array<struct<start:long,rank:int,stop:long>>"


def located(text: Column, pattern: str, rank: int, passes=None) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern`` that satisfy ``passes``.

    Matches and the gaps between them alternate, so running lengths give the places. ``passes``
    gets a match's text and number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("g")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate(
        lengths, start,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    spans = F.zip_with(found, starts, lambda m, s: F.struct(
        s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).cast("long").alias("stop"), m.alias("m")))
    if passes is not None:
        spans = F.filter(spans, passes)
    plain = F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["stop"]))
    return F.when(text.rlike(pattern), plain).otherwise(F.array().cast(SPAN)).cast(SPAN)


def value_passes(text: Column):
    """An assignment's value has at least eight characters."""
    return lambda x, i: F.length(F.get(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), i)) >= LEAST_VALUE


def strong(text: Column) -> dict[str, Column]:
    return {
        "assign": located(text, ASSIGN, 0, lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 2)) >= LEAST_VALUE),
        "access": located(text, ACCESS, 1, lambda x: F.length(x["m"]) >= LEAST_ACCESS),
        "hex": located(text, HEX, 2),
    }


def weak(text: Column) -> Column:
    mixed = located(text, MIXED, 4, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]"))
    return F.concat(located(text, IDENTIFIER, 3), mixed, located(text, ENDPOINT, 5))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, span) parts -> per key the weak spans that have their complement in scope.

    Interval join: a part looks into its own and the two neighbouring cells of ``scope`` code
    points, and a pair counts when the gap between the spans is at most ``scope`` and they do not
    overlap; only an endpoint may hold its parts. The join
    aggregates to three flags per weak part at once, so pairs are never written out.
    """
    role = F.when(F.col("rank").isin(1, 3), "i").when(F.col("rank") == 5, "e").otherwise("s")
    parts = parts.select("key", "start", "rank", "stop", role.alias("role")).distinct()
    near = parts.select(
        F.col("key").alias("k"), F.col("start").alias("b"), F.col("stop").alias("e"), F.col("role").alias("r"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope))).alias("cell"),
    )
    # of each cell and role, only what reaches furthest either way matters to a weak part outside
    seen = parts.filter("rank > 2").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("stop") / scope) + 1)))
    gap = F.greatest(F.col("b") - F.col("stop"), F.col("start") - F.col("e"))
    pairs = seen.join(near, (seen["key"] == near["k"]) & (seen["cell"] == near["cell"]) & (gap <= scope)
                      & ((gap >= 0) | (F.col("rank") == 5)))
    flags = pairs.groupBy("key", "start", "rank", "stop").agg(
        F.max((F.col("r") == "i").cast("int")).alias("has_i"), F.max((F.col("r") == "s").cast("int")).alias("has_s"))
    kept = flags.filter("(rank = 3 AND has_s = 1) OR (rank = 4 AND has_i = 1) OR (rank = 5 AND has_i = 1 AND has_s = 1)")
    return kept.groupBy("key").agg(F.collect_set(F.struct("start", "rank", "stop")).alias("weak_spans"))


def scan(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with ``assign, access, hex`` and ``all_spans``."""
    work = fresh(docs, "text", "weak", "key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*[c for c in keep if c.lower() not in ("assign", "access", "hex", "all_spans")],
                        text.alias(work["text"]), F.col(id_col).cast("string").alias(work["key"]))
    cols = [c for c in found.columns if c not in work.values()]
    t = F.col(work["text"])
    found = found.select(*cols, work["key"], work["text"], *[c.alias(k) for k, c in strong(t).items()], weak(t).alias(work["weak"]))
    both = F.concat("assign", "access", "hex", work["weak"])
    some = lambda *ranks: F.exists(both, lambda x: x["rank"].isin(*ranks))
    hopeful = (F.size(work["weak"]) > 0) & some(1, 3) & some(0, 2, 4)
    # texts without a candidate get a key of their own that meets nothing
    found = found.withColumn(work["key"], F.when(hopeful, F.sha2(work["text"], 256)).otherwise(F.concat(F.lit("#"), F.coalesce(work["key"], F.lit("")))))
    parts = found.filter(~F.col(work["key"]).startswith("#")).select(F.col(work["key"]).alias("key"), F.inline(both))
    links = linked(parts).withColumnRenamed("key", "_link_key")
    all_spans = F.array_sort(F.concat("assign", "access", "hex", F.coalesce("weak_spans", F.array().cast(SPAN))))
    return found.join(links, F.col(work["key"]) == F.col("_link_key"), "left").select(
        *cols, "assign", "access", "hex", all_spans.alias("all_spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat(F.get(names, x["rank"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced in its text; ``n_chars`` follows where present."""
    work = fresh(docs, "row", "clean")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias(work["row"]))
    found = scan(rows, ["text", work["row"]])
    t = F.coalesce("text", F.lit(""))
    cut = F.aggregate(
        F.col("all_spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    found = found.withColumn(work["clean"], F.when(F.size("all_spans") > 0, cut).otherwise(F.col("text")))
    out = {"text": F.col(work["clean"]),
           "n_chars": F.when(F.size("all_spans") > 0, F.length(work["clean"]).cast("long")).otherwise(F.col(f"{work['row']}.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[out[c].alias(c) if out.get(c) is not None else F.col(f"{work['row']}.{c}") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), ["doc_id"])
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text("all_spans").alias("spans"))
