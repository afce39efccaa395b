"""Shared text and number pieces: character classes, whitespace, exact rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode word characters, and whitespace as text sources use it. `\b` differs between
# regex engines next to accented letters, so boundaries are spelled out.
WORD = r"[\p{L}\p{N}_]"
# The range comes first, so that letters and digits are told by two comparisons.
WS = (
    r"[[\x00-\x20\x{85}-\x{3000}]&&[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]]"
)
NUM = r"([0-9]+(?:\.[0-9]+)?)"
STARTS = rf"(?<!{WORD})"
ENDS = rf"(?!{WORD})"


def collapse_ws(text: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, or null when there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def number(text: Column) -> Column:
    """The number that ``text`` is, else null. An empty text is no number without an attempt, which costs an exception."""
    return blank_to_null(text).try_cast("double")


def first_number(text: Column, pattern: str, group: int = 1) -> Column:
    return number(F.regexp_extract(text, pattern, group))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word occurs in ``text`` as a plain substring."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def truthy(value: Column) -> Column:
    """Null for the values an ``a or b`` chain skips: zero."""
    return F.nullif(value, F.lit(0.0))


def exact_round(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, half to even on the exact binary value.

    ``bround`` decides on the shortest decimal text of the number, so it takes 30.85 for a
    tie although the stored double lies above it; ``format_number`` decides on the double.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", x, F.lit(pattern)).try_cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for an expression that needs it several times."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    """A small fixed table as a column expression; the key is evaluated once."""
    entries = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def tags_where(flags: dict[str, Column]) -> Column:
    """The tags whose condition holds, in the given order.

    ``array_remove`` keeps the conditions inside generated code; ``array_compact`` would evaluate
    all of them through an interpreted lambda.
    """
    marks = [F.when(cond, F.lit(tag)).otherwise(F.lit("")) for tag, cond in flags.items()]
    return F.array_remove(F.array(*marks), "")


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but the columns are computed exactly once per row.

    A later filter on a plain projection is pushed below it together with a copy of its whole
    expression; behind a pattern match or a word scan that repeats the expensive part many times.
    A one-element generator is a boundary that filters on its output do not cross. The generator
    only carries columns: what is computed inside of one is interpreted, and shared parts again
    and again, as soon as one of its expressions has a lambda; a projection is compiled.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[col.alias(name) for name, col in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*columns))))
