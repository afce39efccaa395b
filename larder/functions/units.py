"""Weights, servings, money and flavor labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.text import ENDS, NUM, STARTS, WS, collapse_ws, exact_round, first_match, first_number, let, lookup, number

_UNITS = "|".join(vocab.KG_UNITS + vocab.LB_UNITS + vocab.OZ_UNITS + vocab.G_UNITS)
_GRAMS = {
    **dict.fromkeys(vocab.KG_UNITS, vocab.GRAMS_PER_KG),
    **dict.fromkeys(vocab.LB_UNITS, vocab.GRAMS_PER_LB),
    **dict.fromkeys(vocab.OZ_UNITS, vocab.GRAMS_PER_OZ),
    **dict.fromkeys(vocab.G_UNITS, vocab.GRAMS_PER_G),
}
WEIGHT = rf"(?i)[0-9]+(?:[.,][0-9]+)?{WS}*(?:{_UNITS}){ENDS}"
MULTIPACK = (
    rf"(?i){STARTS}pack of{WS}*[0-9]+|{STARTS}[0-9]+{WS}*[-\s]?pack{ENDS}"
    rf"|{STARTS}twin pack{ENDS}|{STARTS}case of{WS}*[0-9]+|{STARTS}bundle{ENDS}"
)
SERVINGS = rf"(?i){NUM}{WS}*servings?{ENDS}"


def _token_grams(token: Column) -> Column:
    amount = F.regexp_replace(F.regexp_extract(token, r"^[0-9]+(?:[.,][0-9]+)?", 0), ",", ".")
    return number(amount) * lookup(_GRAMS, _token_unit(token))


def _token_unit(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"[A-Za-z]+$", 0))


def parse_weight_g(text: Column) -> Column:
    """Grams of the first weight in the text."""
    return exact_round(let(first_match(text, WEIGHT), _token_grams), 3)


def parse_container_g(text: Column) -> Column:
    """Net weight of the container: the largest lb/kg/oz token, else the largest gram token
    that is heavy enough to be a container."""

    def heaviest(tokens: Column) -> Column:
        is_gram = lambda t: _token_unit(t).isin(vocab.G_UNITS)
        container = F.array_max(F.transform(F.filter(tokens, lambda t: ~is_gram(t)), _token_grams))
        grams = F.transform(F.filter(tokens, is_gram), _token_grams)
        plausible = F.array_max(F.filter(grams, lambda g: g >= vocab.MIN_CONTAINER_G))
        return F.coalesce(container, plausible)

    tokens = F.regexp_extract_all(text, F.lit(WEIGHT), F.lit(0))
    return exact_round(let(tokens, heaviest), 3)


def is_multipack(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(MULTIPACK)), F.lit(False))


def parse_servings(text: Column) -> Column:
    """The N of the first "N servings"."""
    return first_number(text, SERVINGS)


def cents_from_number(amount: Column) -> Column:
    return F.rint(amount * 100.0).try_cast("int")


def cents_from_text(amount: Column) -> Column:
    """Keep digits and dots, then cents; null when that is no number."""
    return cents_from_number(number(F.regexp_replace(amount, "[^0-9.]", "")))


def clean_flavor(text: Column) -> Column:
    return let(
        collapse_ws(text), lambda label: F.when(~F.lower(label).isin(vocab.NO_FLAVOR), label)
    )
