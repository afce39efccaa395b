"""Product identity across retailers: slugs, brands, core names and the dedup key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.text import ENDS, STARTS, WORD, WS, blank_to_null, let, lookup

NAME_SIZE = (
    rf"{STARTS}[0-9]+(?:[.,][0-9]+)?{WS}*(?:{vocab.NAME_SIZE_UNITS}){ENDS}"
)
_RUNS = rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def _plain(text: Column) -> Column:
    """Lower-case letters and digits, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_brand(brand: Column) -> Column:
    return _full_brand(_plain(brand))


def _full_brand(plain: Column) -> Column:
    return F.coalesce(lookup(vocab.BRAND_ALIASES, plain), plain)


def brand_tokens(brand: Column) -> Column:
    """Words of the brand as written and of its full form."""
    plain = _plain(brand)
    return F.array_union(F.split(_full_brand(plain), " "), F.split(plain, " "))


def canonical_core_name(brand: Column, name: Column) -> Column:
    """The name without brand words, sizes, flavors and marketing words.

    Brand words are dropped from the split text by array lookup (no pattern per row); sizes go
    next, while their punctuation is still in place.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit(_RUNS), F.lit(0))
    unbranded = let(
        brand_tokens(brand),
        lambda words: F.array_join(
            F.transform(runs, lambda run: F.when(F.array_contains(words, run), " ").otherwise(run)), ""
        ),
    )
    unsized = F.regexp_replace(unbranded, NAME_SIZE, " ")
    tokens = F.split(F.trim(F.regexp_replace(unsized, "[^a-z0-9]+", " ")), " ")
    dropped = vocab.FLAVOR_WORDS + vocab.NOISE_WORDS
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(dropped) & (t != "")), " ")


def product_dedup_key(brand: Column, name: Column) -> Column:
    core = F.coalesce(blank_to_null(canonical_core_name(brand, name)), slugify(name))
    return F.concat(slugify(normalize_brand(brand)), F.lit(":"), slugify(core))


def gtin_normalize(code: Column) -> Column:
    """Barcode padded to 14 digits, so padded and unpadded codes meet."""
    return F.lpad(F.ltrim(code, F.lit("0")), 14, "0")


def stable_id(*parts: Column) -> Column:
    """Deterministic row id from a natural key, so a rerun gives the same ids."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
