"""Market lookups."""

from __future__ import annotations

from pyspark.sql import Column

from larder.functions import vocab
from larder.functions.text import lookup


def currency_for_market(market: Column) -> Column:
    return lookup(vocab.MARKET_CURRENCY, market, vocab.DEFAULT_CURRENCY)


def marketplace_domain(market: Column) -> Column:
    return lookup(vocab.MARKETPLACE_DOMAIN, market, vocab.DEFAULT_MARKETPLACE_DOMAIN)
