"""Typed filter spec and the predicates it is made of."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.operators.metrics import DEFAULT_METRIC, MetricDef, metric


@dataclass(frozen=True)
class FilterSpec:
    market: str = "US"
    q: str | None = None
    brands: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    in_stock_only: bool = False
    max_price_cents: int | None = None
    metric: str = DEFAULT_METRIC
    order: str = "best"
    dietary: tuple[str, ...] = ()
    allergen_free: tuple[str, ...] = ()
    no_artificial: bool = False
    extra: tuple[Column, ...] = field(default=(), compare=False)

    @property
    def metric_def(self) -> MetricDef:
        return metric(self.metric)

    @property
    def descending(self) -> bool:
        better = self.metric_def.higher_is_better
        return better if self.order != "worst" else not better


def max_price_cents(amount: float) -> int:
    """A price limit in whole cents; halves round up."""
    return int(amount * 100 + 0.5)


def market_is(market: str) -> Column:
    return F.col("market") == (market if market in vocab.MARKETS else "US")


def in_stock() -> Column:
    return F.col("in_stock")


def brand_in(brands: tuple[str, ...]) -> Column:
    return F.col("brand_name").isin(list(brands))


def source_in(slugs: tuple[str, ...]) -> Column:
    return F.col("source_slug").isin(list(slugs))


def priced_at_most(cents: int) -> Column:
    return F.col("price_cents") <= cents


def text_matches(q: str) -> Column:
    """The text occurs, letter case aside, in the product or the brand name; no wildcards."""
    needle = F.lower(F.lit(q))
    return F.contains(F.lower("product_name"), needle) | F.contains(F.lower("brand_name"), needle)


def metric_known(m: MetricDef) -> Column:
    return F.col(m.column).isNotNull()


def has_every(column: str, tags: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(F.col(column), t) for t in tags])


def has_none(column: str, tags: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [~F.array_contains(F.col(column), t) for t in tags])


def offer_predicates(spec: FilterSpec) -> list[Column]:
    """What can be decided on an offer alone. These run before counting, so that counts cover
    matching offers only."""
    preds = [market_is(spec.market)]
    if spec.in_stock_only:
        preds.append(in_stock())
    if spec.sources:
        preds.append(source_in(spec.sources))
    if spec.max_price_cents is not None:
        preds.append(priced_at_most(spec.max_price_cents))
    if spec.metric_def.needs_nutrition:
        preds.append(metric_known(spec.metric_def))
    if spec.dietary:
        preds.append(has_every("dietary_labels", spec.dietary))
    if spec.allergen_free:
        preds.append(has_none("allergens", spec.allergen_free))
    if spec.no_artificial:
        preds.append(has_none("sweeteners", tuple(vocab.ARTIFICIAL_SWEETENERS)))
    return preds + list(spec.extra)


def product_predicates(spec: FilterSpec) -> list[Column]:
    """What depends on the product only: it keeps or drops whole groups, so it commutes with
    grouping and may run after it."""
    preds = []
    if spec.brands:
        preds.append(brand_in(spec.brands))
    if spec.q:
        preds.append(text_matches(spec.q))
    return preds


def apply(df: DataFrame, preds: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def compose_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return apply(df, offer_predicates(spec) + product_predicates(spec))
