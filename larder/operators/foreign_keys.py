"""Deletes that follow the declared foreign keys through all tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names a row of ``parent``, whose key is ``key``. When that row is deleted, the
    child's rows go too, or, with ``set_null``, stay and forget it."""

    child: str
    column: str
    parent: str
    key: str
    set_null: bool = False


# The catalog's keys and what a delete does.
KEYS = [
    ForeignKey("products", "brand_id", "brands", "brand_id"),
    ForeignKey("listings", "source_id", "sources", "source_id"),
    ForeignKey("listings", "product_id", "products", "product_id"),
    ForeignKey("variants", "listing_id", "listings", "listing_id"),
    ForeignKey("nutrition", "variant_id", "variants", "variant_id"),
    ForeignKey("facts", "variant_id", "variants", "variant_id"),
    ForeignKey("prices", "variant_id", "variants", "variant_id"),
    ForeignKey("issues", "source_id", "sources", "source_id", set_null=True),
]


def parents_first(keys: list[ForeignKey]) -> list[str]:
    """Every table after all tables it refers to."""
    tables = {k.child for k in keys} | {k.parent for k in keys}
    order: list[str] = []
    while tables - set(order):
        ready = sorted(t for t in tables - set(order) if all(k.parent in order for k in keys if k.child == t))
        if not ready:
            raise ValueError(f"foreign keys run in a circle among {sorted(tables - set(order))}")
        order += ready
    return order


def delete(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], keys: list[ForeignKey] = KEYS) -> dict[str, DataFrame]:
    """``tables`` after the rows named in ``doomed`` (per table a frame of its key) are deleted.

    Tables are walked parents first. Only keys of deleted rows travel: each child is split by a semi
    join with its parents' deleted keys and hands its own deleted keys on, so tables that no delete
    reaches are not touched. A key that names no row, deleted or not, is left alone.
    """
    own = {k.parent: k.key for k in keys}
    gone: dict[str, DataFrame] = {}  # per parent table, the keys of its deleted rows
    left: dict[str, DataFrame] = {}
    for name in parents_first(keys):
        if name not in tables:
            continue
        rows = tables[name]
        key = own.get(name)
        lost = [doomed[name].select(key)] if name in doomed else []
        for link in (k for k in keys if k.child == name and k.parent in gone):
            dead = gone[link.parent].select(F.col(link.key).alias(link.column))
            if link.set_null:
                marked = dead.distinct().withColumn("_dead", F.lit(True))
                rows = rows.join(marked, link.column, "left").withColumn(
                    link.column, F.when(F.col("_dead").isNull(), F.col(link.column))).drop("_dead").select(*tables[name].columns)
            elif key is not None:
                lost.append(tables[name].join(dead, link.column, "left_semi").select(key))
            else:
                rows = rows.join(dead, link.column, "left_anti")
        if lost:
            both = lost[0]
            for more in lost[1:]:
                both = both.union(more)
            gone[name] = both.distinct()
            rows = rows.join(gone[name], key, "left_anti")
        left[name] = rows
    return {name: left.get(name, rows) for name, rows in tables.items()}
