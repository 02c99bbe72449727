"""Merges of keyed tables: insert-ignore, upserts, keyed updates and deletes, each a join of what is new with what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in that order, which must be total for a repeatable result."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def _match(new: DataFrame, old: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [new[k].eqNullSafe(old[k]) for k in keys])


def missing_rows(new: DataFrame, old: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows, one of each key, whose key is not there yet (nulls are keys like others)."""
    one = first_of_each(new, keys, order or [F.col(c) for c in new.columns])
    held = old.select(*keys)
    return one.join(held, _match(one, held, keys), "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """All old rows, and the new ones that missing_rows() gives."""
    return old.unionByName(missing_rows(new, old, keys, order), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str], newer: str | None = None) -> DataFrame:
    """New values of the update columns where the key is in `new`; where `newer` is given, only if its value there is greater (old nulls are least).

    Of new rows that repeat a key, the one of the greatest `newer` counts, then the least.
    """
    new = first_of_each(new, [key], [*([F.desc(newer)] if newer else []), *[F.col(c) for c in new.columns if c != key]])
    a, b = old.alias("old"), new.alias("new")
    on = F.col(f"old.{key}") == F.col(f"new.{key}")
    takes = F.col(f"new.{key}").isNotNull()
    if newer:
        takes = takes & (F.col(f"old.{key}").isNull() | F.col(f"old.{newer}").isNull() | (F.col(f"new.{newer}") > F.col(f"old.{newer}")))
    value = lambda c: F.when(takes, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    other = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}") if c in new.columns else F.lit(None)).alias(c)
    return a.join(b, on, "full_outer").select(*[value(c) if c in update else other(c) for c in old.columns])


def update_by_key(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the rows whose key is in `new`, replaced where the new value isn't null; no row is added. Of new rows that repeat a key, the least counts."""
    given = first_of_each(new.select(key, *columns), [key], [F.col(c) for c in columns]).select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = old.join(given, key, "left")
    return rows.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")
