"""Deduplication by content, by key, and with a check of conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import path_depth
from .merge import first_of_each


def keep_preferred_path(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """hash, filename, file: one row for each hash, of the least path depth, then file name, then path; hashes in `known` go."""
    kept = first_of_each(files, ["hash"], [path_depth(F.col("file")), F.col("filename"), F.col("file")])
    return kept if known is None else kept.join(known.select("hash"), "hash", "left_anti")


def within_key(files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """files with `kept` (the first name of its keys) and `is_deleted`."""
    w = Window.partitionBy(*keys).orderBy(name)
    return files.withColumn("kept", F.first(name).over(w)).withColumn("is_deleted", F.row_number().over(w) > 1)


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key; of equal times the greatest row."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(F.col(time).alias("__time"), *rest)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def consistent(df: DataFrame, key: str, time: str, strict: bool = True) -> DataFrame:
    """One row for each key: the last one where only the time differs. Other differences raise an error, or, if not strict, set `conflict`."""
    rest = [c for c in df.columns if c not in (key, time)]
    rows = df.groupBy(key).agg(F.count_distinct(F.struct(*rest)).alias("__n"), F.max(time).alias(time), F.max(F.struct(*rest)).alias("r"))
    conflict = F.col("__n") > 1
    out = rows.select(key, time, *[F.col(f"r.{c}").alias(c) for c in rest], conflict.alias("conflict"))
    if not strict:
        return out
    told = F.raise_error(F.concat(F.lit("conflicting rows of "), F.col(key).cast("string"))).cast("boolean")
    return out.where(F.when(F.col("conflict"), told).otherwise(F.lit(True))).drop("conflict")
