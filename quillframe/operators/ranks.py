"""Row numbers without a task that sees all rows or all of a key's, and the scratch tables they need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new place in spark.checkpoint.dir; in a folder of our own where that is unset and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillframe-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as each write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch_folder(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where df has so many rows at most; a shuffled join otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(rows: DataFrame, keys: list[str], order: list[str], into: str = "number") -> DataFrame:
    """rows with `into`: their place (from 0) among the rows of their keys, in order of `order`; without keys among all rows.

    Rows are dealt to ranges of (keys, order) and written, so that every reading agrees on the ranges; a row's number is what its keys
    have in ranges before, as counts of ranges say, and its place within its own. A key of any size is split over ranges; rows that are
    equal in keys and order are in any order.
    """
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))  # a row a range, and one for each further key in it
    past = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    several = before.where("__before > 0")  # only keys that go over a range's end
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    out = ranged.withColumn("__within", within).join(small(several), same, "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__within") - 1 + F.coalesce("__before", F.lit(0))).cast("long").alias(into))
