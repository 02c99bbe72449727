"""Test tables, read and given the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, over four tasks a core at least: where a row takes far more time than its bytes let Spark expect."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def steps_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: a user is a batch, ten events (by id) of a user a job, the type stands for status."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "signup", "SKIPPED").when((F.col("event_type") == "view") & (F.col("value") > 95), "STARTED").otherwise("SUCCESS")
    kind = F.element_at(F.array(F.lit("TEXT_EXTRACTION"), F.lit("CLASSIFICATION"), F.lit("CONTENT_ANALYSIS")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("batch_id"), (F.col("event_id") % 10).alias("job_id"), F.col("event_id").alias("step_id"), kind.alias("step_type"), status.alias("status"), F.col("ts").alias("finished_at"))


STEPS_SQL = """WITH steps AS (SELECT user_id AS batch_id, event_id % 10 AS job_id, event_id AS step_id,
  CASE event_id % 3 WHEN 0 THEN 'TEXT_EXTRACTION' WHEN 1 THEN 'CLASSIFICATION' ELSE 'CONTENT_ANALYSIS' END AS step_type,
  CASE WHEN event_type = 'error' THEN 'FAILURE' WHEN event_type = 'signup' THEN 'SKIPPED' WHEN event_type = 'view' AND value > 95 THEN 'STARTED' ELSE 'SUCCESS' END AS status,
  ts AS finished_at FROM events)"""
