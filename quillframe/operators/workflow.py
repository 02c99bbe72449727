"""Batches, jobs and steps: fan-out, step gating, progress, roll-up, cancelling and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("PENDING", "STARTED")
STEPS = ("TEXT_EXTRACTION", "CLASSIFICATION", "CONTENT_ANALYSIS")


def fan_out(documents: DataFrame, batch_id: str, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """job_id, document_id, batch_id, step_type, order, status for each document and step."""
    items = F.array(*[F.struct(F.lit(s).alias("step_type"), F.lit(i).alias("order")) for i, s in enumerate(steps)])
    job = F.sha2(F.concat_ws("/", F.lit(batch_id), F.col("document_id").cast("string")), 256)
    return documents.select(job.alias("job_id"), "document_id", F.lit(batch_id).alias("batch_id"), F.explode(items).alias("s")).select("job_id", "document_id", "batch_id", "s.*", F.lit("PENDING").alias("status"))


def next_step(steps: DataFrame) -> DataFrame:
    """steps with next_order: the next greater order of the job; null after the last."""
    return steps.withColumn("next_order", F.lead("order").over(Window.partitionBy("job_id").orderBy("order")))


def gated(status_before: Column, status: Column) -> Column:
    """A step runs only after a success: behind anything else that has ended it is skipped."""
    return F.when((status == "PENDING") & ~status_before.isin("SUCCESS", *OPEN), F.lit("SKIPPED")).otherwise(status)


def step_progress(steps: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each step type of `kinds`: progress (neither pending nor started), skipped, errors, total; zeros where there is no step."""
    counts = steps.groupBy("step_type").agg(
        F.count_if(~F.col("status").isin(*OPEN)).alias("progress"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "FAILURE").alias("errors"), F.count("*").alias("total")
    )
    return kinds.join(counts, "step_type", "left").na.fill(0)


def job_status(steps: DataFrame) -> DataFrame:
    """batch_id, job_id, status: SUCCESS once all steps have ended, unless one failed, was cancelled or skipped."""
    s = F.col("status")
    ended = F.when(F.bool_or(s.isin(*OPEN)), "STARTED").when(F.bool_or(s == "FAILURE"), "FAILURE").when(F.bool_or(s == "CANCELLED"), "CANCELLED").when(F.bool_or(s == "SKIPPED"), "SKIPPED").otherwise("SUCCESS")
    return steps.groupBy("batch_id", "job_id").agg(ended.alias("status"))


def batch_status(jobs: DataFrame) -> DataFrame:
    """batch_id, status, total: FAILURE if any job failed, once all have ended."""
    s = F.col("status")
    ended = F.when(F.bool_or(s.isin(*OPEN)), "STARTED").when(F.bool_or(s == "FAILURE"), "FAILURE").otherwise("SUCCESS")
    return jobs.groupBy("batch_id").agg(ended.alias("status"), F.count("*").alias("total"))


def stuck_batches(batches: DataFrame, steps: DataFrame, now: Column, seconds: int = 1800) -> DataFrame:
    """Open batches whose last step ended over `seconds` ago; those without an ended step are not stuck."""
    last = steps.groupBy("batch_id").agg(F.max("finished_at").alias("last_finished"))
    limit = now - F.make_dt_interval(secs=F.lit(seconds))
    return batches.where(F.col("status").isin(*OPEN)).join(last, "batch_id").where(F.col("last_finished") < limit)


def cancelled(rows: DataFrame) -> DataFrame:
    """Open rows as CANCELLED; ended ones stay as they are."""
    return rows.withColumn("status", F.when(F.col("status").isin(*OPEN), "CANCELLED").otherwise(F.col("status")))


def to_retry(jobs: DataFrame, batch_id: str, and_cancelled: bool = False) -> DataFrame:
    """Distinct documents of the batch's failed (and cancelled) jobs."""
    states = ["FAILURE"] + ["CANCELLED"] * and_cancelled
    return jobs.where((F.col("batch_id") == batch_id) & F.col("status").isin(*states)).select("document_id").distinct()


def incremental_work(documents: DataFrame, supported: tuple[str, ...], force: bool = False) -> DataFrame:
    """Documents without structured data whose class is unknown or supported; all of them if forced."""
    if force:
        return documents
    return documents.where(F.col("structured_data").isNull() & (F.col("classification").isNull() | F.col("classification").isin(*supported)))
