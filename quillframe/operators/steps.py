"""Chains of steps over documents: every stage is one pass that runs what is due, and ends as a written table."""

from __future__ import annotations

import datetime
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from .workflow import OPEN

_STEP = "struct<step_type:string,`order`:int,status:string,error:string,traceback:string,reason:string,started_at:timestamp,finished_at:timestamp>"


def _state(step_type: Column, order: Column, status: Column, out: Column | None = None) -> Column:
    """A step's entry: why it failed (error, traceback) or was skipped (reason), and when it ran, as the outcome says."""
    text = lambda n: F.lit("") if out is None else F.coalesce(out[n], F.lit(""))
    time = lambda n: F.lit(None).cast("timestamp") if out is None else out[n]
    error = F.when(status == "FAILURE", text("error")).otherwise(F.lit(""))
    return F.struct(step_type.alias("step_type"), order.alias("order"), status.alias("status"), error.alias("error"), text("traceback").alias("traceback"), text("skip").alias("reason"), time("started_at").alias("started_at"), time("finished_at").alias("finished_at"))


class Skip(Exception):
    """Raised by a step that has nothing to do for a document."""


@dataclass(frozen=True)
class Step:
    """A step that runs Python on each row: `run` takes the columns `reads` as a dict and gives those of `writes` (a DDL), or raises."""

    name: str
    run: Callable[[dict], dict]
    reads: tuple[str, ...]
    writes: str

    def outcome(self, due: Column) -> Column:
        kind = StructType([StructField(n, StringType()) for n in ("skip", "error", "traceback")] + [StructField(n, TimestampType()) for n in ("started_at", "finished_at")] + [StructField("value", StructType.fromDDL(self.writes))])
        run, names = self.run, [f.name for f in StructType.fromDDL(self.writes)]

        def now() -> datetime.datetime:
            return datetime.datetime.now(datetime.timezone.utc)

        def attempt(row: dict) -> dict:
            out: dict = {"started_at": now()}
            try:
                got = run(row)
                out["value"] = {n: got.get(n) for n in names}
            except Skip as e:
                out["skip"] = str(e)
            except Exception as e:  # belongs to the row
                out |= {"error": str(e), "traceback": traceback.format_exc()}
            return out | {"finished_at": now()}

        def attempted(wanted: pa.Array, rows: pa.Array) -> pa.Array:
            some = iter(rows.filter(wanted).to_pylist())
            return pa.array([attempt(next(some)) if w else None for w in wanted.to_pylist()], to_arrow_type(kind))

        return F.arrow_udf(attempted, kind)(F.coalesce(due, F.lit(False)), F.struct(*self.reads))


@dataclass(frozen=True)
class NativeStep:
    """A step of column expressions: values by column name; a text in `skip` or `error`, where not null, ends the row so."""

    name: str
    values: dict[str, Column]
    skip: Column | None = None
    error: Column | None = None

    def outcome(self, due: Column) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        value = F.struct(*[c.alias(n) for n, c in self.values.items()])
        return F.when(due, F.struct(text(self.skip).alias("skip"), text(self.error).alias("error"), F.lit("").alias("traceback"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), value.alias("value")))


def launched(documents: DataFrame, batch_id: str, steps: Sequence[str], key: str = "document_id", status: Column | None = None) -> DataFrame:
    """documents as the jobs of a batch: job_id, batch_id, job_status and steps (array, all PENDING) beside their own columns."""
    blank = [_state(F.lit(s), F.lit(i), F.lit("PENDING")) for i, s in enumerate(steps)]
    job = F.sha2(F.concat_ws("/", F.lit(batch_id), F.col(key).cast("string")), 256)
    return documents.select("*", job.alias("job_id"), F.lit(batch_id).alias("batch_id"), (F.lit("PENDING") if status is None else status).alias("job_status"), F.array(*blank).cast(f"array<{_STEP}>").alias("steps"))


def run_step(table: DataFrame, step: Step | NativeStep) -> DataFrame:
    """table after one step: rows whose step is PENDING, in a job that is open, have run; nothing else has.

    A step ends as SUCCESS with its columns set, as SKIPPED with a reason, or as FAILURE with error and traceback. After a skip or a failure what
    is still pending in the job is skipped and the job ends likewise; a job without open steps is a SUCCESS. A step waits for those of
    lower order, so that an open one before it keeps it PENDING. Rows of other jobs pass as they are, in one pass without a shuffle.
    """
    mine = F.get(F.filter("steps", lambda s: s["step_type"] == step.name), F.lit(0))
    blocked = F.exists("steps", lambda s: (s["order"] < mine["order"]) & s["status"].isin(*OPEN))
    due = F.coalesce((mine["status"] == "PENDING") & F.col("job_status").isin(*OPEN) & ~blocked, F.lit(False))
    rows = table.withColumn("__due", due).withColumn("__out", step.outcome(F.col("__due")))
    out = F.col("__out")
    status = F.when(out["skip"].isNotNull(), F.lit("SKIPPED")).when(out["error"].isNotNull(), F.lit("FAILURE")).otherwise(F.lit("SUCCESS"))
    rows = rows.withColumn("__status", F.when(F.col("__due"), status))
    ended = F.col("__status").isin("SKIPPED", "FAILURE")

    def moved(s: Column) -> Column:
        ran, skipped = _state(s["step_type"], s["order"], F.col("__status"), out), _state(s["step_type"], s["order"], F.lit("SKIPPED"))
        return F.when(s["step_type"] == step.name, ran).when(ended & (s["status"] == "PENDING"), skipped).otherwise(s)

    rows = rows.withColumn("steps", F.when(F.col("__due"), F.transform("steps", moved)).otherwise(F.col("steps")))
    open_ = F.exists("steps", lambda s: s["status"].isin(*OPEN))
    job = F.when(~F.col("__due"), F.col("job_status")).when(ended, F.col("__status")).when(open_, F.lit("STARTED")).otherwise(F.lit("SUCCESS"))
    names = list(step.values) if isinstance(step, NativeStep) else StructType.fromDDL(step.writes).names
    sets = {n: F.when(F.col("__status") == "SUCCESS", out["value"][n]).otherwise(F.col(n) if n in table.columns else F.lit(None)) for n in names}
    return rows.withColumns({"job_status": job, **sets}).drop("__due", "__out", "__status")


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_steps(table: DataFrame, steps: Sequence[Step | NativeStep], folder: str) -> DataFrame:
    """table after all steps; each stage is written to its own place under folder, a store that the whole cluster shares.

    A run that is started again with the same folder reads the stages that were written whole and goes on behind them, so a lost
    driver costs the stage at hand; a lost executor costs its tasks.
    """
    spark, now = table.sparkSession, table
    for k, step in enumerate(steps):
        path = f"{folder.rstrip('/')}/{k}-{step.name}"
        if not _complete(spark, path):
            run_step(now, step).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
    return now


def step_rows(table: DataFrame) -> DataFrame:
    """A row a step, as workflow's roll-ups take them: batch_id, job_id, job_status, step_type, order, status, error, traceback, reason, started_at, finished_at, duration."""
    rows = table.select("batch_id", "job_id", "job_status", F.explode("steps").alias("s")).select("batch_id", "job_id", "job_status", "s.*")
    return rows.withColumn("duration", F.col("finished_at") - F.col("started_at"))


def job_rows(table: DataFrame) -> DataFrame:
    """batch_id, job_id, status of each job, as workflow.batch_status takes them."""
    return table.select("batch_id", "job_id", F.col("job_status").alias("status"))


def retried(table: DataFrame, batch_id: str, new_batch: str, and_cancelled: bool = False, key: str = "document_id") -> DataFrame:
    """The failed (and cancelled) documents of a batch as jobs of a new one, a document once, what they were given kept."""
    states = ["FAILURE"] + ["CANCELLED"] * and_cancelled
    names = F.transform("steps", lambda s: _state(s["step_type"], s["order"], F.lit("PENDING")))
    rows = table.where((F.col("batch_id") == batch_id) & F.col("job_status").isin(*states)).dropDuplicates([key])
    job = F.sha2(F.concat_ws("/", F.lit(new_batch), F.col(key).cast("string")), 256)
    return rows.withColumns({"job_id": job, "batch_id": F.lit(new_batch), "job_status": F.lit("PENDING"), "steps": names})


def document_steps(extract: Step | NativeStep, classify: Callable[[str], str], analyze: Callable[[str, str], dict], targets: Sequence[str] | None = None, text: str = "text") -> list[Step | NativeStep]:
    """The three steps of a document: text extraction, as given; its class; and, for the classes asked for (all if None), what it says."""

    def classified(row: dict) -> dict:
        return {"classification": classify(row[text])}

    def analyzed(row: dict) -> dict:
        if targets is not None and row["classification"] not in targets:
            raise Skip(f"Not in target classifications: {row['classification']}.")
        return {"structured_data": analyze(row[text], row["classification"])}

    return [extract, Step("CLASSIFICATION", classified, (text,), "classification string"), Step("CONTENT_ANALYSIS", analyzed, (text, "classification"), "structured_data map<string,string>")]


def progress(table: DataFrame, name: str = "progress") -> tuple[DataFrame, list[str]]:
    """table, counted as it is written, by status of its jobs: observed metrics `name` with a number for each status and `total`."""
    statuses = ["PENDING", "STARTED", "SUCCESS", "FAILURE", "CANCELLED", "SKIPPED"]
    counts = [F.count_if(F.col("job_status") == s).alias(s) for s in statuses]
    return table.observe(name, *counts, F.count(F.lit(1)).alias("total")), statuses


def any_of(conditions: dict[str, Column]) -> Column:
    """The message of the first condition that holds; null if none does: what a NativeStep's skip and error take."""
    return reduce(lambda rest, c: F.when(c[1], F.lit(c[0])).otherwise(rest), reversed(list(conditions.items())), F.lit(None).cast("string"))
