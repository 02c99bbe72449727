"""Queries over batches, steps and rate limits, made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count_words
from ..operators import geometry, limits, workflow
from ..operators import steps as chain
from ..operators.ranks import scratch_folder
from .documents import WORDS_SQL
from .tables import STEPS_SQL, read, steps_from_events


def batch_progress_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in (*workflow.STEPS, "OTHER")])).alias("step_type"))
    return workflow.step_progress(steps_from_events(spark, sf_dir), kinds)


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.batch_status(workflow.job_status(steps_from_events(spark, sf_dir)))


def stuck_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_from_events(spark, sf_dir)
    batches = workflow.batch_status(workflow.job_status(steps))
    return workflow.stuck_batches(batches, steps, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("batch_id", "last_finished")


def cancel_and_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after cancelling what is open, and whether a retry takes them."""
    jobs = workflow.cancelled(workflow.job_status(steps_from_events(spark, sf_dir)))
    return jobs.withColumn("retried", F.col("status").isin("FAILURE", "CANCELLED"))


def step_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return workflow.fan_out(docs, "b1").select("document_id", "step_type", "order", "status")


def next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("order")).distinct()
    return workflow.next_step(lines)


def rate_gate_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user, ten a minute at most: seconds that each waits."""
    e = read(spark, sf_dir, "events")
    at = F.unix_timestamp(F.date_trunc("day", "ts")).cast("double")
    calls = e.select("user_id", "event_id", at.alias("at"))
    return limits.gate_starts(calls, "user_id", "at", ["event_id"], 6.0).select("event_id", "delay")


def rate_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user in windows of two days that the first one opens, five at most."""
    calls = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").cast("double").alias("at"))
    return limits.window_counts(calls, "user_id", "at", 172_800, 5)


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a user's events as sessions with gaps under a day."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    new = F.coalesce((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")))) >= 86400, F.lit(True))
    rows = e.withColumn("new", new.cast("int")).groupBy("user_id").agg(F.sum("new").alias("n_sessions"), F.count("*").alias("n_events"))
    return rows


TARGETS = ("devis", "rib")
_CLASSES = ("devis", "kbis", "rib", "autre")


def _classify(text: str) -> str:
    if len(text) % 11 == 0:
        raise ValueError(f"no class among the answers, {len(text)} characters")
    return _CLASSES[len(text) % 4]


def _analyze(text: str, kind: str) -> dict[str, str]:
    if len(text) % 13 == 0:
        raise RuntimeError("the answer is no JSON")
    return {"start": text[:20], "kind": kind}


def _step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through three steps: some kinds are unsupported, short texts empty, some answers fail, every 17th job is cancelled before."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "source")
    size = F.length("text")
    extract = chain.NativeStep(
        "TEXT_EXTRACTION",
        {"nb_mot": count_words(F.col("text")), "is_ocr": F.lit(False)},
        skip=F.when(F.col("source").isin("src3", "src7"), F.concat(F.lit("Unsupported file type: "), "source")),
        error=chain.any_of({"Failed to extract text - empty result": F.coalesce(size, F.lit(0)) < 200}),
    )
    jobs = chain.launched(docs, "b1", workflow.STEPS, status=F.when(F.col("document_id") % 17 == 0, "CANCELLED").otherwise("PENDING"))
    return chain.run_steps(jobs, chain.document_steps(extract, _classify, _analyze, TARGETS), scratch_folder(spark, "steps"))


def step_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job, step statuses, error and results of each document after three steps. Null texts fail as empty; repeated rows are jobs of their own; an empty table gives none."""
    rows = _step_table(spark, sf_dir)
    at = lambda i, field: F.get("steps", F.lit(i))[field]
    names = ("extraction", "classification", "analysis")
    failed = F.filter("steps", lambda s: s["traceback"] != "")
    return rows.select(
        "document_id", "job_status", *[at(i, "status").alias(f"{n}_status") for i, n in enumerate(names)], *[F.array_join(F.filter(F.transform("steps", lambda s: s[n]), lambda e: e != ""), "|").alias(f"{n}s") for n in ("error", "reason")],
        F.size(failed).alias("n_tracebacks"), "nb_mot", F.col("classification").alias("class"), F.col("structured_data")["start"].alias("start"),
    )


def step_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same run as the batch's monitor shows it: status of the batch, and of each step type the progress, skipped and failed steps."""
    rows = _step_table(spark, sf_dir)
    kinds = spark.createDataFrame([(s,) for s in workflow.STEPS], "step_type string")
    batch = workflow.batch_status(chain.job_rows(rows)).select("batch_id", F.col("status").alias("batch_status"), F.col("total").alias("jobs"))
    steps = chain.step_rows(rows).groupBy("batch_id", "step_type").agg(F.count_if(~F.col("status").isin(*workflow.OPEN)).alias("progress"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), F.count_if(F.col("status") == "FAILURE").alias("errors"), F.count("*").alias("total"))
    return batch.join(steps, "batch_id").join(F.broadcast(kinds), "step_type")


def drawing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings' first two components as drawings on a page a label: each drawing's group and its first one, and the marks of small squares."""
    rows = read(spark, sf_dir, "embeddings")
    x = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 200, 3)
    side = F.when(F.col("vec_id") % 3 == 0, 10.0).when(F.col("vec_id") % 3 == 1, 14.0).otherwise(20.0)
    drawings = rows.select(F.col("label").alias("page"), F.col("vec_id").alias("i"), x(0).alias("x"), x(1).alias("y"), (F.col("vec_id") % 2).alias("segments"), side.alias("width"), (side + F.col("vec_id") % 4).alias("height"))
    groups = geometry.claimed(drawings, ["page"], "i")
    marks = geometry.checkboxes(drawings, ["page"], "i", groups=groups)
    return groups.join(marks.select("page", "i", "mark"), ["page", "i"], "left").select("page", "i", "leader", "group_no", "mark")


QUERIES = {f.__name__: f for f in (batch_progress_steps, status_rollup, stuck_batches, cancel_and_retry, step_fan_out, next_step, rate_gate_delays, rate_limit_counts, activity_sessions, step_run, step_run_rollup, drawing_groups)}

_JOBS = """, jobs AS (SELECT batch_id, job_id, CASE WHEN bool_or(status IN ('PENDING', 'STARTED')) THEN 'STARTED' WHEN bool_or(status = 'FAILURE') THEN 'FAILURE'
  WHEN bool_or(status = 'CANCELLED') THEN 'CANCELLED' WHEN bool_or(status = 'SKIPPED') THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM steps GROUP BY ALL),
  batches AS (SELECT batch_id, CASE WHEN bool_or(status IN ('PENDING', 'STARTED')) THEN 'STARTED' WHEN bool_or(status = 'FAILURE') THEN 'FAILURE' ELSE 'SUCCESS' END AS status, count(*) AS total FROM jobs GROUP BY batch_id)"""

_RUN = f"""WITH d AS (SELECT doc_id, text, source, coalesce(length(text), 0) AS n, doc_id % 17 = 0 AS stopped FROM documents),
  a AS (SELECT *, CASE WHEN stopped THEN 'PENDING' WHEN source IN ('src3', 'src7') THEN 'SKIPPED' WHEN n < 200 THEN 'FAILURE' ELSE 'SUCCESS' END AS s1 FROM d),
  b AS (SELECT *, CASE WHEN stopped THEN 'PENDING' WHEN s1 <> 'SUCCESS' THEN 'SKIPPED' WHEN n % 11 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS s2, ['devis', 'kbis', 'rib', 'autre'][n % 4 + 1] AS kind FROM a),
  c AS (SELECT *, CASE WHEN stopped THEN 'PENDING' WHEN s2 <> 'SUCCESS' OR kind NOT IN ('devis', 'rib') THEN 'SKIPPED' WHEN n % 13 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS s3 FROM b),
  r AS (SELECT *, CASE WHEN stopped THEN 'CANCELLED' WHEN 'FAILURE' IN (s1, s2, s3) THEN 'FAILURE' WHEN 'SKIPPED' IN (s1, s2, s3) THEN 'SKIPPED' ELSE 'SUCCESS' END AS job_status FROM c)"""

ORACLE_SQL = {
    "step_run": f"""{_RUN} SELECT doc_id AS document_id, job_status, s1 AS extraction_status, s2 AS classification_status, s3 AS analysis_status,
  CASE WHEN s1 = 'FAILURE' THEN 'Failed to extract text - empty result' WHEN s2 = 'FAILURE' THEN 'no class among the answers, ' || n || ' characters' WHEN s3 = 'FAILURE' THEN 'the answer is no JSON' ELSE '' END AS errors,
  CASE WHEN s1 = 'SKIPPED' THEN 'Unsupported file type: ' || source WHEN s2 = 'SUCCESS' AND s3 = 'SKIPPED' THEN 'Not in target classifications: ' || kind || '.' ELSE '' END AS reasons,
  ((s2 = 'FAILURE')::INT + (s3 = 'FAILURE')::INT) AS n_tracebacks, CASE WHEN s1 = 'SUCCESS' THEN {WORDS_SQL} END AS nb_mot, CASE WHEN s2 = 'SUCCESS' THEN kind END AS class, CASE WHEN s3 = 'SUCCESS' THEN left(text, 20) END AS start FROM r""",
    "step_run_rollup": f"""{_RUN}, s AS (SELECT 'TEXT_EXTRACTION' AS step_type, s1 AS status FROM r UNION ALL SELECT 'CLASSIFICATION', s2 FROM r UNION ALL SELECT 'CONTENT_ANALYSIS', s3 FROM r)
  SELECT 'b1' AS batch_id, (SELECT CASE WHEN count(*) FILTER (job_status = 'FAILURE') > 0 THEN 'FAILURE' ELSE 'SUCCESS' END FROM r) AS batch_status, (SELECT count(*) FROM r) AS jobs, step_type,
  count(*) FILTER (status <> 'PENDING') AS progress, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILURE') AS errors, count(*) AS total FROM s GROUP BY step_type""",
    "batch_progress_steps": f"""{STEPS_SQL} SELECT k AS step_type, count(*) FILTER (status NOT IN ('PENDING', 'STARTED')) AS progress, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILURE') AS errors, count(status) AS total
  FROM (SELECT unnest(['TEXT_EXTRACTION', 'CLASSIFICATION', 'CONTENT_ANALYSIS', 'OTHER']) AS k) LEFT JOIN steps ON step_type = k GROUP BY k""",
    "status_rollup": f"{STEPS_SQL}{_JOBS} SELECT * FROM batches",
    "stuck_batches": f"{STEPS_SQL}{_JOBS} SELECT batch_id, max(finished_at) AS last_finished FROM batches b JOIN steps s USING (batch_id) WHERE b.status IN ('PENDING', 'STARTED') GROUP BY batch_id HAVING max(finished_at) < TIMESTAMP '2024-01-30 11:30:00'",
    "cancel_and_retry": f"{STEPS_SQL}{_JOBS} SELECT batch_id, job_id, CASE WHEN status = 'STARTED' THEN 'CANCELLED' ELSE status END AS status, status IN ('STARTED', 'FAILURE', 'CANCELLED') AS retried FROM jobs",
    "step_fan_out": "SELECT doc_id AS document_id, s AS step_type, o AS \"order\", 'PENDING' AS status FROM documents, (VALUES ('TEXT_EXTRACTION', 0), ('CLASSIFICATION', 1), ('CONTENT_ANALYSIS', 2)) v(s, o)",
    "next_step": "SELECT l_orderkey AS job_id, l_linenumber AS \"order\", lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_order FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
    "rate_gate_delays": """WITH c AS (SELECT event_id, user_id, epoch(date_trunc('day', ts))::DOUBLE AS "at", row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), event_id) - 1 AS i FROM events)
  SELECT event_id, i * 6.0::DOUBLE + max("at" - i * 6.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) - "at" AS delay FROM c""",
    "rate_limit_counts": """WITH RECURSIVE c AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS "at", (row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) - 1)::INT AS call_no FROM events),
  r AS (SELECT user_id, call_no, "at", 1::BIGINT AS count, "at" + 172800 AS expiry FROM c WHERE call_no = 0
  UNION ALL SELECT c.user_id, c.call_no, c."at", CASE WHEN c."at" < r.expiry THEN r.count + 1 ELSE 1 END, CASE WHEN c."at" < r.expiry THEN r.expiry ELSE c."at" + 172800 END FROM r JOIN c ON c.user_id = r.user_id AND c.call_no = r.call_no + 1)
  SELECT user_id, call_no, "at", count, count > 5 AS limited FROM r""",
    "activity_sessions": """WITH e AS (SELECT user_id, floor(epoch(ts)) AS s, lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)
  SELECT user_id, count(*) FILTER (p IS NULL OR s - p >= 86400) AS n_sessions, count(*) AS n_events FROM e GROUP BY user_id""",
    "drawing_groups": """WITH p AS (SELECT label AS page, vec_id AS i, round(embedding[1]::DOUBLE * 200, 3) AS x, round(embedding[2]::DOUBLE * 200, 3) AS y, vec_id % 2 AS segments, [10, 14, 20][vec_id % 3 + 1] AS w, [10, 14, 20][vec_id % 3 + 1] + vec_id % 4 AS h FROM embeddings WHERE embedding IS NOT NULL),
  l AS (SELECT page, list({'i': i, 'x': x, 'y': y} ORDER BY i) AS ps FROM p GROUP BY page),
  g AS (SELECT page, list_reduce(ps, lambda acc, q: CASE WHEN len(list_filter(acc, lambda a: sqrt((a.x - q.x) * (a.x - q.x) + (a.y - q.y) * (a.y - q.y)) <= 10)) > 0 THEN acc ELSE list_append(acc, q) END, ps[1:1]) AS leaders FROM l),
  c AS (SELECT p.*, list_filter(range(1, len(leaders) + 1), lambda k: sqrt((leaders[k].x - x) * (leaders[k].x - x) + (leaders[k].y - y) * (leaders[k].y - y)) <= 10)[1] AS group_no, leaders FROM p JOIN g USING (page)),
  s AS (SELECT page, group_no, sum(segments) AS n FROM c GROUP BY ALL)
  SELECT page, i, leaders[group_no].i AS leader, group_no, CASE WHEN h - w <= 2 AND h * 0.03528 > 0.25 AND h * 0.03528 < 0.5 THEN CASE WHEN n >= 2 THEN '[X]' ELSE '[ ]' END END AS mark FROM c JOIN s USING (page, group_no)""",
}
