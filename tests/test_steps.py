"""Chains of steps, their progress as a stream, and the event sink."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import functions as F

from quillframe.operators import steps as chain
from quillframe.operators import workflow
from quillframe.streaming import events
from quillframe.streaming.progress import Progress, run_stream

ROWS = [(1, "ok text"), (2, ""), (3, "skip me"), (4, "bad class"), (5, "other"), (6, "bad answer"), (7, None), (8, "ok again"), (8, "ok again")]


def the_steps(other=None):
    def classify(text):
        if text.startswith("bad class"):
            raise ValueError("no class")
        return "autre" if text == "other" else "devis"

    def analyze(text, kind):
        if text == "bad answer":
            raise RuntimeError("no JSON")
        return {"n": str(len(text)), "kind": kind}

    text = F.coalesce(F.col("text"), F.lit(""))
    extract = chain.NativeStep("TEXT_EXTRACTION", {"nb_mot": F.size(F.split("text", " "))}, skip=F.when(text.startswith("skip"), "unsupported"), error=F.when(text == "", "empty result"))
    return chain.document_steps(extract, other or classify, analyze, ("devis",))


def launched(spark):
    docs = spark.createDataFrame(ROWS, "document_id int, text string").withColumn("value", F.lit("an extra column"))
    return chain.launched(docs, "b1", workflow.STEPS)


def statuses(table):
    return sorted((r.document_id, r.job_status, [s.status for s in r.steps]) for r in table.collect())


OK, F_, S, P, C = "SUCCESS", "FAILURE", "SKIPPED", "PENDING", "CANCELLED"
WANT = [(1, OK, [OK, OK, OK]), (2, F_, [F_, S, S]), (3, S, [S, S, S]), (4, F_, [OK, F_, S]), (5, S, [OK, OK, S]), (6, F_, [OK, OK, F_]), (7, F_, [F_, S, S]), (8, OK, [OK, OK, OK]), (8, OK, [OK, OK, OK])]


def test_chain(spark, tmp_path):
    done = chain.run_steps(launched(spark), the_steps(), str(tmp_path))
    assert statuses(done) == WANT
    rows = {r.document_id: r for r in done.collect()}
    assert rows[1].structured_data == {"n": "7", "kind": "devis"} and rows[1].nb_mot == 2 and rows[1].value == "an extra column"
    assert rows[4].steps[1].error == "no class" and "ValueError" in rows[4].steps[1].traceback and rows[4].classification is None
    assert rows[6].classification == "devis" and rows[6].structured_data is None
    assert rows[3].steps[0].reason == "unsupported" and rows[3].steps[0].error == "" and rows[3].steps[1].started_at is None
    assert rows[5].steps[2].reason == "Not in target classifications: autre."
    assert workflow.batch_status(chain.job_rows(done)).first().status == "FAILURE"
    assert chain.step_rows(done).where("duration >= interval '0' second").count() == 9 + 6 + 5
    again = chain.retried(done, "b1", "b2")
    assert sorted((r.document_id, r.job_status) for r in again.collect()) == [(d, P) for d in (2, 4, 6, 7)]
    assert {s.status for r in again.collect() for s in r.steps} == {P}


def test_only_pending_rows_run(spark, tmp_path):
    first = chain.run_steps(launched(spark), the_steps()[:1], str(tmp_path / "a"))
    assert [s for _, s, _ in statuses(first)] == ["STARTED", F_, S, "STARTED", "STARTED", "STARTED", F_, "STARTED", "STARTED"]
    # the first step again runs nothing; a later one doesn't run before it
    assert statuses(chain.run_step(first, chain.Step("TEXT_EXTRACTION", lambda row: 1 / 0, ("text",), "nb_mot int"))) == statuses(first)
    assert statuses(chain.run_step(launched(spark), the_steps(lambda text: 1 / 0)[1])) == statuses(launched(spark))
    stopped = launched(spark).withColumn("job_status", F.lit(C))
    assert statuses(chain.run_steps(stopped, the_steps(lambda text: 1 / 0), str(tmp_path / "b"))) == [(i, C, [P] * 3) for i in sorted(r[0] for r in ROWS)]
    assert statuses(chain.run_steps(launched(spark).where("false"), the_steps(), str(tmp_path / "c"))) == []


def test_restart_goes_on_behind_whole_stages(spark, tmp_path):
    chain.run_steps(launched(spark), the_steps(), str(tmp_path))
    last = tmp_path / "2-CONTENT_ANALYSIS"
    os.remove(last / "_SUCCESS")  # as if the driver had been lost in the last stage
    back = chain.run_steps(launched(spark), the_steps(lambda text: 1 / 0), str(tmp_path))
    assert statuses(back) == WANT and (last / "_SUCCESS").exists()


def test_progress_of_a_stream(spark, tmp_path):
    jobs = launched(spark)
    jobs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = Progress(expected=len(ROWS))
    spark.streams.addListener(seen)
    try:
        query = run_stream(stream, the_steps(), str(tmp_path / "out"), str(tmp_path / "check"))
        assert seen.wait(120)
        query.awaitTermination()
    finally:
        spark.streams.removeListener(seen)
    totals = [h["total"] for h in seen.history]
    assert len(totals) == 3 and totals == sorted(totals) and totals[-1] == len(ROWS)
    assert {k: seen.counts[k] for k in (OK, F_, S, P, "STARTED")} == {OK: 3, F_: 4, S: 2, P: 0, "STARTED": 0}
    assert str(seen) == "9 / 9, skipped 2, errors 4"
    assert statuses(spark.read.parquet(str(tmp_path / "out"))) == WANT


def test_event_sink_holds_each_batch_once(spark, tmp_path):
    sink, schema = str(tmp_path / "sink"), "name string, user_agent string, referer string, user string"
    assert events.sink_rows(spark, sink, schema).count() == 0
    rows = events.enriched(spark.createDataFrame([("view", "ff", None), ("click", None, "u1"), ("click", None, "u1")], "name string, agent string, who string"), agent="agent", user="who").select("name", "user_agent", "referer", "user")
    write = events.append_batch(sink, "q")
    write(rows, 0)
    write(rows.limit(2), 1)
    write(rows, 0)  # a replay
    os.makedirs(f"{sink}/query=q/batch=2")
    shutil.copy(next(p for p in (tmp_path / "sink/query=q/batch=1").glob("part-*")), f"{sink}/query=q/batch=2/part-0.parquet")  # a batch that died
    back = events.sink_rows(spark, sink, schema)
    assert sorted((r.name, r.user_agent, r.referer, r.user, r.batch) for r in back.where("batch = 0").collect()) == [("click", None, None, "u1", 0)] * 2 + [("view", "ff", None, None, 0)]
    assert {r.batch: r["count"] for r in back.groupBy("batch").count().collect()} == {0: 3, 1: 2}
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start has nothing to do
        events.appended(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), sink, "live", str(tmp_path / "check")).awaitTermination()
    assert events.sink_rows(spark, sink, schema).where("query = 'live'").count() == 3
