from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillframe.operators import dedup, limits, merge, providers, retrieval, workflow
from quillframe.sources import extract, files, remote
from quillframe.streaming import limits as streaming


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", None), (None, "n", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(1, "x", 5), (2, "y", 7), (3, "z", 1)], "k long, v string, t long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(merge.upsert(old, new, "k", ["v", "t"], newer="t")) == rows(spark.createDataFrame([(1, "a", 10), (2, "y", 7), (None, "n", 1), (3, "z", 1)], "k long, v string, t long"))
    twice = new.union(new).union(spark.createDataFrame([(None, "n", 2)], "k long, v string, t long"))
    assert merge.insert_ignore(old, twice, ["k"]).count() == 4
    assert rows(merge.update_by_key(old, new.where("k = 1"), "k", ["v"])) == [(1, "x", 10), (2, "b", None), (None, "n", 1)]
    assert merge.delete_keys(old, new, "k").count() == 1


def test_dedup(spark):
    f = spark.createDataFrame([("h", "b.txt", "x/b.txt"), ("h", "a.txt", "x/y/a.txt"), ("g", "c.txt", "c.txt")], "hash string, filename string, file string")
    assert sorted(r.file for r in dedup.keep_preferred_path(f).collect()) == ["c.txt", "x/b.txt"]
    assert [r.file for r in dedup.keep_preferred_path(f, f.where("hash = 'g'")).collect()] == ["x/b.txt"]
    e = spark.createDataFrame([("a", 1, "n"), ("a", 2, "n"), ("b", 1, "n")], "id string, t long, name string")
    assert sorted(map(tuple, dedup.consistent(e, "id", "t").collect())) == [("a", 2, "n"), ("b", 1, "n")]
    with pytest.raises(PySparkException, match="conflicting rows of b"):
        dedup.consistent(e.union(spark.createDataFrame([("b", 1, "m")], e.schema)), "id", "t").withColumn("ok", F.lit(1)).collect()


def test_workflow(spark):
    steps = workflow.fan_out(spark.createDataFrame([("d1",), ("d2",)], "document_id string"), "b")
    assert steps.count() == 6 and workflow.job_status(steps).where("status = 'STARTED'").count() == 2
    done = steps.withColumn("status", F.when((F.col("document_id") == "d1") & (F.col("order") == 2), "FAILURE").otherwise("SUCCESS"))
    jobs = workflow.job_status(done)
    assert {r.status for r in jobs.collect()} == {"SUCCESS", "FAILURE"} and workflow.batch_status(jobs).first().status == "FAILURE"
    assert workflow.cancelled(steps).where("status = 'CANCELLED'").count() == 6
    named = done.groupBy("batch_id", "job_id", "document_id").agg(F.max(F.when(F.col("status") == "FAILURE", "FAILURE")).alias("status"))
    assert [r.document_id for r in workflow.to_retry(named, "b").collect()] == ["d1"]
    gates = spark.createDataFrame([("SUCCESS", "PENDING"), ("FAILURE", "PENDING"), ("STARTED", "PENDING"), ("FAILURE", "SUCCESS")], "a string, b string")
    assert [r[0] for r in gates.select(workflow.gated(F.col("a"), F.col("b"))).collect()] == ["PENDING", "SKIPPED", "PENDING", "SUCCESS"]


def test_limits(spark):
    calls = spark.createDataFrame([("k", 0.0, 1), ("k", 0.0, 2), ("k", 0.0, 3), ("k", 100.0, 4)], "k string, at double, i int")
    assert [r.delay for r in limits.gate_starts(calls, "k", "at", ["i"], 6.0).orderBy("i").collect()] == [0.0, 6.0, 12.0, 0.0]
    times = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 10, 11)], "k string, at double")
    assert [(r["count"], r.limited) for r in limits.window_counts(times, "k", "at", 10, 2).orderBy("call_no").collect()] == [(1, False), (2, False), (3, True), (1, False), (2, False)]


def test_counts_of_a_hot_key(spark):
    n = 200_000
    calls = spark.range(n).selectExpr("if(id % 10 = 0, null, if(id % 3 = 0, id % 7, 99)) as k", "cast(id * 37 % 100003 as double) as at")
    got = limits.window_counts(calls, "k", "at", 50, 9)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    want, by_key = [], {}
    for i in range(n):
        by_key.setdefault(None if i % 10 == 0 else i % 7 if i % 3 == 0 else 99, []).append(float(i * 37 % 100003))
    for k, times in by_key.items():
        count, expiry = 0, float("-inf")
        for no, t in enumerate(sorted(times)):
            count, expiry = (count + 1, expiry) if t < expiry else (1, t + 50)
            want.append((k is None, k or 0, no, t, count, count > 9))
    rows = got.toPandas()
    mine = sorted(zip(rows["k"].isna(), rows["k"].fillna(0).astype(int), rows["call_no"], rows["at"], rows["count"], rows["limited"]))
    assert mine == sorted(want)


def test_stream_counts_like_the_batch(spark, tmp_path):
    times = spark.createDataFrame([(f"k{i % 3}", float(i * 3)) for i in range(60)], "k string, at double")
    for i, part in enumerate((times.where("at < 90"), times.where("at >= 90"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.counted_calls(stream, "k", "at", 20, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r["at"], r["count"], r.limited) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r.k, r["at"], r["count"], r.limited) for r in limits.window_counts(times, "k", "at", 20, 2).collect())
    assert got == want


def test_retrieval(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox runs", "red fox sleeps", "blue whale swims", "green whale"])], "doc_id int, text string")
    w = retrieval.tfidf(docs, ["doc_id"], "text")
    assert {r.term for r in w.select("term").distinct().collect()} == {"red", "fox", "red fox", "whale"}
    assert all(abs(r[0] - 1) < 1e-9 for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight"))).select(F.col("sum((weight * weight))")).collect())
    hits = spark.createDataFrame([(1, 800, "b"), (1, 0, "a")], "doc_id int, start_char int, text string")
    assert retrieval.context(hits, "doc_id").first().context == "a" + retrieval.SEPARATOR + "b"


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_and_texts(spark):
    inner = _zip({"deep.txt": b"deep"})
    rows = spark.createDataFrame([("a.zip", bytearray(_zip({"x/one.txt": b"one", "in.zip": inner, ".hidden": b""}))), ("b.txt", bytearray(b"two")), ("bad.zip", bytearray(b"PK\x03\x04rubbish"))], "file string, content binary")
    assert sorted((r.file, r.parent) for r in files.unzipped(rows).collect()) == [("a.zip/in.zip/deep.txt", "a.zip/in.zip"), ("a.zip/x/one.txt", "a.zip"), ("b.txt", None), ("bad.zip", None)]
    office = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
    ods = f'<d xmlns:o="{office}" xmlns:t="urn:t" xmlns:x="urn:x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="2"/></t:table-row><t:table-row><t:table-cell/></t:table-row><t:table-row><t:table-cell><x:p>b</x:p></t:table-cell><t:table-cell><x:p>c</x:p></t:table-cell></t:table-row></t:table></d>'
    docx = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>'
    given = [("ods", _zip({"content.xml": ods})), ("docx", _zip({"word/document.xml": docx})), ("txt", b"plain \xff\x00text"), ("docx", b"broken"), ("exe", b"x"), ("pdf", b"%PDF")]
    df = spark.createDataFrame([(i, k, bytearray(c)) for i, (k, c) in enumerate(given)], "i int, extension string, content binary")
    got = extract.extracted(df, ocr=lambda data, kind: f"scanned {kind}").orderBy("i").collect()
    assert got[0].text == "## S\n| a |  |\n| --- | --- |\n| b | c |"
    assert got[1].text == "Hello\nWorld" and got[1].nb_mot == 2
    assert got[2].text == "plain text" and got[3].error.startswith("BadZipFile") and got[4].error == "unsupported: exe"
    assert (got[5].text, got[5].is_ocr) == ("scanned pdf", True)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1234567890_a.txt").write_bytes(b"%PDF-1")
    profile = files.folder_profile(spark, f"{tmp_path}/in")
    assert (profile.first().extension, profile.first().size) == ("pdf", 6) and files.new_files(profile, profile).count() == 0
    (tmp_path / "i.csv").write_text("num;poste\n1;2\n")
    assert files.delimited(spark, f"{tmp_path}/i.csv", "num string, poste int").first().poste == 2
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"id": 3, "fields": {"a": "x"}}]}))
    assert tuple(files.records(spark, f"{tmp_path}/r.json", "a:string").first()) == (3, "x")
    (tmp_path / "OA_GA.json").write_text(json.dumps([{"alerte": "Création", "num_ej": "1"}]))
    spark.dataSource.register(remote.ActivitySource)
    got = spark.read.format("activity").option("folder", str(tmp_path)).option("scopes", "OA/GA,OB/GB").load().collect()
    assert [(r.alerte, r.num_ej, r.pur_org, r.error) for r in got] == [("Création", "1", "OA", "date_reception is missing; pur_org is missing; pur_group is missing")]


def test_retries():
    import urllib.error

    pauses, left = [], [429, 503]

    def call():
        if left:
            raise urllib.error.HTTPError("u", left.pop(0), "no", {}, None)
        return "done"

    assert remote.with_retries(call, sleep=pauses.append) == "done"
    assert 60 <= pauses[0] <= 66 and 20 <= pauses[1] <= 22
    left[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        remote.with_retries(call, sleep=pauses.append)


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a: b"), (2, "c: d")], "i int, prompt string")
    assert providers.asked(rows, "prompt", providers.echo_model).where("error is null").count() == 2

    def broken(prompts):
        raise RuntimeError("down")

    assert {r.error for r in providers.asked(rows, "prompt", broken).collect()} == {"RuntimeError: down"}
    assert [len(r.embedding) for r in providers.embedded(rows, "prompt", providers.hash_embedder, 64).collect()] == [64, 64]
    schema = providers.response_schema([{"output_field": "a"}, {"output_field": "b", "schema": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}}}}])
    assert schema["required"] == ["a", "b"] and providers.spark_type(schema) == "struct<`a`:string,`b`:array<struct<`n`:bigint>>>"
    with pytest.raises(ValueError):
        providers.response_schema([{"output_field": "a", "schema": "text"}])
    df = spark.createDataFrame([(["x", "Devis"],), (["y"],)], "a array<string>")
    assert [r[0] for r in df.select(providers.mapped_answer(F.col("a"), {"Devis": "devis"})).collect()] == ["devis", providers.UNKNOWN]
    pages = spark.createDataFrame([(["p", "q"],)], "a array<string>").select(providers.page_marked(F.col("a"))).first()[0]
    assert pages == "[[PAGE 1 / 2]]\np\n[[FIN PAGE 1 / 2]]\n\n[[PAGE 2 / 2]]\nq\n[[FIN PAGE 2 / 2]]"


def test_drawings(spark):
    from quillframe.operators import geometry

    points = [(0, 0.0, 0.0), (1, 6.0, 0.0), (2, 12.0, 0.0), (3, None, None), (4, 13.0, 1.0), (5, 0.0, 10.0)]
    df = spark.createDataFrame([("p", i, x, y, 1) for i, x, y in points], "page string, i long, x double, y double, segments int")
    got = {r.group_no: (r.members, r.segments) for r in geometry.grouped(df, ["page"], "i").collect()}
    leaders, want = [], {}
    for i, x, y in points:
        if x is None:
            continue
        at = next((n for n, (a, b) in enumerate(leaders) if ((a - x) ** 2 + (b - y) ** 2) ** 0.5 <= 10), None)
        if at is None:
            at = len(leaders)
            leaders.append((x, y))
        want.setdefault(at + 1, []).append(i)
    assert got == {k: (v, len(v)) for k, v in want.items()}
    marks = spark.createDataFrame([(10.0, 2), (10.0, 1), (30.0, 2)], "w double, n int").select(geometry.checkbox_mark(F.col("w"), F.col("w"), F.col("n"))).collect()
    assert [r[0] for r in marks] == ["[X]", "[ ]", None]


def test_classes(spark):
    from quillframe.functions import classes

    assert len({k for k, _, _ in classes.CLASSES}) == len({n for _, n, _ in classes.CLASSES}) == 63
    df = classes.catalogue(spark)
    assert df.where(classes.key_of(F.col("full_name")) != F.col("key")).count() == 0
    assert df.limit(1).select(classes.short_name_of(F.lit("other"))).first()[0] == "other"
