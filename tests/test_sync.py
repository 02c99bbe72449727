"""Synchronisation from activities to analysed documents, and its commits."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillframe.operators import steps, sync

ACTIVITY = "alerte string, num_ej string, date_reception timestamp, pur_org string, pur_group string, error string"
METADATA = "num_ej string, id string, filename string, mime_type string, size long, created string"


def day(n):
    return datetime(2024, 1, n)


def place(rows):
    return rows.select("external_id", F.concat(F.lit("f/"), "external_id", F.lit("_"), "filename").alias("file"), "filename", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def test_commits_are_whole(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path / "s"))
    assert store.read("scopes").count() == 0 and store.versions() == {}
    scope = spark.createDataFrame([("A", "G")], "pur_org string, pur_group string")
    store.commit({"scopes": scope})
    bad = spark.createDataFrame([("x",)], "num_ej string").withColumn("external_updated_at", F.raise_error(F.lit("lost")).cast("timestamp"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"scopes": scope.limit(0), "engagements": bad})
    assert store.read("scopes").count() == 1 and store.read("engagements").count() == 0  # neither changed
    store.commit({"scopes": store.read("scopes").union(scope)})
    store.vacuum()
    assert store.read("scopes").count() == 2 and len(list((tmp_path / "s/scopes").iterdir())) == 1


def test_from_activity_to_analysis(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path / "s"))
    acts = spark.createDataFrame([("a", "1", day(2), "A", "G", None), ("a", "1", day(3), "A", "G", None), ("a", "2", day(1), "A", "H", None), ("a", "9", None, "A", "G", "bad")], ACTIVITY)
    docs = [("1", "d1", "n1.pdf", 3, "2024"), ("1", "d2", "n2.pdf", 3, "2024"), ("2", "d2", "n2.pdf", 3, "2024"), ("2", "d3", "n3.pdf", 3, "2024"), ("2", "d4", "n4.pdf", 30 * 2**20, "2024")]
    metadata = spark.createDataFrame([(e, i, n, None, s, c) for e, i, n, s, c in docs], METADATA)
    contents = {"d1": b"same", "d2": b"same", "d3": b"bad text", "d4": None}
    broken = ["d4"]

    def fetch(key):
        if key in broken:
            raise OSError("down")
        return contents[key] or b"late"

    def classify(text):
        return "devis"

    def analyze(text, kind):
        if "bad" in text:
            raise ValueError("bad")
        return {"text": text}

    texts = {hashlib.sha256(v).hexdigest(): v.decode() for v in (b"same", b"bad text", b"late")}
    text = F.coalesce(*[F.when(F.col("hash") == h, t) for h, t in texts.items()])
    chain = steps.document_steps(steps.NativeStep("TEXT_EXTRACTION", {"text": text}), classify, analyze)
    asked = lambda keys: metadata.join(keys, "num_ej", "left_semi")
    run = lambda n, force=False: sync.sync_and_analyze(store, acts, asked, fetch, place, f"b{n}", chain, ("devis",), str(tmp_path / f"steps{n}"), force, delay=0.0, sleep=lambda s: None)
    out = run(1)
    assert {k: v for k, v in out.items() if k != "jobs"} == {"num_ejs": 2, "doc_ids": 4, "download_success": 3, "download_errors": 1}
    assert sorted((r.text, r.job_status) for r in out["jobs"].collect()) == [("bad text", "FAILURE"), ("same", "SUCCESS")]
    same = hashlib.sha256(b"same").hexdigest()
    assert sorted(map(tuple, store.read("engagements").collect())) == [("1", day(3)), ("2", day(1))]
    assert sorted(map(tuple, store.read("engagement_scopes").collect())) == [("A", "G", "1"), ("A", "H", "2")]
    assert {r.num_ej for r in store.read("document_engagements").where(F.col("document_id") == same).collect()} == {"1", "2"}
    assert [(r.external_id, r.error) for r in store.read("download_errors").collect()] == [("d4", "OSError: down")]
    kept = {r.hash: r for r in store.read("documents").collect()}
    assert kept[same].structured_data == '{"text":"same"}' and kept[same].file == "f/d1_n1.pdf" and len(kept) == 2
    # the second run fetches what failed and analyses what is not done
    broken.clear()
    out = run(2)
    assert (out["download_success"], out["download_errors"]) == (1, 0) and store.read("download_errors").count() == 0
    assert sorted((r.text, r.job_status) for r in out["jobs"].collect()) == [("bad text", "FAILURE"), ("late", "SUCCESS")]
    assert store.read("documents").count() == 3 and {r.batch for r in store.read("batches").collect()} == {"b1", "b2"}
    assert run(3, force=True)["jobs"].count() == 3


def test_folder(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path / "s"))
    profile = spark.createDataFrame([("f/x/1234567890_a.pdf", "1234567890_a.pdf", "h1"), ("f/1234567891_a.pdf", "1234567891_a.pdf", "h1"), ("f/none.pdf", "none.pdf", "h2"), ("f/none.pdf", "none.pdf", None)], "file string, filename string, hash string")
    for batch in ("b1", "b1", "b2"):
        sync.init_documents_in_folder(store, profile, batch)
    assert sorted((r.hash, r.file) for r in store.read("documents").collect()) == [("h1", "f/1234567891_a.pdf"), ("h2", "f/none.pdf")]
    assert sorted(map(tuple, store.read("document_engagements").collect())) == [("h1", "1234567890"), ("h1", "1234567891")]
    assert store.read("batches").count() == 4 and store.read("engagements").count() == 2
