"""Push-down into the remote scan, the blob store, and numbers without one task for all."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillframe.operators import ranks, records
from quillframe.sources import blobs, remote


def ms(*x):
    return f"/Date({int((datetime(*x) - datetime(1970, 1, 1)).total_seconds() * 1000)})/"


@pytest.fixture
def scan(spark, tmp_path):
    log = str(tmp_path / "asked")
    rows = [{"alerte": "EJ Création", "num_ej": str(i), "date_reception": ms(2024, 1, 1 + i, 12), "pur_org": "A", "pur_group": "G"} for i in range(6)]

    class Recorded(remote.ActivitySource):
        """A service that keeps what it is asked for and, as it may, gives more than that."""

        @staticmethod
        def fetch(url, query):
            import urllib.parse

            with open(log, "a") as f:
                f.write(urllib.parse.parse_qs(query)["$filter"][0] + "\n")
            return rows if "pur_org eq 'A'" in query.replace("+", " ").replace("%27", "'") else []

        @classmethod
        def name(cls):
            return "recorded"

    spark.dataSource.register(Recorded)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda: spark.read.format("recorded").option("url", "http://x").option("scopes", "A/G,A/H,B/G").option("pushdown", "true").load(), lambda: open(log).read().splitlines()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_reach_the_service(spark, scan):
    load, asked = scan
    df = load().where((F.col("date_reception") >= F.lit("2024-01-02 12:00:00").cast("timestamp")) & (F.col("date_reception") < F.lit("2024-01-04 12:00:00").cast("timestamp")) & (F.col("pur_org") == "A") & F.col("pur_group").isin("G", "X"))
    assert sorted(r.num_ej for r in df.collect()) == ["1", "2"]  # Spark looks again at what comes back
    assert asked() == ["date_reception ge datetime'2024-01-02T12:00:00' and date_reception le datetime'2024-01-04T12:00:01' and pur_org eq 'A' and pur_group eq 'G'"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BatchScan")]
    assert "pur_org" not in above.split("Filter")[-1].split("\n")[0] and "date_reception" in above


def test_bounds_meet_options_and_others_stay(spark, scan):
    load, asked = scan
    assert load().where("num_ej = '3' or num_ej = '5'").count() == 2 * 2  # both groups of A answer alike
    assert sorted(asked()) == [f"pur_org eq '{o}' and pur_group eq '{g}'" for o, g in (("A", "G"), ("A", "H"), ("B", "G"))]
    assert load().where("pur_org = 'none'").count() == 0 and len(asked()) == 3
    narrowed = spark.read.format("recorded").option("url", "u").option("scopes", "A/G").option("pushdown", "true").option("start", "2024-01-03T00:00:00+02:00").option("end", "2024-01-05T00:00:00").load()
    assert narrowed.where("date_reception > timestamp '2024-01-01 00:00:00'").count() == 6
    assert asked()[-1] == "date_reception ge datetime'2024-01-02T22:00:00' and date_reception le datetime'2024-01-05T00:00:00' and pur_org eq 'A' and pur_group eq 'G'"


def test_rows_are_validated():
    good = {"alerte": "a", "num_ej": 1, "date_reception": "/Date(0)/", "pur_org": "O", "pur_group": "G"}
    assert remote.activity_row(good)[:2] == ("a", "1") and remote.activity_row(good)[5] is None and remote.activity_row(good)[2].year == 1970
    assert remote.activity_row(good | {"date_reception": "2024"})[5] == "date_reception is no date: 2024"
    assert remote.activity_row({k: v for k, v in good.items() if k != "num_ej"})[5] == "num_ej is missing"
    assert remote.activity_row("x")[5] == "no object"
    assert remote.odata_filter(None, None, "O'x", "G") == "pur_org eq 'O''x' and pur_group eq 'G'"


SCHEMA = "external_id string, parent string, folder string, filename string, original_filename string, extension string, content binary"


def blob_rows(spark, names, content=b"content of "):
    return spark.createDataFrame([(n, None, "f", n, n, "pdf", content + n.encode() if n != "none" else None) for n in names], SCHEMA)


def store(df, path):
    df.write.format("blob_store").option("path", path).mode("append").save()


def test_blobs_have_rows_only_once_written(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.dataSource.register(blobs.BlobStore)
    assert blobs.stored_files(spark, path).count() == 0
    store(blob_rows(spark, ["a", "b", "none", "é"]).repartition(3), path)
    rows = {r.filename: r for r in blobs.stored_files(spark, path).collect()}
    assert set(rows) == {"a", "b", "é"} and rows["a"].file == "f/a" and rows["a"].size == 12
    for r in rows.values():
        data = (tmp_path / "store/blobs" / r.file).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r.hash and len(data) == r.size
    store(blob_rows(spark, ["a"], b"new "), path)
    assert (tmp_path / "store/blobs/f/a").read_bytes() == b"new a" and blobs.stored_files(spark, path).count() == 4
    store(blob_rows(spark, []), path)
    assert not list((tmp_path / "store/_attempts").iterdir())


def test_a_failing_task_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.dataSource.register(blobs.BlobStore)
    store(blob_rows(spark, ["old"]), path)
    bad = blob_rows(spark, [f"n{i}" for i in range(40)]).repartition(4).withColumn("filename", F.when(F.col("filename") == "n7", F.raise_error(F.lit("lost"))).otherwise(F.col("filename")))
    with pytest.raises(Exception, match="lost"):
        store(bad, path)
    assert [r.filename for r in blobs.stored_files(spark, path).collect()] == ["old"]
    assert [p.name for p in (tmp_path / "store/blobs/f").iterdir()] == ["old"] and not list((tmp_path / "store/_attempts").iterdir())


def test_numbers_within_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", None]), r.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, i int").repartition(7)
    got = ranks.numbered(df, ["k"], ["at", "i"]).collect()
    for key in ("hot", "a", None):
        mine = sorted((x.number, x.at, x.i) for x in got if x.k == key)
        assert [(a, i) for _, a, i in mine] == sorted((a, i) for k, a, i in rows if k == key) and [n for n, _, _ in mine] == list(range(len(mine)))
    assert sorted((x.number, x.i) for x in ranks.numbered(df, [], ["i"]).collect()) == [(i, i) for i in range(900)]
    assert ranks.numbered(df.limit(0), ["k"], ["i"]).count() == 0
    assert [x.k for x in remote.listing_slice(df.select(F.format_string("%03d", "i").alias("k")), "k", 8, 100).collect()] == [f"{i:03d}" for i in range(800, 900)]


def test_names_are_unique(spark):
    names = ["a.pdf", "a.pdf", "a_2.pdf", "a.pdf", "a_1.pdf", "a_2.pdf", "b", "b", "b_1", None, None, "c.tar.gz", "c.tar.gz", "a_01.pdf"]
    got = records.unique_names(spark.createDataFrame(list(enumerate(names)), "i int, name string").withColumn("x", F.lit(1)), "name", ["i"])
    out = [r.name for r in got.orderBy("i").collect()]
    assert got.columns == ["i", "name", "x"]
    assert out == ["a.pdf", "a_3.pdf", "a_2.pdf", "a_4.pdf", "a_1.pdf", "a_2_1.pdf", "b", "b_2", "b_1", None, None, "c.tar.gz", "c.tar_1.gz", "a_01.pdf"]
    r = random.Random(2)
    many = [r.choice("ab") + r.choice(["", "_1", "_2", "_1_1", "_12"]) + r.choice([".x", ""]) for _ in range(500)]
    out = [x.name for x in records.unique_names(spark.createDataFrame(list(enumerate(many)), "i int, name string"), "name", ["i"]).collect()]
    assert len(set(out)) == 500 and set(many) <= set(out)


