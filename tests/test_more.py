"""Database reads, keyed fetches, nested ground truth, decoding by schema, access and rows by place."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillframe.functions import structured
from quillframe.operators import access, providers, quality, records
from quillframe.sources import files


def test_database_reads(spark, tmp_path):
    """Derby is the database that comes with Spark."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i, f"n{i % 7}", None if i % 11 == 0 else float(i)) for i in range(1, 301)]
    frame = spark.createDataFrame(rows, "id int, name string, value double")
    frame.write.option("createTableColumnTypes", "name VARCHAR(20)").jdbc(url, "things", properties={"driver": driver})
    whole = files.whole_table(spark, url, "things", "id", 6, driver=driver)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(rows) and whole.rdd.getNumPartitions() == 6
    part = files.relational(spark, url, "things", "id", 1, 301, 3, driver=driver)
    assert part.count() == 300
    some = files.selected(spark, url, "things", ["id", "name"], "value > 100 and name = 'n3'", ["-id"], 2, 4, driver=driver)
    want = sorted((i for i, n, v in rows if v is not None and v > 100 and n == "n3"), reverse=True)[2:6]
    assert [r.id for r in some.collect()] == want and some.columns == ["id", "name"]
    assert files.selected(spark, url, "things", where="name = 'none'", driver=driver).count() == 0
    frame.limit(0).write.jdbc(url, "nothing", properties={"driver": driver})
    assert files.whole_table(spark, url, "nothing", "id", driver=driver).count() == 0


def test_batches_of_keys(spark):
    def fetch(keys):
        assert keys == sorted(keys) and len(keys) <= 10
        if 35 in keys:
            raise RuntimeError("no such key")
        return [{"id": k, "name": f"n{k}"} for k in keys if k % 2 == 0]

    keys = spark.createDataFrame([(i,) for i in range(60)] + [(3,), (None,)], "k long").repartition(4)
    got = records.fetched_by_keys(keys, "k", fetch, "id long, name string", 10).collect()
    assert sorted(r.id for r in got if r.error is None) == [i for i in range(60) if i % 2 == 0 and not 30 <= i < 40]
    assert [r.error for r in got if r.error] == ["RuntimeError: no such key"]
    assert records.fetched_by_keys(keys.limit(0), "k", fetch, "id long, name string").count() == 0
    assert [r.k for r in records.id_list(keys.where("k is not null").distinct(), "k", 3).collect()] == [0, 1, 2]


def test_ground_truth_and_cache(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,rib,n\na,"{""iban"": ""X"", ""l"": [1]}",1\nb,,2\nc,no json,\n"d\ne",null,4\n')
    rows = files.ground_truth(spark, str(tmp_path / "t.csv"), "name string, rib string, n int", {"rib": "iban string, l array<int>"}).collect()
    assert [(r.name, r.rib and r.rib.iban, r.n) for r in rows] == [("a", "X", 1), ("b", None, 2), ("c", None, None), ("d\ne", None, 4)]
    (tmp_path / "c.json").write_text(json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2}]))
    assert [(r.a, r.b and r.b.c) for r in files.json_cache(spark, str(tmp_path / "c.json"), "a int, b struct<c:string>").collect()] == [(1, "x"), (2, None)]
    assert set(files.json_cache(spark, str(tmp_path / "c.json")).columns) == {"a", "b"}


def test_answers_by_schema(spark):
    schema = providers.response_schema([{"output_field": "name"}, {"output_field": "n", "schema": {"type": "integer"}}, {"output_field": "l", "schema": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}}}}}])
    answers = ['{"name": "a", "n": 3, "l": [{"x": 1.5}]}', 'Here it is:\n```json\n{"name": null, "n": 1, "l": []}\n```', '{"name": "a"}', "no", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    got = [(r.data, r.error) for r in providers.decoded(df, schema).orderBy("i").collect()]
    assert got[0][0].l[0].x == 1.5 and got[0][1] is None and (got[1][0].name, got[1][0].n, got[1][1]) == (None, 1, None)
    assert got[2][1] == "missing: n, l" and got[3] == (None, "the answer is no JSON object") and got[4] == (None, None) and got[5][1] == "the answer is no JSON object"
    told = providers.decoded(df.withColumn("error", F.lit("before")), schema).where("error != 'before'")
    assert told.count() == 0


def test_access(spark):
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    users = table([(1, True, None), (2, False, [access.VIEW]), (3, False, None), (4, False, None), (5, None, ["other"])], "user_id int, is_superuser boolean, permissions array<string>")
    groups = table([(2, 10), (3, 10), (3, 11), (4, 12), (5, 10), (None, 10)], "user_id int, group_id int")
    permissions = table([(11, access.VIEW), (12, access.VIEW), (10, "docia.other")], "group_id int, permission string")
    scopes = table([(10, "A", "G"), (12, "B", "G"), (10, "A", "G"), (10, None, "G")], "group_id int, pur_org string, pur_group string")
    engagements = table([("A", "G", "e1"), ("B", "G", "e2"), (None, "G", "e3"), ("A", "G", None), ("A", "G", "e1")], "pur_org string, pur_group string, num_ej string")
    assert sorted(map(tuple, access.allowed(users, groups, scopes, engagements, permissions).collect())) == [(2, "e1"), (3, "e1"), (4, "e2")]
    pairs = table([(u, e) for u in (1, 2, 3, 4, 5, 6) for e in ("e1", "e2", "e3")] + [(2, "e1"), (None, "e1")], "user_id int, num_ej string")
    got = access.may_see(pairs, users, groups, scopes, engagements, permissions).collect()
    assert len(got) == 20 and {(r.user_id, r.num_ej) for r in got if r.visible} == {(1, "e1"), (1, "e2"), (1, "e3"), (2, "e1"), (3, "e1"), (4, "e2")}


def test_rows_by_place(spark):
    found, truth = spark.createDataFrame([(0, "a"), (1, "b"), (3, None)], "row_id int, v string"), spark.createDataFrame([(1, "B"), (0, "A"), (2, "C")], "row_id int, v string")
    assert sorted((r.row_id, r.found.v, r.truth.v) for r in quality.by_row(found, truth).collect()) == [(0, "a", "A"), (1, "b", "B")]
    with pytest.raises(Exception, match="truth repeats row 1"):
        quality.by_row(found, truth.union(truth.limit(1))).collect()


def test_small_rules(spark):
    docs = [("1", "é.pdf", "12"), ("2", None, "x")]
    df = spark.createDataFrame(docs, "id string, name string, size string").select(structured.raw_document(F.col("id"), F.col("name"), F.col("size")).alias("d"))
    assert [tuple(r.d) for r in df.collect()] == [("1", "é.pdf", 12), ("2", None, -1)]
    lists = [('[{"numero_lot": null}]', True), ("[]", False), (None, False), ('["x"]', False), ("no", False), ('{"numero_lot": 1}', False)]
    assert [r.b for r in spark.createDataFrame(lists, "v string, want boolean").select(structured.is_by_lot(F.col("v")).alias("b")).collect()] == [w for _, w in lists]
    rows = spark.createDataFrame([("k1",), ("k2",), ("#",)], "key string")
    contracts = spark.createDataFrame([("k1", "k1"), ("k1", "k2"), ("k3", "k2"), ("k3", "#"), ("k3", None)], "own string, other string")
    assert [r.key for r in records.under_other_key(rows, contracts, "key", "own", "other").collect()] == ["k2"]
