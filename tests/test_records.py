"""Record operators, extraction and downloads on small inputs."""

from __future__ import annotations

import json
import urllib.error

from pyspark.sql import functions as F

from quillframe.functions import ids, structured, text
from quillframe.operators import extraction, merge, providers, records
from quillframe.sources import remote


def test_metadata_and_downloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "filename": "x.pdf", "size": 5}, {"filename": "none"}, {"id": "2", "size": 10**9}]))
    spark.dataSource.register(remote.MetadataSource)
    docs = spark.read.format("document_metadata").option("keys", "a,b").option("folder", str(tmp_path)).load()
    assert sorted((r.num_ej, r.id, r.size) for r in docs.collect()) == [("a", "1", 5), ("a", "2", 10**9)]

    def fetch(key):
        if key == "2":
            raise urllib.error.URLError("down")
        return b"bytes"

    got = {r.id: (r.content and bytes(r.content), r.error) for r in remote.downloaded(docs, fetch, sleep=lambda s: None).collect()}
    assert got == {"1": (b"bytes", None), "2": (None, "URLError: <urlopen error down>")}
    names = spark.createDataFrame([(c,) for c in "dbace"], "name string")
    assert [r.name for r in remote.listing_slice(names, "name", 1, 2).collect()] == ["c", "d"]


def test_analysis_cleans_answers(spark):
    docs = spark.createDataFrame([(1, "rib", "some text"), (2, "rib", " "), (3, "other", "text"), (4, "rib", None)], "id int, classification string, text string")
    attributes = spark.createDataFrame([("rib", 1, "bic", "Le BIC.")], "classification string, position int, attribute string, instruction string")
    got = {r.id: (r.error, r.structured_data) for r in extraction.analyzed(docs, attributes, lambda prompts: ['{"bic": " bnpa frpp"}' if "Le BIC." in p else "" for p in prompts]).collect()}
    assert got == {1: (None, {"bic": "BNPAFRPP"}), 2: ("the text is empty", None), 3: (None, None), 4: ("the text is empty", None)}


def test_nested_fields_and_lots(spark):
    data = {"siret_mandataire": "123 456 789 01234", "cotraitants": '[{"nom": "A", "siret": "x"}, {"nom": "", "siret": ""}]', "duree": '{"duree_initiale": "12", "duree_reconduction": null, "nb_reconductions": null, "delai_tranche_optionnelle": null}'}
    lots = {"lots": '[{"numero_lot": 2, "titre_lot": "B"}]', "duree_lots": '[{"numero_lot": 1, "duree_lot": "12 mois"}]', "other": "kept"}
    df = spark.createDataFrame([("acte_engagement", data), ("ccap", lots), ("ccap", {}), ("ccap", None)], "c string, m map<string,string>")
    a, b, empty, none = (r.m for r in structured.cleaned(df, "c", "m").collect())
    assert a["siret_mandataire"] == "12345678901234" and json.loads(a["cotraitants"]) == [{"nom": "A"}] and json.loads(a["duree"])["duree_initiale"] == 12
    merged = json.loads(b["lots"])
    assert [(x["numero_lot"], x["titre"], x["duree_lot"]) for x in merged] == [(1, None, "12 mois"), (2, "B", None)] and merged[0]["forme"] == dict.fromkeys(("structure", "tranches", "forme_prix", "attributaires"))
    assert b["other"] == "kept" and empty == {} and none is None


def test_white_space(spark):
    rows = spark.createDataFrame([(" BNPA FRPP\n", "\n\t\u00a0 x \r\n"), ("BNPAFRPP\t123", "\n\n\n")], "bic string, t string")
    assert [(r.b, r.s, r.n) for r in rows.select(ids.bic(F.col("bic")).alias("b"), text.stripped(F.col("t")).alias("s"), F.size(text.chunks(F.col("t"))).alias("n")).collect()] == [("BNPAFRPP", "x", 1), ("BNPAFRPP123", "", 0)]


def test_updates_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (1, "y"), (3, "n")], "k int, v string")
    assert sorted(merge.update_by_key(old, new, "k", ["v"]).collect()) == [(1, "y"), (2, "b")]
    assert sorted(merge.upsert(old, new, "k", ["v"]).collect()) == [(1, "y"), (2, "b"), (3, "n")]


def test_dumps(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    records.csv_dump(df, str(tmp_path / "c"))
    records.json_dump(df, str(tmp_path / "j"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "c")).first().b == "[1,2]"
    assert spark.read.json(str(tmp_path / "j")).first().b == [1, 2]
    assert records.loaded(df.union(df)).collect() == [(1, "[1,2]")]


def test_json_leaves_of_odd_texts(spark):
    rows = spark.createDataFrame([('{"a": {"b": [1, {"c": null}]}, "d": {}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in rows.select(structured.json_leaves("j")).collect()] == [{"a.b.0": "1", "a.b.1.c": "null", "d": "{}"}, None, None]


def test_embedding_errors_are_told(spark):
    def broken(texts):
        raise RuntimeError("down")

    row = providers.embedded(spark.createDataFrame([("x",)], "t string"), "t", broken, 4).first()
    assert row.embedding == [0.0] * 4 and row.embedding_error == "RuntimeError: down"
