"""Matching one to one, the registries of all classes and the judge."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillframe.functions import compare
from quillframe.operators import quality


def outcomes(spark, rule, pairs, kind="string"):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    return [r.m for r in df.select("i", rule(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()]


def test_matching_takes_items_in_order(spark):
    near = compare.matched(lambda x, y: F.abs(x - y) <= 5)
    pairs = [([1, 6], [4, 10]), ([6, 1], [4, 10]), ([1], [1, 1]), ([], None), (None, [1]), ([1, 1], [1, 1]), ([None, 1], [1, None])]
    # 4 takes the first that is near: 1 leaves 6 for 10, 6 leaves 1, which is too far
    assert outcomes(spark, near, pairs, "array<int>") == [True, False, False, True, False, True, False]
    inside = compare.each_in(lambda x, y: x == y)
    assert outcomes(spark, inside, [([1, 1], [1, 2]), ([3], [1]), ([], []), ([], [1])], "array<int>") == [True, False, True, False]


def test_contractors_and_accounts(spark):
    j = lambda *x: json.dumps([{"nom": n, "siret": s} for n, s in x], ensure_ascii=False)
    pairs = [
        (j(("Été SA", "1"), ("b", None)), j(("B", ""), ("ETE-SA", "1"))),  # alike, not equal
        (j(("b", "1"), ("b", "1")), j(("b", "1"), ("c", "1"))),
        (j(("b", "1")), j(("b", "1"), ("b", "1"))),
        ("[]", None), ("null", ""), (None, j(("b", "1"))), ("no json", j(("b", "1"))),
    ]
    assert outcomes(spark, compare.co_contractors, pairs) == [True, False, False, True, True, False, False]
    assert outcomes(spark, compare.sub_contractors, pairs[:3]) == [True, True, True]
    acc = lambda *x: json.dumps([{"societe": "s", "rib": {"iban": i, "banque": b}} for i, b in x])
    pairs = [(acc(("FR 1", "a"), (None, "b")), acc(("", "B"), ("fr1", "x"))), (acc(("1", "a")), acc((None, "a"))), (acc(("1", "a")), acc(("2", "a"))), (acc(("1", "a")), acc(("1", "a"), ("1", "a")))]
    assert outcomes(spark, compare.other_accounts, pairs) == [True, False, False, False]
    assert outcomes(spark, compare.registry(as_harness=True)["acte_engagement"]["rib_autres"], pairs) == [True, True, True, False]


def test_rules_of_nested_fields(spark):
    a = '{"annexe_financière": null, "classification": ["x", "y"]}'
    assert outcomes(spark, compare.amounts_in_annex, [(a, '{"classification": ["y", "x"]}'), (a, '{"classification": null}'), (a, a.replace("null", "true")), ("{}", None)]) == [True, False, False, True]
    assert outcomes(spark, compare.lot_durations, [('["1", {"duree_initiale": 1}]', '["1", {"duree_initiale": 1, "x": 2}]'), ('["1"]', '[{"duree_initiale": 1}]'), ("[null]", "[null]"), ('["1"]', '["1", "2"]')]) == [True, False, False, False]
    assert outcomes(spark, compare.lot_titles, [('["Lot n°1 :  Été", null]', '["lot N1 ete", ""]'), ('["a b"]', '["ab"]')]) == [True, False]
    assert outcomes(spark, compare.lot_amounts, [('[{"numero_lot": 1}, {"numero_lot": 2}]', '[{"numero_lot": 2}, {"numero_lot": 1}]'), ('[{"numero_lot": 1}]', '[{"numero_lot": "3"}]')]) == [True, False]
    assert outcomes(spark, compare.lot_forms, [('[{"structure": "s"}, null]', '[{"structure": "s"}, null]'), ("[null]", '[{"structure": "s"}]')]) == [True, False]
    assert outcomes(spark, compare.postal, [('{"nom_voie": "Rue-de l\'Été", "ville": "X"}', '{"nom_voie": " rue de  l ete", "ville": "x", "pays": null}'), ('{"pays": "F"}', "{}")]) == [True, False]
    assert outcomes(spark, compare.normal, [("", None), ("", "!"), ("É a", "ea")]) == [True, False, True]


def test_registry_by_class(spark):
    assert {k: len(v) for k, v in compare.REGISTRY.items()} == {"acte_engagement": 23, "ccap": 23, "sous_traitance": 17, "devis": 9, "fiche_navette": 14, "rib": 6}
    lots = lambda *t: json.dumps([{"titre": x, "duree_lot": "1"} for x in t])
    found = [(1, {"iban": "fr 1", "bic": "X"}), (2, {"lots": lots("A", "b")}), (3, {}), (4, None), (5, {"a": "b"})]
    truth = [(1, "rib", {"iban": "FR1", "bic": "Y"}), (2, "ccap", {"lots": lots("a", "B")}), (3, "devis", {"objet": "o"}), (4, "rib", {}), (6, "rib", {}), (5, None, {})]
    rows = quality.compared_by_class(spark.createDataFrame(found, "id int, data map<string,string>"), spark.createDataFrame(truth, "id int, kind string, data map<string,string>"), "id", "kind", "data", compare.REGISTRY).collect()
    wrong = sorted((r.id, r.field) for r in rows if not r.match)
    assert wrong == [(1, "bic"), (3, "objet")] and {r.id for r in rows} == {1, 2, 3, 4}
    assert quality.compared_by_class(spark.createDataFrame([], "id int, data map<string,string>"), spark.createDataFrame(truth, "id int, kind string, data map<string,string>"), "id", "kind", "data", compare.REGISTRY).count() == 0


def test_judge_is_asked_only_for_two_texts(spark):
    def model(prompts):
        assert len(prompts) <= 2 and all("deux objets" in p for p in prompts)
        return ["no json" if "broken" in p else json.dumps({"sont_equivalentes": "travaux" in p}) for p in prompts]

    rules = compare.registry(lambda subject: quality.judge(model, subject, batch=2))
    pairs = [("travaux", "chantier"), ("a", "b"), ("", None), ("a", None), ("broken travaux", "x"), ("les travaux", "y")]
    assert outcomes(spark, rules["devis"]["objet"], pairs) == [True, False, True, False, False, True]


    assert outcomes(spark, quality.judge(lambda prompts: None, "object"), pairs[:2]) == [False, False]
