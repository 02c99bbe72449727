from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillframe.functions import address, compare, dates, files, ids, money, structured, text


def of(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_amounts(spark):
    given = ["1 234,56 €", "2300,5€", "1234.56", "€", None, "", "TVA 20%", "0.5", "12 000", "a 7.25 b 8"]
    want = ["1234.56", "2300.50", "1234.56", None, None, None, "20.00", "0.50", "12.00", "7.25"]
    assert of(spark, given, money.amount) == want
    assert of(spark, given, money.amount_exact) == want
    assert of(spark, ["0.125", "2.675"], money.amount_exact) == ["0.12", "2.67"]
    assert of(spark, [0.2, 0.055, None, 0.0], money.as_percentage, "double") == ["20\u00a0%", "5.5\u00a0%", None, None]


def test_identifiers(spark):
    assert of(spark, ["123 456 789 01234", "12345678901234.0", "1234567890123", "123456789012345", "", None, "123 456 78901234"], ids.siret) == ["12345678901234", "12345678901234", None, None, None, None, "12345678901234"]
    assert of(spark, [" bnpafrpp ", "BNPAFRPPXXX", "BNP", None], ids.bic) == ["BNPAFRPP", "BNPAFRPPXXX", None, None]
    good = "FR7630001007941234567890185"
    assert of(spark, [good, good[:-1] + "6", "", None, "DE89370400440532013000", "DE8937040044053201300", "GB82WEST12345698765432", "XX00123"], ids.iban_is_valid) == [True, False, True, True, True, False, True, False]
    assert of(spark, ["fr76 3000 1007 9412 3456 7890 185", "", None, "FR00"], ids.iban) == [good, None, None, None]
    assert of(spark, [good], lambda x: ids.french_iban(F.substring(x, 5, 5), F.substring(x, 10, 5), F.substring(x, 15, 11))) == [good]
    accounts = [{"banque": "B", "iban": good}, {"banque": "B", "iban": None}, {"iban": good}, {"banque": "", "iban": "bad"}, {"banque": "B", "code_banque": "30001", "code_guichet": "00794", "numero_compte": "12345678901", "cle_rib": "99"}, None]
    got = of(spark, accounts, ids.bank_account, "map<string,string>")
    assert [r and (r.banque, r.iban, r.error) for r in got] == [("B", good, None), ("B", None, None), (None, good, "banque is missing"), None, ("B", good, None), None]


def test_texts(spark):
    assert of(spark, ["Un mot, deux_mots l'été 3", "", None], text.count_words) == [6, 0, 0]
    assert of(spark, ["  a   b\n c ", None], text.squeezed) == ["a b c", ""]
    assert of(spark, ["SAINT-ETIENNE", "les sables d'olonne", "a--b  c", None], text.name_case) == ["Saint-Etienne", "Les Sables D'olonne", "A-B C", ""]
    assert of(spark, ["Élève n°1, l'été!", None], text.comparable) == ["eleve n1 lete", ""]
    assert of(spark, ["a\r\n\tb   c"], text.for_embedding) == ["a b c"]
    assert of(spark, ["short", "a readable sentence", "\x01\x02\x03\x04\x05\x06\x07\x08abc"], text.is_readable) == [False, True, False]
    rows = of(spark, ["x" * 1700, " ", None, "y" * 800], text.chunks)
    assert [[(c.start_char, c.end_char) for c in r] for r in rows] == [[(0, 1000), (800, 1700), (1600, 1700)], [], [], [(0, 800)]]
    with pytest.raises(ValueError):
        text.chunks(F.lit("a"), 100, 100)


def test_dates_and_files(spark):
    assert of(spark, ["/Date(0)/", "/Date(86400123)/", "x", None], lambda x: F.unix_millis(dates.api_timestamp(x))) == [0, 86400123, None, None]
    assert of(spark, ["24h", "7d", "5x"], dates.duration_seconds) == [86400, 604800, None]
    assert of(spark, ["EJ Création", "EJ Modification", "?"], dates.activity_kind) == ["CREATE", "UPDATE", None]
    keys = ("duree_initiale", "duree_reconduction", "nb_reconductions", "delai_tranche_optionnelle")
    got = of(spark, [dict.fromkeys(keys, "12"), dict.fromkeys(keys, "0"), {"duree_initiale": "1"}, dict.fromkeys(keys, "x")], dates.contract_duration, "map<string,string>")
    assert (got[0].duree_initiale, got[1], got[2].error, got[3].error) == (12, None, "duree_reconduction is missing", "duree_initiale is not a number")
    assert of(spark, ["1234567890_x.pdf", "12345", ""], files.order_number) == ["1234567890", None, None]
    assert of(spark, [b"%PDF-1.4", b"PK\x03\x04", b"", b"abc"], files.content_extension, "binary") == ["pdf", "zip", "unknown", "unknown"]
    assert of(spark, ["a.PDF", "noext", "x.verylongextension"], files.name_extension) == ["pdf", "", ""]
    assert of(spark, ["Été/à\\b.PDF", "x" * 300 + ".txt", None, "ñandú.TXT"], files.safe_name)[0] == "Été_à_b.pdf"
    assert [len(x) if x else x for x in of(spark, ["x" * 300 + ".txt", None], files.safe_name)] == [250, None]
    assert of(spark, ["12", "-3", "abc", None], files.api_size) == [12, -3, -1, -1]


def test_addresses(spark):
    kind = "struct<numero_voie:string,nom_voie:string,complement_adresse:string,code_postal:string,ville:string,pays:string>"
    given = [("1", " rue  X ", None, "75 001", "PARIS", None), ("", None, "", "123", "", "FR"), (None, "rue Y", None, "123", "saint-denis", "fr")]
    got = of(spark, given, address.postal_address, kind)
    assert tuple(got[0]) == ("1", "rue X", None, "75001", "Paris", "France")
    assert got[1] is None and tuple(got[2]) == (None, "rue Y", None, None, "Saint-Denis", "France")
    assert of(spark, given[:1], address.address_line, kind) == ["1 rue  X, 75 001 PARIS"]


def test_comparisons(spark):
    def pairs(rule, values, kind="string"):
        df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], f"i int, a {kind}, b {kind}")
        return [r[0] for r in df.orderBy("i").select(rule(F.col("a"), F.col("b"))).collect()]

    assert pairs(compare.exact, [("", None), ("a", "a"), ("a", None), ("a", "b")]) == [True, True, False, False]
    assert pairs(compare.normalized, [("L'Été", "lete"), (None, ""), ("a", "b")]) == [True, True, False]
    account = "struct<iban:string,banque:string>"
    assert pairs(compare.mandatee_account, [(("X", "a"), ("X", "b")), ((None, "a"), ("", "a")), (("X", "a"), (None, "a"))], account) == [True, True, False]
    assert pairs(compare.same_multiset, [(["a", "b", "a"], ["a", "a", "b"]), (["a"], ["a", "a"]), (None, [])], "array<string>") == [True, False, True]
    assert pairs(compare.contained, [(["a"], ["b", "a"]), (["c"], ["a"])], "array<string>") == [True, False]


def test_structured(spark):
    contractors = [[("A", "12345678901234"), ("", "1"), ("B", "x")], [], None]
    got = of(spark, contractors, structured.contractors, "array<struct<nom:string,siret:string>>")
    assert [[tuple(x) for x in r] if r else r for r in got] == [[("A", "12345678901234"), ("B", None)], None, None]
    assert of(spark, [{"a": "1", "b": ""}, {}], structured.extraction_ratio, "map<string,string>") == [0.5, 0.0]
    df = spark.createDataFrame([("rib", {"bic": " bnpafrpp", "x": "y"}), ("other", {"bic": "z"})], "c string, m map<string,string>")
    assert [r.m for r in structured.cleaned(df, "c", "m").collect()] == [{"bic": "BNPAFRPP", "x": "y"}, {"bic": "z"}]
