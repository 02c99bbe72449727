"""Corrections of account numbers against all substitutions, and how many of them are looked at."""

from pyspark.sql import functions as F

from quillframe.functions import ids


def test_corrections_are_those_of_all_substitutions(spark):
    whole = spark.range(4).select(ids.french_iban(F.lit("30001"), F.lpad((F.col("id") * 37).cast("string"), 5, "0"), F.concat(F.lpad((F.col("id") * 790007).cast("string"), 9, "0"), F.lit("B3"))).alias("x"))
    good = [r.x for r in whole.collect()]
    rows = [None, "", "é" * 27, *good, *[x[:i] + c + x[i + 1 :] for x in good for i, c in ((0, "G"), (1, "7"), (3, "é"), (10, "Z"), (17, "0"), (23, "9"), (26, "-"))]]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", ids.iban_corrected(F.col("x")).alias("fixed")).collect()
    tries = [(x, x[:i] + c + x[i + 1 :]) for x in rows if x and len(x) == 27 for i in range(27) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if i < 2 else "0123456789")]
    valid = spark.createDataFrame(tries, "x string, y string").where("x != y").where(ids.iban_is_valid(F.col("y"))).distinct().collect()
    want = {x: [r.y for r in valid if r.x == x] for x in rows}
    assert {r.x: r.fixed for r in got} == {x: ys[0] if len(ys) == 1 else None for x, ys in want.items()}
    assert any(r.fixed for r in got)


def test_a_place_has_one_try(spark):
    plan = spark.range(1).select(ids.iban_corrected(F.lit("FR").substr(1, 2)))._jdf.queryExecution().analyzed().toString()
    assert "flatten(" not in plan  # no list of a try for each character of each place
