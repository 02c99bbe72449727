"""Rules whose items have keys: the same outcome as by comparing all of them, in the time of sorting."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quillframe.functions import compare
from quillframe.operators import quality


def test_keys_say_what_rules_say(spark):
    r = random.Random(4)
    party = lambda: (r.choice([None, "", "b", "B-", "c d", "cd"]), r.choice([None, "", "1", "2"]))
    rows = [(i, [party() for _ in range(r.randrange(4))], [party() for _ in range(r.randrange(4))]) for i in range(400)]
    rows += [(400 + i, a, r.sample(a, len(a))) for i, (_, a, _) in enumerate(rows[:200])]
    for names, rule, key in ((("nom", "siret"), compare.contractor, compare.contractor_key), (("banque", "iban"), compare.mandatee_account, compare.account_key)):
        of = f"array<struct<{names[0]}:string,{names[1]}:string>>"
        df = spark.createDataFrame(rows, f"i int, a {of}, b {of}")
        a, b = F.col("a"), F.col("b")
        got = df.select(compare.matched(rule)(a, b).alias("m"), compare.matched_by(key)(a, b).alias("mk"), compare.each_in(rule)(a, b).alias("e"), compare.each_in_by(key)(a, b).alias("ek")).collect()
        assert all(x.m == x.mk and x.e == x.ek for x in got) and {x.m for x in got} == {x.e for x in got} == {True, False}


def test_long_lists_of_contractors(spark):
    names = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.struct(i.cast("string").alias("nom"), i.cast("string").alias("siret"))))
    back = F.to_json(F.transform(F.sequence(F.lit(4000), F.lit(1)), lambda i: F.struct(i.cast("string").alias("nom"), i.cast("string").alias("siret"))))
    at = time.time()
    rows = spark.range(2).select(compare.co_contractors(names, back).alias("m"), compare.sub_contractors(names, back).alias("e")).collect()
    assert all(x.m and x.e for x in rows) and time.time() - at < 30


def test_lots_are_parsed_once_a_side(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["lots_compare"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2

    data = spark.createDataFrame([({"l": '[{"t": 1}, {"t": null}, {}, 3, {"t": {"x": "y"}}]'},), ({"l": "no"},), ({},)], "d map<string,string>")
    assert [x.v for x in data.select(quality.field_value(F.col("d"), "l.*.t").alias("v")).collect()] == ['[1,null,null,null,{"x":"y"}]', None, None]
