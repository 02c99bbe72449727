"""Groups of drawings by cells against the plain order of claims."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import geometry


def plain_groups(points, threshold):
    leaders, out = [], []
    for i, x, y in sorted(points):
        at = next((n for n, (_, a, b) in enumerate(leaders) if math.sqrt((a - x) ** 2 + (b - y) ** 2) <= threshold), None)
        if at is None:
            at = len(leaders)
            leaders.append((i, x, y))
        out.append((i, leaders[at][0], at + 1))
    return sorted(out)


@pytest.mark.parametrize("spread, threshold", [(30, 10.0), (120, 10.0), (8, 3.0), (5, 10.0)])
def test_groups_of_random_points(spark, spread, threshold):
    r = random.Random(spread)
    pages = {p: [(i, r.uniform(-spread, spread), r.uniform(-spread, spread)) for i in range(80)] for p in ("a", "b")}
    pages["line"] = [(i, i * threshold * 0.6, 0.0) for i in range(12)]
    pages["back"] = [(12 - i, i * threshold, 0.0) for i in range(12)]  # exactly the threshold apart
    pages["same"] = [(i, 1.0, 1.0) for i in range(50)]
    rows = [(p, i, x, y, 1) for p, ps in pages.items() for i, x, y in ps]
    df = spark.createDataFrame([*rows, ("a", 900, None, 1.0, 1), ("a", 901, float("nan"), 1.0, 1)], "page string, i int, x double, y double, segments int").withColumn("near", F.lit("clash"))
    got = geometry.claimed(df, ["page"], "i", threshold).collect()
    for p, points in pages.items():
        assert sorted((g.i, g.leader, g.group_no) for g in got if g.page == p) == plain_groups(points, threshold)


def test_marks(spark):
    rows = [("p", 0, 0.0, 0.0, 1, 10.0, 11.0), ("p", 1, 1.0, 0.0, 1, 30.0, 1.0), ("p", 2, 100.0, 9.0, 1, 10.0, 10.0), ("p", 3, 200.0, 0.0, 5, 10.0, 13.0), ("p", 4, 300.0, 0.0, 5, 20.0, 20.0), ("q", 5, None, None, 5, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "page string, i int, x double, y double, segments int, width double, height double")
    assert sorted(map(tuple, geometry.checkboxes(df, ["page"], "i").collect())) == [("p", 0, "[X]", 0.5, -5.0), ("p", 2, "[ ]", 100.0, 4.0)]
    assert geometry.claimed(df.limit(0), ["page"], "i").count() == 0
