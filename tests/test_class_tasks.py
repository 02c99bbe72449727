"""A join by class has tasks for its keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.compare import exact
from quillframe.operators import quality


def test_a_task_for_every_so_many_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_TASK", 50)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.range(1000).select("id", F.create_map(F.lit("a"), F.col("id").cast("string")).alias("data"))
        truth = found.withColumn("kind", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
        got = quality.compared_by_class(found, truth, "id", "kind", "data", {"x": {"a": exact}})
        assert got.rdd.getNumPartitions() == 20 and got.count() == 500 and got.where("match").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
