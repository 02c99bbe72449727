"""An event sink that holds every micro-batch once, whatever is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def enriched(events: DataFrame, agent: str | None = None, referer: str | None = None, user: str | None = None) -> DataFrame:
    """events with user_agent, referer and user from the columns named; null where none is."""
    of = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    return events.withColumns({"user_agent": of(agent), "referer": of(referer), "user": of(user)})


def append_batch(path: str, query: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch takes: writes a batch to its own place, named by query and batch id, so that a replay replaces it by itself.

    A batch's rows become visible by its _SUCCESS mark alone, which comes last; an attempt that died leaves none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/query={query}/batch={batch_id}")

    return write


def appended(events: DataFrame, path: str, query: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts to append a stream of events to the sink at path."""
    return events.writeStream.foreachBatch(append_batch(path, query)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def sink_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events of the sink with their query and batch; places of batches that were not written whole are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/query=*/batch=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    places = [f.getPath().getParent().toString() for f in found or []]
    whole = f"{schema}, query string, batch long"
    if not places:
        return spark.createDataFrame([], whole)
    return spark.read.option("basePath", path).schema(whole).parquet(*places)
