"""Rate limits as window and fold computations over recorded calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CAP = 1_000_000


def gate_starts(calls: DataFrame, key: str, at: str, order: list[str], spacing: float) -> DataFrame:
    """calls (at: seconds) with `start` = max(at, previous start + spacing) and `delay`, in order within the key.

    Closed form: i * spacing plus the running maximum of at - i * spacing.
    """
    w = Window.partitionBy(key).orderBy(at, *order)
    i = F.row_number().over(w) - 1
    rows = calls.withColumn("__free", F.col(at) - i * F.lit(spacing)).withColumn("__i", i)
    start = F.col("__i") * F.lit(spacing) + F.max("__free").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", start).withColumn("delay", F.col("start") - F.col(at)).drop("__free", "__i")


def window_counts(calls: DataFrame, key: str, at: str, interval: float, limit: int) -> DataFrame:
    """Per key: for each call in order its count in a window that the first call opens, and whether it is over the limit.

    A call at or after the window's end opens the next one. A count that has reached the cap stays, after the end too. The calls of a
    key are streamed through one task in order of time, which holds only the count and the window's end.
    """
    given = calls.where(F.col(at).isNotNull()).select(key, F.col(at).cast("double").alias("at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of key and time; of a key only its state is held
        last, call_no, n, expiry = (), 0, 0, float("-inf")
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if last == () or not (k == last[0] or (k != k and last[0] != last[0])):
                    last, call_no, n, expiry = (k,), 0, 0, float("-inf")
                if n < CAP:
                    n, expiry = (n + 1, expiry) if t < expiry else (1, t + float(interval))
                rows.append((call_no, n, n > limit or n >= CAP))
                call_no += 1
            numbers, counts, limited = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(numbers, pa.int32()), batch.column(1), pa.array(counts, pa.int64()), pa.array(limited, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "call_no", "at", "count", "limited"])

    schema = StructType([given.schema[key], *StructType.fromDDL("call_no int, at double, count long, limited boolean")])
    return given.repartition(key).sortWithinPartitions(key, "at").mapInArrow(count, schema)
