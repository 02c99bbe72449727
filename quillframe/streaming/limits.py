"""Rate limits and merges over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import CAP


def counted_calls(calls: DataFrame, key: str, at: str, interval: float, limit: int) -> DataFrame:
    """key, at (seconds), count, limited for each call of a stream: windows that a key's first call opens, kept as state.

    Calls of a batch count in order of their time; a call at or after the window's end opens the next one.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, expiry = state.get if state.exists else (0, float("-inf"))
        times = sorted(t for pdf in batches for t in pdf["at"])
        rows = []
        for t in times:
            if count < CAP:
                count, expiry = (count + 1, expiry) if t < expiry else (1, t + interval)
            rows.append((k[0], t, count, count > limit or count >= CAP))
        state.update((count, expiry))
        yield pd.DataFrame(rows, columns=["key", "at", "count", "limited"])

    given = calls.select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("at")).where("at is not null")
    return given.groupBy("key").applyInPandasWithState(step, "key string, at double, count long, limited boolean", "count long, expiry double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Events of each key and window, closed once the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def merge_each_batch(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """A started query that gives each micro-batch to merge(batch, id), with its checkpoint in a shared folder."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
