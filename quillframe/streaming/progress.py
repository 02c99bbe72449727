"""Steps as micro-batches, with counts by status that can be read while they run."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.steps import NativeStep, Step, progress, run_step
from ..operators.workflow import OPEN


class Progress(StreamingQueryListener):
    """Counts of jobs by status over all micro-batches so far; ended once the query has stopped or `expected` jobs have a terminal status."""

    def __init__(self, name: str = "progress", expected: int | None = None):
        self.name, self.expected = name, expected
        self.counts: dict[str, int] = {}
        self.history: list[dict[str, int]] = []
        self.error: str | None = None
        self._seen: set[tuple[str, int]] = set()
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        batch = (str(event.progress.id), event.progress.batchId)
        if row is None or batch in self._seen:  # a batch that ran again counts once
            return
        self._seen.add(batch)
        for k, n in row.asDict().items():
            self.counts[k] = self.counts.get(k, 0) + n
        self.history.append(dict(self.counts))
        done = self.counts["total"] - sum(self.counts[s] for s in OPEN)
        if self.expected is not None and done >= self.expected:
            self._ended.set()

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
        self._ended.set()

    def wait(self, timeout: float | None = None) -> bool:
        """Whether all has ended, after `timeout` seconds at most."""
        return self._ended.wait(timeout)

    def __str__(self) -> str:
        total = self.counts.get("total", 0)
        done = total - sum(self.counts.get(s, 0) for s in OPEN)
        return f"{done} / {total if self.expected is None else self.expected}, skipped {self.counts.get('SKIPPED', 0)}, errors {self.counts.get('FAILURE', 0)}"


def run_stream(jobs: DataFrame, steps: Sequence[Step | NativeStep], path: str, checkpoint: str, name: str = "progress", **trigger) -> StreamingQuery:
    """Starts all steps on a stream of jobs and appends them, as they end, to the table at path; a Progress of this name sees each micro-batch.

    The file sink's log and the checkpoint make a batch that runs again after a loss count once. trigger: as writeStream.trigger takes it.
    """
    for step in steps:
        jobs = run_step(jobs, step)
    return progress(jobs, name)[0].writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start(path)
