"""Progress of a running stream, passed to a callback."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palimpsest.functions import report as report_columns
from palimpsest.operators import report

log = logging.getLogger(__name__)
# Fixed value: seconds between two reports.
INTERVAL_SECONDS = 5


def notify(callback: Callable[[dict[str, Any]], None], status: dict[str, Any]) -> None:
    """Call back with a status; a callback that fails is logged and does no harm."""
    try:
        callback(status)
    except Exception:
        log.exception("progress callback failed")


def stream_counts(captures: DataFrame) -> DataFrame:
    """Running counts of a stream of captures."""
    return captures.agg(
        F.count("*").alias("total"), F.count_if(F.col("response").isNotNull()).alias("handled")
    )


def stream_progress(
    captures: DataFrame,
    callback: Callable[[dict[str, Any]], None],
    checkpoint: str,
    task: str = "download",
    **trigger,
):
    """Report status per micro-batch: one row reaches the driver each time."""

    def tick(batch: DataFrame, _: int) -> None:
        status = batch.select(
            F.lit(task).alias("task"),
            F.col("handled").alias("current"),
            "total",
            report_columns.progress_pct(F.col("handled"), F.col("total")).alias("progress"),
        )
        for row in status.take(1):
            notify(callback, row.asDict())

    return (
        stream_counts(captures)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{INTERVAL_SECONDS} seconds"}))
        .foreachBatch(tick)
        .start()
    )


class Liveness(StreamingQueryListener):
    """Tells a callback whether a named stream is running, idle, finished or failed.

    Each event gives ``task, state, batch, rows`` and, of a failure, ``error``. Spark calls listeners
    on a thread of its own; a callback that fails is logged and does no harm to the stream.
    """

    def __init__(self, callback: Callable[[dict[str, Any]], None], task: str) -> None:
        self.callback, self.task = callback, task
        self.batches: dict[str, int | None] = {}

    def _tell(self, query: Any, state: str, rows: int = 0, error: str | None = None) -> None:
        status = {"task": self.task, "state": state, "batch": self.batches[str(query)], "rows": rows}
        notify(self.callback, status if error is None else {**status, "error": error})

    def onQueryStarted(self, event: Any) -> None:
        if event.name == self.task:
            self.batches[str(event.id)] = None
            self._tell(event.id, "running")

    def onQueryProgress(self, event: Any) -> None:
        seen = event.progress
        if str(seen.id) in self.batches:
            if seen.numInputRows:
                self.batches[str(seen.id)] = seen.batchId
            self._tell(seen.id, "running", seen.numInputRows)

    def onQueryIdle(self, event: Any) -> None:
        if str(event.id) in self.batches:
            self._tell(event.id, "idle")

    def onQueryTerminated(self, event: Any) -> None:
        if str(event.id) in self.batches:
            self._tell(event.id, "failed" if event.exception else "finished", error=event.exception)


@contextmanager
def liveness(spark: SparkSession, callback: Callable[[dict[str, Any]], None], task: str) -> Iterator[Liveness]:
    """Report on the streams that are started under the name ``task`` while the context lasts."""
    listener = Liveness(callback, task)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def table_status(spark: SparkSession, path: str, task: str) -> DataFrame:
    return report.job_status(spark.read.parquet(path), task)
