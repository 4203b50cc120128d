"""A stored table of captures that a stream is merged into, batch by batch.

The table holds what a job over all lines so far would hold: the winner of each file key, or every
distinct capture in the mode ``all``. A batch is reduced to its own winners, loses what is stored
already, takes up the results of earlier runs and competes with the stored rows of the buckets it
falls into; buckets in which nothing won are not written. A batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import overlay, report, versions
from palimpsest.session import children, cut_lineage, exists, remove, scratch_path
from palimpsest.sources import results as result_source
from palimpsest.sources.buckets import BUCKETS, BucketTable
from palimpsest.streaming.progress import notify

STORED = (
    "update long, batch_id long, scid long, timestamp string, url_origin string, url_archive string, domain string, "
    "url_key string, digest string, mimetype string, statuscode string, response string, redirect_url string, "
    "redirect_timestamp string, file string"
)
_STATE = "number long, source string, batch long, results_run long, total long, handled long"
_SAME = ["timestamp", "url_origin"]


class State(NamedTuple):
    """What the last update left: where it came from, which results it had seen, and the counts."""

    number: int = 0
    source: str = ""
    batch: int = -1
    results_run: int = 0
    total: int = 0
    handled: int = 0


class EarlierResults:
    """Result files of runs, ``root/run=<n>``; the latest whole one counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def latest(self) -> int:
        """Number of the last run that was written to its end; 0 if there is none."""
        runs = [int(n.removeprefix("run=")) for n in children(self.spark, self.root) if n.startswith("run=")]
        return max((n for n in runs if exists(self.spark, f"{self.root}/run={n}/_SUCCESS")), default=0)

    def read(self, run: int) -> DataFrame | None:
        return result_source.scan_results(self.spark, f"{self.root}/run={run}") if run else None


class CaptureStore:
    """Captures by file key, or all distinct ones, below ``path``.

    ``results_root`` names the results of earlier runs. They are looked up anew with each update, and one
    update uses one run's results throughout; a run that came since the last update is also laid over
    the rows stored before.
    """

    def __init__(
        self, spark: SparkSession, path: str, mode: str = "last", results_root: str | None = None, buckets: int = BUCKETS
    ) -> None:
        if mode not in versions.MODES:
            raise ValueError(f"mode must be one of {versions.MODES}, not {mode!r}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self.results = EarlierResults(spark, results_root) if results_root else None
        # captures of one file may be a large part of all; as winners they are one row
        key = _SAME if mode == "all" else ["url_key"]
        schema = spark.createDataFrame([], STORED).schema
        self.table = BucketTable(spark, f"{self.path}/captures", schema, key, buckets)

    # ------------------------------------------------------------ state

    def _state_path(self, number: int) -> str:
        return f"{self.path}/state/update={number}"

    def state(self, before: int | None = None) -> State:
        """The state after the last update, or after the last one before a number."""
        found = [int(n.removeprefix("update=")) for n in children(self.spark, f"{self.path}/state")]
        found = [n for n in found if before is None or n < before]
        for number in sorted(found, reverse=True):
            if exists(self.spark, f"{self._state_path(number)}/_SUCCESS"):
                row = self.spark.read.schema(_STATE).parquet(self._state_path(number)).first()
                return State(**row.asDict())
        return State()

    def _enter(self, state: State) -> None:
        row = self.spark.createDataFrame([tuple(state)], _STATE)
        row.coalesce(1).write.mode("overwrite").parquet(self._state_path(state.number))
        for name in children(self.spark, f"{self.path}/state"):
            # the state before is needed should this update have to be made again
            if int(name.removeprefix("update=")) < state.number - 1:
                remove(self.spark, f"{self.path}/state/{name}")

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        return self.table.read().drop("bucket", "update")

    def status(self, task: str) -> dict[str, Any]:
        """Counts as the last update left them; the table is not read for it."""
        last = self.state()
        row = report.status_row(self.spark, task, last.handled, last.total)
        return row.first().asDict()

    # ------------------------------------------------------------ updates

    def _winners(self, rows: DataFrame) -> DataFrame:
        order = [F.col("batch_id"), F.col("scid")]
        if self.mode == "all":
            return versions.top_of(rows, _SAME, *order)
        by_time = F.desc("timestamp") if self.mode == "last" else F.asc("timestamp")
        return versions.top_of(rows, ["url_key"], by_time, *order)

    def _arrived(self, captures: DataFrame, number: int, batch: int) -> DataFrame:
        """A batch with the columns of the table; lines without landing batch came with this one."""
        given = captures if "batch_id" in captures.columns else captures.withColumn("batch_id", F.lit(batch))
        given = given.withColumn("update", F.lit(number))
        columns = {f.name: f.dataType for f in self.table.schema.fields if f.name != "bucket"}
        return given.select(
            *[(F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        )

    def merge(self, captures: DataFrame, source: str, batch: int) -> State:
        """Take in a batch of captures; ``source`` and ``batch`` say which, so that it is known when it comes again."""
        last = self.state()
        again = (last.source, last.batch) == (source, batch)
        number = last.number if again else last.number + 1
        if again and self.table.is_prepared(number):
            self.table.replay(number)
            return last
        before = self.state(number)
        scratch = scratch_path(self.spark, "stream-batch")
        # the batch belongs to the stream's own session and would be read once per step
        self._winners(self._arrived(captures, number, batch)).write.parquet(scratch)
        rows = self.spark.read.schema(STORED).parquet(scratch)
        run = self.results.latest() if self.results else 0
        found = self.results.read(run) if self.results else None
        state = self._update(number, before, rows, found, run)._replace(source=source, batch=batch)
        self._enter(state)
        if self.table.is_prepared(number):
            self.table.replay(number)
        remove(self.spark, scratch)
        return state

    def _update(self, number: int, before: State, rows: DataFrame, results: DataFrame | None, run: int) -> State:
        """Store the new content of the buckets that change, and count what that does."""
        touched = self.table.touched(rows)
        stored = self.table.read(touched).drop("bucket")
        if self.mode == "all":
            return self._added(number, before, rows, set(touched), results, run)
        new = overlay.anti_existing(rows, stored, _SAME)
        if results is not None:
            new = overlay.overlay_results(new, results)
        merged = self.table.with_bucket(self._winners(stored.unionByName(new)))
        merged = cut_lineage(merged, "stream-merged")
        changed = {r.bucket for r in merged.where(F.col("update") == number).select("bucket").distinct().collect()}
        content = merged.where(F.col("bucket").isin(list(changed)))
        if results is not None and run != before.results_run:
            content, changed = self._refreshed(merged, set(touched), content, changed, results)
        total = handled = 0
        if changed:
            now = report.counts(content).first()
            old = report.counts(self.table.read(sorted(changed))).first()
            total, handled = now.total - old.total, now.handled - old.handled
            self.table.prepare(number, content)
        return State(number, "", -1, run, before.total + total, before.handled + handled)

    def _added(
        self, number: int, before: State, rows: DataFrame, touched: set[int], results: DataFrame | None, run: int
    ) -> State:
        """``_update`` where every distinct capture stays: new ones join those stored, which only move with their buckets."""
        stored = self.table.read(sorted(touched))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _SAME])
        known = stored.select(*[F.col(c).alias(f"__{c}") for c in _SAME])
        new = rows.join(known, same, "left_anti")
        if results is not None:
            new = overlay.overlay_results(new, results)
        new = cut_lineage(self.table.with_bucket(new), "stream-new")
        changed = {r.bucket for r in new.select("bucket").distinct().collect()}
        merged = stored.unionByName(new)
        content = merged.where(F.col("bucket").isin(list(changed)))
        if results is not None and run != before.results_run:
            content, changed = self._refreshed(merged, touched, content, changed, results)
            now, old = report.counts(content).first(), report.counts(self.table.read(sorted(changed))).first()
            total, handled = now.total - old.total, now.handled - old.handled
        else:
            now = report.counts(new).first()
            total, handled = now.total, now.handled
        if changed:
            self.table.prepare(number, content)
        return State(number, "", -1, run, before.total + total, before.handled + handled)

    def _refreshed(
        self, merged: DataFrame, touched: set[int], content: DataFrame, changed: set[int], results: DataFrame
    ) -> tuple[DataFrame, set[int]]:
        """Lay a run's new results over rows stored before; buckets that they name are written too."""
        latest = cut_lineage(overlay.last_results(results), "stream-results")
        held = self.table.read().select(*_SAME, "bucket").join(latest.select(*_SAME), _SAME, "left_semi")
        hit = {r.bucket for r in held.select("bucket").distinct().collect()}
        rest = self.table.read(sorted(hit - touched))
        also = merged.where(F.col("bucket").isin(sorted(hit & touched - changed))).unionByName(rest)
        whole = overlay.overlay_results(content.unionByName(also), latest)
        return cut_lineage(whole, "stream-refreshed"), changed | hit


def merge_captures(
    captures: DataFrame,
    store: CaptureStore,
    checkpoint: str,
    callback: Callable[[dict[str, Any]], None] | None = None,
    task: str = "stream",
    **trigger,
):
    """Merge a stream of captures into a store; ``callback`` is given the counts after each batch.

    The stream is named ``task``, so that ``progress.liveness`` can report on it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, checkpoint, batch_id)
        if callback is not None:
            notify(callback, store.status(task))

    return (
        captures.writeStream.queryName(task)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )
