"""Listings that arrive file by file, kept to one version per file key.

State is one row per key, however many captures it has. An older capture that comes late
never replaces a newer winner, without a watermark, because winners are compared by their
timestamps. The state grows with the number of keys; a state store on local disk, such as
the one on RocksDB, fits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.versions import top_of
from palimpsest.session import children, exists, remove
from palimpsest.sources import listing

CARRIED = ["url_origin", "url_archive", "digest", "mimetype", "statuscode", "response"]


def land_lines(spark: SparkSession, folder: str, path: str, checkpoint: str, **trigger):
    """Number the lines of listing files as they appear and store them by batch.

    A stream has no row order, so numbering happens inside a micro-batch, whose files are
    fixed; ``(batch_id, line_no)`` is then the arrival order. Spark reads large files first: of a batch with
    several files the lines are sorted by file name and position before they are numbered. A replayed
    batch replaces its own folder with the same rows.
    """
    raw = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("src_file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if len(batch.select("src_file").distinct().take(2)) > 1:
            placed = batch.withColumn("place", F.monotonically_increasing_id())
            batch = placed.repartitionByRange("src_file", "place").sortWithinPartitions("src_file", "place")
        (
            batch.withColumn("line_no", F.monotonically_increasing_id())
            .where(~listing.is_header(F.col("value")))
            .select("line_no", listing.clean_line(F.col("value")).alias("line"))
            .write.mode("overwrite")
            .parquet(f"{path}/batch_id={batch_id}")
        )

    return (
        raw.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_landed(spark: SparkSession, path: str, files_per_trigger: int = 100, timed: bool = False) -> DataFrame:
    """Stream of landed lines in the order of their landing; ``timed`` adds ``landed_at``."""
    lines = (
        spark.readStream.schema("line_no long, line string, batch_id long")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return lines.withColumn("landed_at", F.col("_metadata.file_modification_time")) if timed else lines


def drop_repeated_within(captures: DataFrame, delay: str) -> DataFrame:
    """Leave out captures that were seen already during ``delay``, such as ``1 day``; off unless called.

    The state holds what landed within the delay and no more. Time is that of landing, which needs
    ``read_landed(timed=True)``: a capture from long ago is not late, since files are read in the
    order they landed in. What lets the state shrink also lets repeats through: one that lands more than the
    delay after the first one may be passed on, so results equal those without this step only if
    duplicates are removed behind it, as ``CaptureStore`` does.
    """
    timed = captures.withWatermark("landed_at", delay)
    return timed.dropDuplicatesWithinWatermark(["timestamp", "url_origin"]).drop("landed_at")


def stream_captures(lines: DataFrame, merge_www: bool = True) -> DataFrame:
    """Captures of a stream of numbered lines."""
    return listing.to_captures(listing.parse_listing(lines), merge_www)


def _arrival(captures: DataFrame, sign: int) -> list:
    return [F.col(c) * sign for c in ("batch_id", "scid") if c in captures.columns]


def _winner(captures: DataFrame, keys: list[str], mode: str) -> DataFrame:
    if mode not in ("first", "last"):
        raise ValueError(f"a stream keeps the first or the last version of a file, not {mode!r}")
    value = F.struct("timestamp", "scid", *[c for c in CARRIED if c not in keys])
    # latest time, then first arrival; or earliest time, then first arrival
    if mode == "last":
        picked = F.max_by(value, F.struct("timestamp", *_arrival(captures, -1)))
    else:
        picked = F.min_by(value, F.struct("timestamp", *_arrival(captures, 1)))
    best = captures.groupBy(*keys).agg(picked.alias("__best"))
    return best.select(*keys, "__best.*")


def keep_versions_stream(captures: DataFrame, mode: str = "last") -> DataFrame:
    """Current winner per file key, in update or complete mode."""
    return _winner(captures, ["url_key"], mode)


def dedup_stream(captures: DataFrame) -> DataFrame:
    """First arrival per timestamp and address, in update or complete mode."""
    value = F.struct("scid", "url_key", *[c for c in CARRIED if c != "url_origin"])
    best = captures.groupBy("timestamp", "url_origin").agg(
        F.min_by(value, F.struct(*_arrival(captures, 1))).alias("__best")
    )
    return best.select("timestamp", "url_origin", "__best.*")


def append_changes(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Append changed winners per micro-batch to a parquet log.

    A batch writes into its own folder, so a batch that is replayed after a failure
    replaces what it had written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch_id=")) for n in children(spark, path) if n.startswith("batch_id="))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Last batches of the snapshots that were written to their end, in order."""
    found = [int(n.removeprefix("upto=")) for n in children(spark, f"{path}/_snapshots") if n.startswith("upto=")]
    return sorted(n for n in found if exists(spark, f"{path}/_snapshots/upto={n}/_SUCCESS"))


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot and the batches after it, each row with its batch."""
    upto = (_snapshots(spark, path) or [None])[-1]
    tail = [f"{path}/batch_id={n}" for n in _batches(spark, path) if upto is None or n > upto]
    snapshot = None if upto is None else spark.read.parquet(f"{path}/_snapshots/upto={upto}")
    if not tail and snapshot is not None:
        return snapshot
    log = spark.read.option("basePath", path).parquet(*(tail or [path]))
    log = log.withColumn("batch_id", F.col("batch_id").cast("long"))
    return log if snapshot is None else snapshot.unionByName(log)


def current(spark: SparkSession, path: str, keys: tuple[str, ...] = ("url_key",)) -> DataFrame:
    """Table of winners from a change log: the last batch per key counts."""
    return top_of(_log(spark, path), [*keys], F.desc("batch_id")).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = ("url_key",)) -> int | None:
    """Store the winners of a change log as a snapshot; the last batch in it, or None for an empty log.

    A snapshot counts from the moment that its folder is marked as whole, so a compaction that dies is
    as if it had not been. Whoever began to read the snapshot before, and the batches after it, can read
    on: these are removed by the compaction after this one. Compactions of one log follow each
    other; the stream may go on meanwhile.
    """
    batches, known = _batches(spark, path), _snapshots(spark, path)
    whole = [n for n in batches if exists(spark, f"{path}/batch_id={n}/_SUCCESS")]
    last = max([*whole, *known], default=None)
    if last is None or last in known:
        return last
    rows = _log(spark, path).where(F.col("batch_id") <= last)
    top_of(rows, [*keys], F.desc("batch_id")).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={last}")
    for n in known[:-1]:
        remove(spark, f"{path}/_snapshots/upto={n}")
    for n in batches:
        if known and n <= known[-1]:
            remove(spark, f"{path}/batch_id={n}")
    return last
