"""Queries over streams; their results have to equal those of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.checks import derived as d
from palimpsest.checks import oracle as o
from palimpsest.checks.of_tables import CAPTURE_COLUMNS, CAPTURE_SQL, LINES_PER_FILE, RESUMED, listing_files
from palimpsest.checks.of_tables import FILES as LANDINGS
from palimpsest.checks.registry import query
from palimpsest.operators import versions
from palimpsest.plans.job import CaptureJob
from palimpsest.session import cut_lineage, move, scratch_path
from palimpsest.sources import results
from palimpsest.streaming import captures as stream
from palimpsest.streaming import progress
from palimpsest.streaming.store import CaptureStore, merge_captures

FILES = 5
_STATUS = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("current", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("progress", T.StringType()),
    ]
)


def _landed(spark, sf) -> tuple[str, int]:
    """The derived lines as landed files, split by arrival, and how many of them make a micro-batch.

    Files grow in number with the lines, micro-batches in size: each reads its files in parallel.
    """
    path = scratch_path(spark, "landed")
    lines = cut_lineage(d.lines(spark, sf), "lines")
    files = max(FILES, -(-lines.count() // LINES_PER_FILE))
    rows = lines.withColumn("part", F.col("line_no") % files)
    rows.repartition(files, "part").select("line_no", "line").write.parquet(f"{path}/batch_id=0")
    return path, -(-files // FILES)


def _captures(spark, sf):
    path, together = _landed(spark, sf)
    lines = stream.read_landed(spark, path, files_per_trigger=together)
    return stream.stream_captures(lines)


def _current(spark, sf, mode):
    winners = stream.keep_versions_stream(_captures(spark, sf), mode)
    log = scratch_path(spark, "changes")
    stream.append_changes(winners, log, scratch_path(spark, "stream")).awaitTermination()
    return stream.current(spark, log).select(*CAPTURE_COLUMNS)


@query("stream_captures", o.stmt(o.KEPT, f"SELECT {CAPTURE_SQL} FROM kept"))
def stream_captures(spark, sf):
    return _current(spark, sf, "last")


@query("stream_captures_first", o.stmt([*o.DISTINCTS, o.kept_cte("first")], f"SELECT {CAPTURE_SQL} FROM kept"))
def stream_captures_first(spark, sf):
    return _current(spark, sf, "first")


@query(
    "stream_progress",
    o.stmt(
        o.CAPTURED,
        """SELECT 'download' AS task, count(response) AS current, count(*) AS total,
        CAST(CAST(round_even(100.0 * count(response) / count(*), 0) AS INTEGER) AS VARCHAR) || '%' AS progress FROM captures""",
    ),
)
def stream_progress(spark, sf):
    """The last status a callback was given; it saw one per micro-batch."""
    seen = []
    run = progress.stream_progress(
        _captures(spark, sf), seen.append, scratch_path(spark, "progress"), availableNow=True
    )
    run.awaitTermination()
    return spark.createDataFrame([tuple(seen[-1].values())], _STATUS)


def _land(spark, folders, landed, checkpoint, inbox) -> None:
    """Let listing files appear and land them together."""
    for folder in folders:
        move(spark, folder, f"{inbox}/{folder.rpartition('/')[2]}")
    stream.land_lines(spark, f"{inbox}/*", landed, checkpoint).awaitTermination()


def _landings(folders, most=LANDINGS) -> list[list[str]]:
    """Folders that land together, in order: as many landings as a small listing has files, larger ones for a large one."""
    size = -(-len(folders) // most)
    return [folders[k : k + size] for k in range(0, len(folders), size)]


@query("stream_landed", o.stmt(o.LISTING, "SELECT row_number() OVER (ORDER BY line_no) AS place, line FROM lines"))
def stream_landed(spark, sf):
    """Files that land one after the other: every line once, by batch and line in the order of the listing."""
    landed, land, inbox = (scratch_path(spark, n) for n in ("landed", "land", "inbox"))
    for folders in _landings(listing_files(spark, sf)):
        _land(spark, folders, landed, land, inbox)
    lines = spark.read.schema("line_no long, line string, batch_id long").parquet(landed)
    # batches are few; rows of a batch follow each other by number
    named = lines.select(F.lpad(F.col("batch_id").cast("string"), 20, "0").alias("src_file"), F.col("line_no").alias("scid"), "line")
    stored = cut_lineage(named, "landed-lines")
    return versions.enumerate_captures(stored, into="place").select("place", "line")


def _store(spark, mode, results_root=None) -> CaptureStore:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return CaptureStore(spark, scratch_path(spark, "store"), mode, results_root, buckets)


def _resumed(spark, sf, mode, results_root=None, between=None, callback=None) -> CaptureStore:
    """A job over half of the listing's files, whose versions are stored; the other half as a stream."""
    files = listing_files(spark, sf)
    half = len(files) // 2
    store = _store(spark, mode, results_root)
    done = CaptureJob(mode=mode).run(spark, files[:half], scratch_path(spark, "run"))
    store.merge(done.versions.withColumn("batch_id", F.lit(-1)), "job", 0)
    if between is not None:
        between()
    landed, inbox, land, merge = (scratch_path(spark, n) for n in ("landed", "inbox", "land", "merge"))
    for folders in _landings(files[half:], LANDINGS // 2):
        _land(spark, folders, landed, land, inbox)
        rows = stream.stream_captures(stream.read_landed(spark, landed))
        merge_captures(rows, store, merge, callback, "download").awaitTermination()
    return store


@query("stream_resume", o.stmt(o.KEPT, f"SELECT {', '.join(RESUMED)} FROM kept"))
def stream_resume(spark, sf):
    """Half of a listing stored by a job, half streamed: the versions are those of a single run."""
    return _resumed(spark, sf, "last").read().select(*RESUMED)


@query("stream_resume_first", o.stmt([*o.DISTINCTS, o.kept_cte("first")], f"SELECT {', '.join(RESUMED)} FROM kept"))
def stream_resume_first(spark, sf):
    return _resumed(spark, sf, "first").read().select(*RESUMED)


@query("stream_resume_all", o.stmt(o.DISTINCTS, f"SELECT {', '.join(RESUMED)} FROM distinct_captures"))
def stream_resume_all(spark, sf):
    return _resumed(spark, sf, "all").read().select(*RESUMED)


_OVERLAID = ["timestamp", "url_origin", "url_archive", "url_key", "redirect_url", "redirect_timestamp", "response", "file"]


@query("stream_overlay", o.stmt([*o.KEPT, o.EARLIER, o.worked_cte("kept")], f"SELECT {', '.join(_OVERLAID)} FROM worked"))
def stream_overlay(spark, sf):
    """Results of one run lie over the stored half, those of a later run over all, also over what is stored already."""
    root = scratch_path(spark, "results")
    rows = cut_lineage(d.earlier_results(spark, sf), "earlier")

    def write(run, some):
        results.write_results(some.orderBy("csv_line").drop("csv_line"), f"{root}/run={run}")

    write(1, rows.where(F.col("csv_line") % 3 == 0))
    return _resumed(spark, sf, "last", root, between=lambda: write(2, rows)).read().select(*_OVERLAID)


@query(
    "stream_status",
    o.stmt(
        o.DISTINCTS,
        """SELECT 'download' AS task, count(response) AS current, count(*) AS total,
        CAST(CAST(round_even(100.0 * count(response) / count(*), 0) AS INTEGER) AS VARCHAR) || '%' AS progress FROM distinct_captures""",
    ),
)
def stream_status(spark, sf):
    """The last status that a callback was given: distinct captures, however often they came."""
    seen = []
    _resumed(spark, sf, "all", callback=seen.append)
    return spark.createDataFrame([tuple(seen[-1].values())], _STATUS)


@query("stream_distinct", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures"))
def stream_distinct(spark, sf):
    log = scratch_path(spark, "changes")
    distinct = stream.dedup_stream(_captures(spark, sf))
    stream.append_changes(distinct, log, scratch_path(spark, "stream")).awaitTermination()
    return stream.current(spark, log, ("timestamp", "url_origin")).select(*CAPTURE_COLUMNS)


@query("stream_compacted", o.stmt(o.KEPT, f"SELECT {', '.join(RESUMED)} FROM kept"))
def stream_compacted(spark, sf):
    """Winners read from snapshots of a change log and the batches behind them, compacted while it grows."""
    log, landed, inbox, land, merge = (scratch_path(spark, n) for n in ("changes", "landed", "inbox", "land", "merge"))
    for k, folders in enumerate(_landings(listing_files(spark, sf))):
        _land(spark, folders, landed, land, inbox)
        winners = stream.keep_versions_stream(stream.stream_captures(stream.read_landed(spark, landed)), "last")
        stream.append_changes(winners, log, merge).awaitTermination()
        if k in (1, 2):
            stream.compact(spark, log)
    return stream.current(spark, log).select(*RESUMED)
