"""Counts, status and the funnel of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import archive, report
from palimpsest.operators import versions
from palimpsest.operators.filters import has_file
from palimpsest.session import cut_lineage


def counts(captures: DataFrame) -> DataFrame:
    """All counts of a capture table in one pass."""
    open_ = F.col("response").isNull()
    return captures.agg(
        F.count("*").alias("total"),
        F.count_if(~open_).alias("handled"),
        F.count_if(open_).alias("unhandled"),
        F.count_if(has_file()).alias("success"),
        F.count_if(~has_file()).alias("fail"),
    )


def job_status(captures: DataFrame, task: str) -> DataFrame:
    return status_of(counts(captures), task)


def status_of(counted: DataFrame, task: str) -> DataFrame:
    """The status of a row with ``handled`` and ``total``."""
    return counted.select(
        F.lit(task).alias("task"),
        F.col("handled").alias("current"),
        "total",
        report.progress_pct(F.col("handled"), F.col("total")).alias("progress"),
    )


def status_row(spark: SparkSession, task: str, handled: int, total: int) -> DataFrame:
    """The status for counts that are known already."""
    return status_of(spark.createDataFrame([(handled, total)], "handled long, total long"), task)


def job_summary(captures: DataFrame) -> DataFrame:
    return counts(captures).select(
        F.col("success").alias("downloaded"), F.col("fail").alias("skipped")
    )


def outcome_lines(outcomes: DataFrame, total: int | None = None) -> DataFrame:
    """One report line per outcome; ``outcomes`` is numbered."""
    whole = F.lit(total) if total is not None else outcomes.agg(F.count("*")).scalar()
    line = report.outcome_line(
        F.col("counter"), whole, F.col("outcome"), F.col("timestamp"), F.col("url_origin")
    )
    return outcomes.select("counter", line.alias("line"))


def capture_funnel(
    lines: DataFrame, mode: str = "last", skip_first: bool = False, overlaid: DataFrame | None = None
) -> DataFrame:
    """Where the lines of a listing went.

    ``lines`` are parsed lines with ``url_key``; ``mode`` and ``skip_first`` are those of the job.
    ``overlaid`` are its captures with earlier results laid over them: what they close besides
    the preset codes is ``skip_existing``. Lines, distinct captures and kept versions are counted
    apart; the latter two are the same group-limited windows that choose them, so no key weighs
    on a task. ``lines`` is read three times and should be a stored table.
    """
    rows = lines.where("verdict = 'ok'").withColumn("scid", F.col("line_no"))
    rows = rows.withColumn("response", archive.preset_response(F.col("statuscode")))
    order = [c for c in ("src_file", "scid") if c in rows.columns]
    rows = rows.select(*order, "url_key", "timestamp", "url_origin", "response")

    def counted(df: DataFrame) -> Column:
        preset = F.count_if(F.col("response").isNotNull())
        return df.agg(F.struct(F.count("*").alias("rows"), preset.alias("preset"))).scalar()

    captures = counted(versions.dedup_first(rows))
    kept = counted(versions.keep_versions(rows, mode, skip_first))
    existing = F.lit(0).cast("long")
    if overlaid is not None:
        later = F.col("response").isNotNull() & archive.preset_response(F.col("statuscode")).isNull()
        existing = overlaid.agg(F.count_if(later)).scalar()
    set_aside = captures["preset"] if skip_first else F.lit(0).cast("long")
    closed = kept["preset"]
    seen = lines.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("faulty", "malformed", "mailto", "ok")],
    )
    return seen.select(
        "total",
        "faulty",
        "malformed",
        "mailto",
        (F.col("ok") - captures["rows"]).alias("duplicates"),
        (captures["rows"] - set_aside - kept["rows"]).alias("versions"),
        kept["rows"].alias("kept"),
        (set_aside + closed).alias("skip_statuscode"),
        existing.alias("skip_existing"),
        (kept["rows"] - closed - existing).alias("to_utilize"),
    )


def counted_captures(lines: DataFrame) -> DataFrame:
    """Distinct captures of a listing, each with the number of its ``lines``; ``lines`` is read once.

    Lines that are no captures come down to a row per ``verdict``, whose other columns are NULL. The
    first arrival stands for its duplicates. All of it is one aggregate that combines before its shuffle,
    so that neither a capture listed over and over nor a verdict weighs on a task.
    """
    rows = lines.withColumn("scid", F.col("line_no"))
    rows = rows.withColumn("response", archive.preset_response(F.col("statuscode")))
    ok = F.col("verdict") == "ok"
    order = [c for c in ("src_file", "scid") if c in rows.columns]
    whole = [c for c in rows.columns if c not in ("line", "line_no", "verdict")]
    keyed = rows.select(
        "verdict",
        *[F.when(ok, F.col(c)).alias(f"__{c}") for c in ("timestamp", "url_origin")],
        F.struct(*order).alias("__arrival"),
        F.when(ok, F.struct(*whole)).alias("__first"),
    )
    combined = keyed.groupBy("verdict", "__timestamp", "__url_origin").agg(
        F.min_by("__first", "__arrival").alias("__first"), F.count(F.lit(1)).alias("lines")
    )
    return combined.select("verdict", "lines", "__first.*")


def capture_funnel_once(
    lines: DataFrame, mode: str = "last", skip_first: bool = False, overlaid: DataFrame | None = None
) -> DataFrame:
    """``capture_funnel`` that reads ``lines`` once.

    Distinct captures are stored with what they stand for; lines and duplicates are counted from
    a few columns of that table, and versions are chosen among its rows.
    """
    counted = cut_lineage(counted_captures(lines), "counted")
    ok, preset = F.col("verdict") == "ok", F.col("response").isNotNull()

    def lines_of(verdict: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("lines"))), F.lit(0)).alias(verdict)

    seen = counted.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total"),
        *[lines_of(v) for v in ("faulty", "malformed", "mailto", "ok")],
        F.count_if(ok).alias("captures"),
        F.count_if(ok & preset & F.lit(skip_first)).alias("aside"),
    )
    kept = versions.keep_versions(counted.where(ok), mode, skip_first)
    chosen = kept.agg(F.struct(F.count("*").alias("rows"), F.count("response").alias("preset"))).scalar()
    existing = F.lit(0).cast("long")
    if overlaid is not None:
        later = F.col("response").isNotNull() & archive.preset_response(F.col("statuscode")).isNull()
        existing = overlaid.agg(F.count_if(later)).scalar()
    return seen.select(
        "total",
        "faulty",
        "malformed",
        "mailto",
        (F.col("ok") - F.col("captures")).alias("duplicates"),
        (F.col("captures") - F.col("aside") - chosen["rows"]).alias("versions"),
        chosen["rows"].alias("kept"),
        (F.col("aside") + chosen["preset"]).alias("skip_statuscode"),
        existing.alias("skip_existing"),
        (chosen["rows"] - chosen["preset"] - existing).alias("to_utilize"),
    )
