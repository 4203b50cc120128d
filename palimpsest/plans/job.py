"""A capture job: from a listing to one stored file per address."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import paths, urls
from palimpsest.functions import report as report_columns
from palimpsest.operators import fetched, filters, overlay, report, versions
from palimpsest.plans.ledger import Ledger
from palimpsest.session import cut_lineage
from palimpsest.sources import listing, tree
from palimpsest.sources import payloads as payload_source
from palimpsest.sources import results as result_source
from palimpsest.streaming.progress import notify


# Spark numbers the rows of one scan below this many bits; intakes are numbered above them.
INTAKE_BITS = 57


@dataclass(frozen=True)
class CaptureJob:
    """What to take from a listing and how.

    ``mode`` is ``last``, ``first`` or ``all``. ``range_years`` wins over ``start`` and
    ``end``. ``filetype`` and ``statuscode`` are lists; ``limit`` takes the first lines.
    """

    url: str | None = None
    mode: str = "last"
    explicit: bool = False
    range_years: int | None = None
    start: str | None = None
    end: str | None = None
    limit: int | None = None
    filetype: tuple[str, ...] = ()
    statuscode: tuple[str, ...] = ()
    merge_www: bool = True
    redirects: bool = True
    embedded: str = "cut"
    skip_first: bool = False
    as_of: date | None = None

    def __post_init__(self) -> None:
        if self.mode not in versions.MODES:
            raise ValueError(f"mode must be one of {versions.MODES}, not {self.mode!r}")

    @property
    def job_id(self) -> str:
        """Same parameters, same id; each value stands in its own field."""
        values = json.dumps(asdict(self), sort_keys=True, default=str)
        return hashlib.sha256(values.encode()).hexdigest()

    def dated(self, ledger: Ledger) -> CaptureJob:
        """The job with the day that its years count back from: that of its first run, unless given."""
        if not self.range_years or self.as_of:
            return self
        day = ledger.first_entry("as-of ")
        if day is None:
            day = date.today().isoformat()
            ledger.enter(f"as-of {day}", 0, "")
        return replace(self, as_of=date.fromisoformat(day))

    def selected(self, parsed: DataFrame) -> DataFrame:
        """Listing lines the job asks for. Lines that cannot be read are always shown."""
        asked = F.lit(True)
        if self.url:
            domain = F.col("domain") if "domain" in parsed.columns else None
            asked = asked & filters.at_address(self.url, self.explicit, domain, self.merge_www)
        if self.range_years:
            asked = asked & filters.in_time(filters.range_start(self.range_years, self.as_of))
        else:
            asked = asked & filters.in_time(self.start, self.end)
        if self.filetype:
            asked = asked & filters.has_filetype(list(self.filetype))
        if self.statuscode:
            asked = asked & filters.has_statuscode(list(self.statuscode))
        rows = parsed.where(F.col("verdict").isin("faulty", "malformed") | asked)
        return filters.limit_captures(rows, self.limit) if self.limit else rows

    def lines(
        self, spark: SparkSession, path: str | list[str], intake: int = 1, files: DataFrame | None = None
    ) -> DataFrame:
        """Parsed and selected lines of a listing, or of its ``files``; only unread ones keep their text.

        Lines of a later intake are numbered behind those of all before it.
        """
        bad = listing.header_problems(spark, path, files).take(1)
        if bad:
            raise ValueError(f"{bad[0].src_file} holds {bad[0].headers} header lines instead of one")
        scanned = listing.scan_listing(spark, path, files)
        scanned = scanned.withColumn("line_no", F.col("line_no") + F.lit((intake - 1) << INTAKE_BITS))
        parsed = listing.parse_listing(scanned)
        keep = ("domain", "url_key")
        keyed = urls.with_url_parts(parsed, "url_origin", self.merge_www, self.embedded, keep)
        unread = F.col("verdict").isin("faulty", "malformed")
        return self.selected(keyed).withColumn("line", F.when(unread, F.col("line")))

    def all_lines(self, spark: SparkSession, path: str | list[str], ledger: Ledger) -> tuple[DataFrame, int]:
        """Stored lines of all intakes, and how many there are. Only new files are read."""
        intakes = ledger.take_in(listing.listing_files(spark, path))
        dated, tables = self.dated(ledger), []
        for k in range(1, intakes + 1):
            files = spark.read.parquet(ledger.stage_path(f"files-{k}"))
            tables.append(ledger.run_stage(f"lines-{k}", lambda k=k, files=files: dated.lines(spark, path, k, files)))
        lines = reduce(DataFrame.unionByName, tables)
        # the first lines of all intakes are among the first lines of each
        return (filters.limit_captures(lines, self.limit) if self.limit else lines), intakes

    def captures(self, parsed: DataFrame) -> DataFrame:
        return listing.to_captures(parsed, self.merge_www, self.embedded)

    def versions(self, captures: DataFrame) -> DataFrame:
        return versions.keep_versions(captures, self.mode, self.skip_first)

    def outcomes(
        self,
        captures: DataFrame,
        index: DataFrame,
        bodies: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Outcome of every open capture that the payload index knows.

        Files that captures already have are places taken. ``bodies`` is asked for the addresses
        that files will be made of, when the index does not know which are HTML.
        """
        joined = fetched.attach_payloads(captures, index)
        if self.redirects:
            joined = fetched.follow_redirects(joined, index)
        else:
            joined = fetched.without_redirects(joined)
        if bodies is not None:
            joined = cut_lineage(joined, "followed")
            goals = joined.where("final_status = 200").select("body_address").distinct()
            joined = fetched.with_sniffed(joined, bodies(cut_lineage(goals, "goals")))
        stored = None
        if "file" in captures.columns:
            stored = captures.where(filters.has_file()).select(F.col("file").alias("rel_path"))
        return fetched.with_outcomes(joined, self.mode, stored, self.merge_www, self.embedded)

    def overlaid(self, captures: DataFrame, results: DataFrame | None = None) -> DataFrame:
        """Captures with the results of earlier runs laid over them."""
        empty = {c: F.lit(None).cast("string") for c in ("redirect_url", "redirect_timestamp", "file")}
        rows = captures.withColumns(empty)
        return rows if results is None else overlay.overlay_results(rows, results)

    def run(
        self,
        spark: SparkSession,
        listing_path: str | list[str],
        root: str,
        payloads: DataFrame | None = None,
        results_path: str | None = None,
        export_root: str | None = None,
        progress: Callable[[dict[str, Any]], None] | None = None,
    ) -> JobTables:
        """Run stage by stage below ``root``; stages an earlier run finished are kept.

        Every run lays earlier results over the captures, those of ``results_path`` or of
        the last run, works on the captures still open, and writes all results anew. With
        a payload table that has grown, a further run so takes up what was missing. Files that
        came to the listing are read and join the lines of earlier runs, so the versions are
        those of one run over all files; a listing that lost or changed a file is refused.

        ``export_root`` also gets the stored files one by one. ``progress`` is called with the
        status before and after payloads are taken up.
        """
        ledger = Ledger(spark, root, self.job_id)
        lines, intakes = self.all_lines(spark, listing_path, ledger)
        kept = ledger.run_stage(f"versions-{intakes}", lambda: self.versions(self.captures(lines)))
        numbered = ledger.run_stage(f"numbered-{intakes}", lambda: versions.enumerate_captures(kept))

        number = ledger.runs() + 1
        earlier = results_path or (ledger.stage_path(f"results/run={number - 1}") if number > 1 else None)
        results = result_source.scan_results(spark, earlier) if earlier else None
        # what a run that died left behind counts only for the same inputs
        tag = f"{number}-{intakes}"
        rows = ledger.run_stage(f"overlaid-{tag}", lambda: self.overlaid(numbered, results))
        final, done = rows, None

        def tell(task: str, captures: DataFrame) -> None:
            if progress is not None:
                for row in report.job_status(captures, task).take(1):
                    notify(progress, row.asDict())

        tell("select", rows)
        if payloads is not None:
            tag = f"{tag}-{payload_source.fingerprint(payloads)}"
            index = ledger.run_stage(f"index-{tag}", lambda: fetched.narrow_index(payloads))
            twice = payload_source.repeated_addresses(index).take(1)
            if twice:
                raise ValueError(
                    f"{twice[0].url_archive} has {twice[0].payloads} payloads; "
                    "choose one with one_per_address when the payload table is made"
                )
            sniffed = "is_html" in payloads.columns

            def bodies(goals: DataFrame) -> DataFrame:
                return ledger.run_stage(f"bodies-{tag}", lambda: fetched.wanted_bodies(payloads, goals))

            done = ledger.run_stage(
                f"outcomes-{tag}", lambda: self.outcomes(rows, index, None if sniffed else bodies)
            )
            plain = payloads if sniffed else spark.read.parquet(ledger.stage_path(f"bodies-{tag}"))
            files = fetched.stored_files(done, plain)
            tree.write_snapshot_tree(files, ledger.stage_path(f"tree/run={number}"), self.mode == "all")
            if export_root:
                tree.export_files(files, export_root)
            final = ledger.run_stage(f"final-{tag}", lambda: overlay.apply_outcomes(rows, done))
            tell("download", final)
        written = ledger.stage_path(f"results/run={number}")
        result_source.write_results(final, written)
        tables = JobTables(self, lines, numbered, rows, done, final, ledger, written)
        counts = report.counts(final)
        text = report_columns.progress_text(F.col("handled"), F.col("total")).alias("progress")
        state = counts.select("total", text).first()
        ledger.enter(f"run-{number}", state.total, state.progress)
        return tables


@dataclass(frozen=True)
class JobTables:
    """Tables of a run and the reports over them."""

    job: CaptureJob
    lines: DataFrame
    versions: DataFrame
    overlaid: DataFrame
    outcomes: DataFrame | None
    final: DataFrame
    ledger: Ledger
    results_path: str

    def status(self) -> DataFrame:
        return report.job_status(self.final, "done")

    def summary(self) -> DataFrame:
        return report.job_summary(self.final)

    def funnel(self) -> DataFrame:
        return report.capture_funnel(self.lines, self.job.mode, self.job.skip_first, self.overlaid)

    def outcome_lines(self) -> DataFrame:
        """A line of text per capture that was taken up, by its number; needs payloads."""
        if self.outcomes is None:
            raise ValueError("the run had no payloads")
        return report.outcome_lines(self.outcomes, self.final.count())

    def too_long(self, root: str = "", limit: int = paths.PATH_LIMIT) -> DataFrame:
        files = self.final.where(filters.has_file()).withColumn("rel_path", F.col("file"))
        return fetched.flag_long_paths(files, limit, root).where("too_long")
