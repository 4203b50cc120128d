"""Finished stages of a job, kept as tables so that a rerun starts where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import LEDGER
from palimpsest.session import exists


class Ledger:
    """Stage tables and their record below a shared folder.

    A stage is written as parquet and entered into the record only after its commit, so a
    run that dies half way repeats just the stage it was in. Writing a stage also cuts the
    lineage: later stages read files and never recompute what came before. Runs of one job
    are to follow one another: two at a time would write the same stages.
    """

    def __init__(self, spark: SparkSession, root: str, job_id: str) -> None:
        self.spark = spark
        self.job_id = job_id
        self.root = root.rstrip("/")

    @property
    def record_path(self) -> str:
        return f"{self.root}/ledger"

    def stage_path(self, stage: str) -> str:
        return f"{self.root}/{self.job_id}/{stage}"

    def enter(self, stage: str, rows: int, progress: str) -> None:
        entry = [(self.job_id, stage, True, rows, progress)]
        self.spark.createDataFrame(entry, LEDGER).coalesce(1).write.mode("append").parquet(self.record_path)

    def entries(self) -> DataFrame:
        """The entry of each stage of this job; of repeated ones that with most rows."""
        if not exists(self.spark, self.record_path):
            return self.spark.createDataFrame([], LEDGER)
        record = self.spark.read.schema(LEDGER).parquet(self.record_path)
        return (
            record.where(F.col("job_id") == self.job_id)
            .groupBy("job_id", "stage", "done")
            .agg(F.max("rows").alias("rows"), F.max_by("progress", "rows").alias("progress"))
        )

    def is_done(self, stage: str) -> bool:
        return bool(self.entries().where((F.col("stage") == stage) & F.col("done")).take(1))

    def first_entry(self, prefix: str) -> str | None:
        """What follows a prefix in the first stage name that has it, by name."""
        found = self.entries().where(F.col("stage").startswith(prefix)).agg(F.min("stage")).first()[0]
        return None if found is None else found.removeprefix(prefix)

    def runs(self) -> int:
        """How many runs of this job have finished."""
        return self.entries().where("stage LIKE 'run-%'").count()

    def take_in(self, files: DataFrame) -> int:
        """Enter files that earlier runs did not see; how many intakes there are now.

        ``files`` has ``src_file, length, modified``. Every file belongs to one intake, and a
        stage is built from the files of its intake, so none is read twice and none ignored. A
        listing that lacks a file of an earlier run, or holds it changed, is refused.
        """
        taken = self.entries().where("stage LIKE 'files-%'").count()
        new = files
        if taken:
            known = self.spark.read.schema(files.schema).parquet(
                *[self.stage_path(f"files-{k}") for k in range(1, taken + 1)]
            )
            changed = known.exceptAll(files.select(*known.columns)).take(1)
            if changed:
                raise ValueError(f"{changed[0].src_file} was read by an earlier run; it is gone or has changed")
            new = files.join(known.select("src_file"), "src_file", "left_anti").select(*files.columns)
            if new.isEmpty():
                return taken
        self.run_stage(f"files-{taken + 1}", lambda: new)
        return taken + 1

    def run_stage(self, stage: str, build: Callable[[], DataFrame], progress: str = "") -> DataFrame:
        """The stage's table, built only if no earlier run finished it."""
        path = self.stage_path(stage)
        if not self.is_done(stage):
            build().write.mode("overwrite").parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.enter(stage, rows, progress)
        return self.spark.read.parquet(path)
