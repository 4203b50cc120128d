"""Result files of earlier runs, as CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import RESULT_FIELDS, RESULTS

_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
ROWS_PER_FILE = 5_000_000


def has_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted value of the files goes on in the next line: a line then has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def scan_results(spark: SparkSession, path: str | list[str], multi_line: bool | None = None) -> DataFrame:
    """Rows of earlier results, ordered by ``src_file`` and ``csv_line``.

    Empty values read as NULL. Quoted line breaks need ``multi_line``, which reads one file per task;
    without it large files are split. Unless told, the files are looked through for such breaks
    first, in parallel, and are split if there are none.
    """
    if multi_line is None:
        multi_line = has_line_breaks(spark, path)
    raw = spark.read.schema(RESULTS).options(**_CSV, multiLine=multi_line).csv(path)
    return raw.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.monotonically_increasing_id().alias("csv_line"),
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in RESULT_FIELDS],
    )


def result_rows(captures: DataFrame) -> DataFrame:
    """What a result file holds: every capture that has a response."""
    return captures.where(F.col("response").isNotNull()).select(*RESULT_FIELDS)


def write_results(captures: DataFrame, path: str) -> None:
    (
        result_rows(captures)
        .write.mode("overwrite")
        .options(**_CSV, emptyValue="", maxRecordsPerFile=ROWS_PER_FILE)
        .csv(path)
    )
