"""Schemas of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Field order of a capture listing line.
LISTING_FIELDS = ["timestamp", "digest", "mimetype", "statuscode", "original"]

# Column order of the result file.
RESULT_FIELDS = [
    "timestamp",
    "url_archive",
    "url_origin",
    "redirect_url",
    "redirect_timestamp",
    "response",
    "file",
]

# Listed status codes that are final without fetching anything.
PRESET_CODES = ["301", "404"]

# Characters encoded in paths, those encoded in plain addresses, and those that
# become dots in a single file name.
PATH_SPECIALS = [":", "*", "?", "&", "=", "<", ">", "\\", "|", "#", "!", "~"]
URL_SPECIALS = [":", "*", "?", "&", "=", "<", ">", "\\", "|"]
NAME_SPECIALS = ["<", ">", ":", '"', "/", "\\", "|", "?", "*", "=", "#", "!", "~"]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


RESULTS = T.StructType(_strings(*RESULT_FIELDS))

PAYLOADS = T.StructType(
    [
        T.StructField("url_archive", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("body", T.BinaryType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("progress", T.StringType()),
    ]
)
