"""Columns and one Arrow function over stored bodies."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how many leading bytes decide whether a body is HTML.
SNIFF_BYTES = 2048

# Unpacked bytes that travel back in one batch; a larger body travels alone.
BATCH_BYTES = 256 << 20

# first element of an HTML file, after blanks and comments
_HTML_START = r"(?is)^\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|title|body|script)"


def is_html(body: Column) -> Column:
    """Whether a body looks like HTML, judged by its first ``SNIFF_BYTES`` bytes.

    Looking only there is the rule itself, not a shortcut: type detection by content
    reads the head of a file.
    """
    head = F.decode(F.substring(body.cast("binary"), 1, SNIFF_BYTES), "ISO-8859-1")
    return F.coalesce(head.rlike(_HTML_START), F.lit(False))


def _gunzip(bodies: Column) -> Column:
    """Unpacked bodies, NULL for those that are not gzip."""

    most = BATCH_BYTES

    # nested, so that it travels to the executors by value
    def unpack(body: bytes) -> bytes | None:
        try:
            return gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return None

    # an Arrow array holds two gigabytes; rows may come back in more batches than they went
    @F.arrow_udf(T.BinaryType())
    def unpack_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done, size = [], 0
            for item in batch:
                body = unpack(item.as_py()) if item.is_valid else None
                if size and size + len(body or b"") > most:
                    yield pa.array(done, pa.binary())
                    done, size = [], 0
                done.append(body)
                size += len(body or b"")
            yield pa.array(done, pa.binary())

    return unpack_all(bodies)


def decode_payload(payloads: DataFrame) -> DataFrame:
    """Unpack gzip bodies; a body that is not gzip after all stays as it is.

    Adds ``decode_ok``. Spark has no gzip expression, so packed bodies - and only those -
    pass through Arrow batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows;
    plain bodies stay in the JVM.
    """
    packed = F.coalesce(F.col("encoding") == "gzip", F.lit(False)) & F.col("body").isNotNull()
    return (
        payloads.withColumn("__plain", _gunzip(F.when(packed, F.col("body"))))
        .withColumn("decode_ok", ~packed | F.col("__plain").isNotNull())
        .withColumn("body", F.coalesce("__plain", "body"))
        .drop("__plain")
    )
