"""Payload tables: one fetched response per archive address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import content


def one_per_address(payloads: DataFrame, *order: str) -> DataFrame:
    """First response per archive address by ``order``.

    Spark limits each group before the shuffle, so an address fetched over and over
    sends one row per input partition.
    """
    rank = F.row_number().over(W.partitionBy("url_archive").orderBy(*order))
    return payloads.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def with_sniffed(payloads: DataFrame) -> DataFrame:
    """Unpacked payloads with ``is_html`` stored beside the body.

    Done once when a payload table is made, it spares every later run the look into the
    bodies.
    """
    plain = content.decode_payload(payloads).drop("decode_ok")
    return plain.withColumn("encoding", F.lit(None).cast("string")).withColumn(
        "is_html", content.is_html(F.col("body"))
    )


def fingerprint(payloads: DataFrame) -> str:
    """A text that changes with the rows of a payload table, from all its columns but the bodies.

    Hashes are summed, so repeated rows count as often as they come. A body that changes while all else stays
    the same does not show; a table that may change so should carry its digest or length.
    """
    narrow = sorted(c for c in payloads.columns if c != "body")
    row = payloads.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*narrow).cast("decimal(20,0)")).alias("mix")
    ).first()
    return f"{row.rows}-{int(row.mix or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def repeated_addresses(index: DataFrame) -> DataFrame:
    """Addresses with more than one payload; a narrow count that moves no bodies."""
    counts = index.groupBy("url_archive").agg(F.count("*").alias("payloads"))
    return counts.where("payloads > 1")


def save_bucketed(payloads: DataFrame, table: str, buckets: int) -> None:
    """Store payloads bucketed by archive address.

    Joins on the address then move captures only; bodies, by far the larger side, stay
    where they are.
    """
    (
        payloads.repartition(buckets, "url_archive")
        .write.mode("overwrite")
        .bucketBy(buckets, "url_archive")
        .sortBy("url_archive")
        .saveAsTable(table)
    )
