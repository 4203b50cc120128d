"""Duplicates, versions per file, and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("all", "first", "last")

# ids per numbering block: small enough for one task to sort with ease
BLOCK_BITS = 16


def arrival(df: DataFrame) -> list[Column]:
    """Order of arrival: by ``scid``, after the file name where several files came."""
    return [F.col(c) for c in ("src_file", "scid") if c in df.columns]


def top_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key.

    Spark turns ``row_number() = 1`` into a group limit ahead of the shuffle: each input
    partition passes on one row per key, however many it holds, so a hot key stays small.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def dedup_first(captures: DataFrame) -> DataFrame:
    """First arrival per timestamp and address, whatever its status."""
    return top_of(captures, ["timestamp", "url_origin"], *arrival(captures))


def keep_last(captures: DataFrame) -> DataFrame:
    """Latest version of each file; the first arrival wins a tie."""
    return top_of(captures, ["url_key"], F.desc("timestamp"), *arrival(captures))


def keep_first(captures: DataFrame) -> DataFrame:
    """Earliest version of each file; the first arrival wins a tie."""
    return top_of(captures, ["url_key"], F.asc("timestamp"), *arrival(captures))


def keep_all(captures: DataFrame) -> DataFrame:
    """All versions; the timestamp becomes part of the path instead."""
    return captures


def keep_versions(captures: DataFrame, mode: str, skip_first: bool = False) -> DataFrame:
    """Duplicates and versions in one step, for any mode.

    Rows with the same timestamp and address share their key. The winner of a key by time
    and arrival is therefore the first of its duplicates, and in the modes ``first`` and
    ``last`` one shuffle by key does the work of both steps.

    ``skip_first`` sets captures with a preset response aside before choosing, so that a
    late 404 does not hide an earlier good version.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if skip_first:
        captures = dedup_first(captures).where(F.col("response").isNull())
    if mode == "last":
        return keep_last(captures)
    if mode == "first":
        return keep_first(captures)
    return keep_all(dedup_first(captures))


def enumerate_captures(df: DataFrame, by: str = "scid", into: str = "counter") -> DataFrame:
    """Number rows 1..n in the order of a distinct integer column, without one big sort.

    Ids are cut into blocks of ``2**BLOCK_BITS`` values, so no block can hold more rows
    than that. Rows are numbered inside their block; a block starts after the rows of all
    blocks before it. Those offsets come from block counts, summed the same way one level
    up, and only the counts of the topmost level, one per ``2**(2*BLOCK_BITS)`` ids, meet
    in a single task. With several files the file name comes before the block. ``df`` is
    read three times, so it should be a stored table.
    """
    files = [c for c in ("src_file",) if c in df.columns]
    earlier = (W.unboundedPreceding, -1)

    def start(window) -> Column:
        return F.coalesce(F.sum("__n").over(window.rowsBetween(*earlier)), F.lit(0))

    rows = df.withColumn("__block", F.shiftright(by, BLOCK_BITS))
    blocks = (
        rows.groupBy(*files, "__block")
        .agg(F.count("*").alias("__n"))
        .withColumn("__upper", F.shiftright("__block", BLOCK_BITS))
    )
    uppers = (
        blocks.groupBy(*files, "__upper")
        .agg(F.sum("__n").alias("__n"))
        .withColumn("__upper_start", start(W.orderBy(*files, "__upper")))
        .drop("__n")
    )
    starts = (
        blocks.withColumn("__start", start(W.partitionBy(*files, "__upper").orderBy("__block")))
        .join(uppers, [*files, "__upper"])
        .select(*files, "__block", (F.col("__start") + F.col("__upper_start")).alias("__start"))
    )
    rank = F.row_number().over(W.partitionBy(*files, "__block").orderBy(by))
    return (
        rows.withColumn("__rank", rank)
        .join(starts, [*files, "__block"])
        .withColumn(into, F.col("__start") + F.col("__rank"))
        .select(*[c for c in df.columns if c != into], into)
    )


def order_by_scid(captures: DataFrame) -> DataFrame:
    """Captures in arrival order, as a parallel range sort."""
    return captures.orderBy(*arrival(captures))
