"""What the operators share: shipping code to workers, stored tables, running totals."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import palimpsest
from palimpsest.session import cut_lineage, scratch_path

__all__ = ["arrow_batches", "cut_lineage", "held_out", "map_arrow", "row_key", "running_total", "scratch_path", "texts"]

Batches = Iterator[pa.RecordBatch]


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` of any table, so that its other columns cannot clash."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package also where it is not installed."""
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(palimpsest.__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return df.mapInArrow(fn, schema)


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Spark hands Python batches of about so many bytes in what is run inside; a session that names a size keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name)


def row_key(partition: int, counter: int) -> int:
    """A number of its own for every row of a stored table, ascending inside a partition."""
    return (partition << 36) + counter


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the part of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def running_total(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, by ``group`` and ``order`` inside it.

    Groups are numbers from 0. Three levels: rows inside a group, groups inside a run of 1,024
    groups, and runs; only the last is one task, of a row per 1,024 groups.
    """
    inside = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.expr(f"`{group}` div 1024")
    totals = df.groupBy(group).agg(F.sum(value).alias("__sum")).withColumn("__run", run)
    in_run = Window.partitionBy("__run").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy("__run").agg(F.sum("__sum").alias("__run_sum"))
    runs = runs.select("__run", F.coalesce(F.sum("__run_sum").over(over_runs), F.lit(0)).alias("__run_base"))
    bases = (
        totals.withColumn("__base", F.coalesce(F.sum("__sum").over(in_run), F.lit(0)))
        .join(runs, "__run")
        .select(group, (F.col("__base") + F.col("__run_base")).alias("__base"))
    )
    return (
        df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, group)
        .withColumn(out, F.col("__base") + F.col("__inside"))
        .drop("__inside", "__base")
    )
