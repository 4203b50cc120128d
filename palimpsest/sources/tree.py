"""Stored files, as a table clustered by domain or as loose files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


# Folders of the table.
PARTS = 256


def write_snapshot_tree(stored: DataFrame, path: str, by_timestamp: bool = False, parts: int = PARTS) -> None:
    """Write ``(domain, [timestamp,] rel_path, body)`` as parquet below ``part=``.

    A domain lies in one of ``parts`` folders, sorted by domain, time and path, so that the number of
    folders does not grow with the web. Parts are dealt by a rebalancing shuffle: adaptive execution
    splits those that hold more bytes than a task should write, be it one large domain or
    many small ones, and puts small ones together, so writers and files grow with the bytes.
    """
    levels = ["domain", "timestamp"] if by_timestamp else ["domain"]
    part = F.pmod(F.xxhash64("domain"), F.lit(parts)).alias("part")
    (
        stored.select(part, *levels, "rel_path", "body")
        .hint("rebalance", F.col("part"))
        .sortWithinPartitions("part", *levels, "rel_path")
        .write.mode("overwrite")
        .partitionBy("part")
        .parquet(path)
    )


def export_files(stored: DataFrame, root: str) -> None:
    """Write each body to ``root/rel_path`` on a file system all executors mount.

    Paths must already be free of conflicts. A file appears under its name only once it
    is whole, so a task that runs twice leaves the same files.
    """

    def write(rows: Iterable[Row]) -> None:
        for row in rows:
            target = os.path.join(root, row.rel_path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(row.body)
            os.replace(part, target)

    stored.where(F.col("body").isNotNull()).select("rel_path", "body").foreachPartition(write)
