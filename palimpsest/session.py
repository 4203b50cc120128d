"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "palimpsest") -> SparkSession:
    """A single-machine session for tests and the benchmark.

    A cluster brings its own session; nothing in the package depends on this one.
    """
    parts = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local session, where the driver is the sole executor, may go without the
    setting; there a folder is made once and remembered in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    named = spark.conf.get("palimpsest.local.dir", None)
    if named:
        return named
    named = tempfile.mkdtemp(prefix="palimpsest-", dir="/tmp")
    spark.conf.set("palimpsest.local.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; two runs never write to the same one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from a table written to the shared folder.

    For results that several branches of a plan go on from: they are computed once, a lost
    executor costs a read instead of a recomputation, and the table's size is known when
    the next join is planned.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _system(spark: SparkSession, path: str):
    """The file system of a path, as Spark uses it, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder on the storage that Spark uses."""
    system, place = _system(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, place = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of this package's own making with all that is in it."""
    system, place = _system(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another path on the same storage; folders above it are made."""
    system, place = _system(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"{source} cannot be moved to {target}")
