"""Tables kept in buckets by the hash of a key, of which an update rewrites only those that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import children, exists, move, remove

BUCKETS = 256


class BucketTable:
    """A parquet table below ``path/rows``, partitioned by ``bucket``.

    An update has two steps: first the whole content of the buckets that change is written, to a
    folder of its own that carries the update's number, then the folders of these buckets are moved in place.
    A run that dies in the second step leaves buckets missing or old; ``replay`` moves those that are
    still to come, so an update is either seen whole or finished. Updates follow each other;
    two writers at a time are not supported, and a reader during the second step may have to
    read again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        self.key = key
        self.buckets = buckets

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    def _pending(self, number: int) -> str:
        return f"{self.path}/pending/update={number}"

    def bucket(self) -> Column:
        """The bucket of a row, by its key columns."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their folders are listed and read."""
        if buckets is not None and not buckets:
            return self.spark.createDataFrame([], self.schema)
        if not exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.rows_path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that rows fall into; as many as there are buckets at most."""
        return [r.bucket for r in rows.select(self.bucket()).distinct().collect()]

    def is_prepared(self, number: int) -> bool:
        return exists(self.spark, f"{self._pending(number)}/_SUCCESS")

    def prepare(self, number: int, rows: DataFrame) -> None:
        """Store the new content of the buckets that an update changes; all rows of theirs are given."""
        (
            self.with_bucket(rows)
            .select(*self.schema.names)
            .repartition("bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(self._pending(number))
        )

    def replay(self, number: int) -> None:
        """Move the buckets that ``prepare`` has stored in place; doing so again changes nothing."""
        pending = self._pending(number)
        for name in children(self.spark, pending):
            if name.startswith("bucket="):
                remove(self.spark, f"{self.rows_path}/{name}")
                move(self.spark, f"{pending}/{name}", f"{self.rows_path}/{name}")
        for name in children(self.spark, f"{self.path}/pending"):
            if name != f"update={number}":
                remove(self.spark, f"{self.path}/pending/{name}")
