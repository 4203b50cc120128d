"""Exact duplicates by three combining steps, each comparing whole texts.

Tasks first combine the rows they read. The rest is merged by digest and salt, then the winners of
the salts are combined by digest alone. Every step groups by the whole text beside its digest, so
two texts of one digest never meet, and a group of any size sends one row per task and then one
per salt. Rows learn their group by digest afterwards; digests that several texts share, if any,
are told apart by text.

A NULL text counts as empty. Of equal texts the row with the largest id stays; NULL ids are below
all others. Of rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import cut_lineage, texts

# Into how many parts the rows of one digest are merged before the parts are combined.
SALTS = 16


def sha256(text: Column) -> Column:
    """Lowercase hex of the digest of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def _combined(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text, rows of one digest in one partition."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        merged.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def _classes(keyed: DataFrame, by: list[str], combined: DataFrame) -> DataFrame:
    """Stored groups with ``top_rows``, how many rows carry the id that stays."""
    repeats = keyed.groupBy(*by, F.col("doc_id").alias("top")).agg(F.count(F.lit(1)).alias("top_rows"))
    repeats = repeats.where("top_rows > 1").select(*[F.col(c).alias(f"r_{c}") for c in by], "top", "top_rows")
    same = [F.col(c) == F.col(f"r_{c}") for c in by] + [F.col("keep_id").eqNullSafe(F.col("top"))]
    classes = combined.join(repeats, same, "left").withColumn("top_rows", F.coalesce("top_rows", F.lit(1)))
    return cut_lineage(classes.drop("top", *[f"r_{c}" for c in by]), "exact-classes")


def _groups(
    docs: DataFrame, doc_id: str, text: str, salts: int, digest: Callable[[Column], Column]
) -> list[tuple[list[str], DataFrame, DataFrame]]:
    """Join columns, rows and groups: by digest, and by whole text where texts share a digest."""
    keyed = texts(docs, doc_id, text).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = keyed.withColumn("digest", digest(F.col("text")))
    of_digest = (
        _combined(keyed, salts)
        .groupBy("digest")
        .agg(
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("variants"),
        )
    )
    classes = _classes(keyed.select("digest", "doc_id"), ["digest"], of_digest)
    parts = [(["digest"], keyed.select("digest", "doc_id"), classes.where("variants = 1").drop("variants"))]
    shared = classes.where("variants > 1").select("digest")
    if not shared.isEmpty():
        by = ["digest", "text"]
        rows = keyed.join(shared, "digest", "left_semi").select(*by, "doc_id")
        parts.append((by, rows, _classes(rows, by, _combined(rows, salts))))
    return parts


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row, dropped ones too."""
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    found = []
    for by, rows, classes in _groups(docs, doc_id, text, salts, digest):
        top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        single = rows.join(classes, by).where(~top | (F.col("top_rows") == 1)).withColumn("kept", top)
        # rows that repeat the id and text that stay differ in nothing: they are counted out again
        again = classes.where("top_rows > 1").withColumn("nth", F.explode(F.expr("sequence(1L, top_rows)")))
        again = again.withColumn("doc_id", F.col("keep_id")).withColumn("kept", F.col("nth") == 1)
        found += [single.select(*out), again.select(*out)]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def drop_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = None
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[doc_id].cast("long").alias("doc_id"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", digest(F.col("text")))
    for by, _, classes in _groups(docs, doc_id, text, salts, digest):
        winners = classes.select(*[F.col(c).alias(f"w_{c}") for c in by], "keep_id", "top_rows")
        same = [F.col(c) == F.col(f"w_{c}") for c in by] + [F.col("doc_id").eqNullSafe(F.col("keep_id"))]
        rows = keyed.join(winners.drop("top_rows"), same, "left_semi")
        if not winners.where("top_rows > 1").isEmpty():
            rows = rows.dropDuplicates([*by, "doc_id"])
        kept = rows.select("row") if kept is None else kept.union(rows.select("row"))
    return kept.select("row.*")
