"""Earlier runs laid over the captures of this one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage
from palimpsest.sources.buckets import BucketTable

IDENTITY = ["timestamp", "url_origin", "url_archive"]
# columns a result row overwrites
CARRIED = ["url_archive", "redirect_url", "redirect_timestamp", "response", "file"]


def anti_existing(new: DataFrame, existing: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """Rows of ``new`` that ``existing`` does not hold yet, by the columns that make a capture.

    Both sides come down to one row per identity first (for ``new`` the caller's
    ``dedup_first``, here a partial aggregation for ``existing``), so no key is hot.
    """
    return new.join(existing.select(*identity).distinct(), identity, "left_anti")


def append_new(new: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.unionByName(anti_existing(new, existing), allowMissingColumns=True)


def last_results(results: DataFrame) -> DataFrame:
    """Last result row per capture; result files follow each other by name."""
    order = [F.desc(c) for c in ("src_file", "csv_line") if c in results.columns]
    rank = F.row_number().over(W.partitionBy("timestamp", "url_origin").orderBy(*order))
    return results.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def overlay_results(captures: DataFrame, results: DataFrame) -> DataFrame:
    """Overwrite captures with the results of earlier runs; the last row wins.

    A matching row carries over all its values, NULLs included.
    """
    earlier = last_results(results).select(
        "timestamp",
        "url_origin",
        F.lit(True).alias("__hit"),
        *[F.col(c).alias(f"__{c}") for c in CARRIED],
    )
    for name in CARRIED:
        if name not in captures.columns:
            captures = captures.withColumn(name, F.lit(None).cast("string"))
    joined = captures.join(earlier, ["timestamp", "url_origin"], "left")
    carried = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in CARRIED}
    return joined.withColumns(carried).select(*captures.columns)


def overlay_update(table: BucketTable, results: DataFrame, number: int) -> list[int]:
    """Lay results over a stored table in place; the numbers of the buckets that are written anew.

    ``table`` is bucketed by timestamp and address and has the columns that a result carries over. Only
    buckets that results fall into are read, and only those in which a value changes are written. An
    update that died is made again by calling with its ``number``; each update has its own.
    """
    if table.is_prepared(number):
        table.replay(number)
        return []
    order = [c for c in ("src_file", "csv_line") if c in results.columns]
    latest = cut_lineage(last_results(results).select(*order, "timestamp", "url_origin", *CARRIED), "latest-results")
    stored = table.read(table.touched(latest)).withColumn("__before", F.struct(*CARRIED))
    differs = ~F.struct(*CARRIED).eqNullSafe(F.col("__before"))
    merged = overlay_results(stored, latest).withColumn("__differs", differs).drop("__before")
    # stored, so that rows and results meet once
    merged = cut_lineage(merged, "overlaid")
    changed = sorted(r.bucket for r in merged.where("__differs").select("bucket").distinct().collect())
    if changed:
        table.prepare(number, merged.where(F.col("bucket").isin(changed)))
        table.replay(number)
    return changed


def overlay_counts(captures: DataFrame, results: DataFrame) -> DataFrame:
    """How many result rows there were, and how many captures they closed."""
    rows = results.agg(F.count("*").alias("csv_rows"))
    keys = captures.select("timestamp", "url_origin")
    hits = last_results(results).join(keys, ["timestamp", "url_origin"], "left_semi")
    matched = hits.agg(F.count("*").alias("n"))
    return rows.withColumn("matched_rows", matched.scalar())


def apply_outcomes(captures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write outcomes back by ``scid``; an outcome without a value changes nothing."""
    names = [c for c in ("response", "redirect_url", "redirect_timestamp", "file") if c in outcomes.columns]
    news = outcomes.select("scid", *[F.col(c).alias(f"__{c}") for c in names])
    base = captures
    for name in names:
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    merged = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in names}
    return base.join(news, "scid", "left").withColumns(merged).select(*base.columns)
