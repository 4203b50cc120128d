"""Row filters over captures.

Those on stored columns are plain comparisons and reach a parquet scan as pushed
filters.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.schema import PRESET_CODES

# Fixed value: digits of a full listing timestamp.
TIMESTAMP_DIGITS = 14


def in_time(start: str | None = None, end: str | None = None) -> Column:
    """From ``start`` to ``end``, both included; prefixes such as ``2019`` work."""
    cond = F.lit(True)
    if start:
        cond = cond & (F.col("timestamp") >= str(start))
    if end:
        cond = cond & (F.col("timestamp") <= str(end).ljust(TIMESTAMP_DIGITS, "9"))
    return cond


def has_statuscode(codes: list[str]) -> Column:
    return F.col("statuscode").isin([c.strip().lower() for c in codes])


def has_filetype(types: list[str], ignore_case: bool = False) -> Column:
    endings = "|".join(re.escape(t.strip().lower()) for t in types)
    flags = "(?i)" if ignore_case else ""
    return F.col("url_origin").rlike(rf"{flags}\.({endings})\z")


def filter_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return df.where(in_time(start, end))


def range_start(years: int, as_of: date | None = None) -> str:
    return str((as_of or date.today()).year - years)


def filter_range(df: DataFrame, years: int, as_of: date | None = None) -> DataFrame:
    """Captures since the year ``years`` before ``as_of``, today by default."""
    return df.where(in_time(start=range_start(years, as_of)))


def filter_statuscode(df: DataFrame, codes: list[str]) -> DataFrame:
    return df.where(has_statuscode(codes))


def filter_filetype(df: DataFrame, types: list[str], ignore_case: bool = False) -> DataFrame:
    """Captures whose address ends in one of the given file endings."""
    return df.where(has_filetype(types, ignore_case))


def canonical_address(url: Column) -> Column:
    """Address with its host variants merged, without scheme and closing slash."""
    bare = urls.strip_scheme(url, embedded="keep")
    path = F.when(bare.contains("/"), F.substr(bare, F.instr(bare, "/"))).otherwise(F.lit(""))
    return F.concat(urls.url_domain(url, embedded="keep"), F.rtrim(path, F.lit("/")))


def at_address(url: str, explicit: bool = False, domain: Column | None = None, merged: bool = True) -> Column:
    """At one address, or at it and everything below when not ``explicit``.

    Host variants are one site here, as in an index, whatever the file keys do with them. The
    domain test comes on its own: given a stored ``domain`` it prunes the scan. ``merged`` says
    whether host variants share that domain.
    """
    wanted = canonical_address(F.lit(url))
    here = canonical_address(F.col("url_origin"))
    below = F.lit(False) if explicit else here.startswith(F.concat(wanted, F.lit("/")))
    host = urls.url_domain(F.lit(url))
    stored = urls.url_domain(F.col("url_origin")) if domain is None else domain
    same = stored == host if merged else stored.isin(host, F.concat(F.lit("www."), host))
    return same & ((here == wanted) | below)


def filter_url(df: DataFrame, url: str, explicit: bool = False) -> DataFrame:
    domain = F.col("domain") if "domain" in df.columns else None
    return df.where(at_address(url, explicit, domain))


def limit_captures(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of the listing, its files by name."""
    return df.orderBy(*[c for c in ("src_file", "line_no") if c in df.columns]).limit(n)


def handled(df: DataFrame) -> DataFrame:
    return df.where(F.col("response").isNotNull())


def unhandled(df: DataFrame) -> DataFrame:
    return df.where(F.col("response").isNull())


def has_file() -> Column:
    return F.coalesce(F.col("file"), F.lit("")) != ""


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(has_file())


def failed(df: DataFrame) -> DataFrame:
    return df.where(~has_file())


def skip_statuscode(df: DataFrame) -> DataFrame:
    """Captures closed by their listed code alone."""
    return df.where(F.col("response").isin(PRESET_CODES))


def release_locked(df: DataFrame) -> DataFrame:
    """Reopen rows that another tool left marked as in work."""
    return df.withColumn("response", F.nullif(F.col("response"), F.lit("LOCK")))
