"""Columns that turn a captured address into the file it becomes.

Every function takes and returns a column. :func:`with_url_parts` computes the same
values one projection after the other, so that each intermediate string is made once
per row; use it wherever more than one part is needed.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schema import PATH_SPECIALS

# Fixed value: file name of an address that ends in a folder.
DEFAULT_FILE = "index.html"


def percent_encode(text: Column, specials: Iterable[str]) -> Column:
    """Write each of ``specials`` as ``%`` and two lower-case hex digits."""
    return reduce(
        lambda acc, ch: F.replace(acc, F.lit(ch), F.lit(f"%{ord(ch):02x}")), specials, text
    )


def strip_scheme(url: Column, embedded: str = "cut") -> Column:
    """Drop ``scheme://``.

    ``embedded='cut'`` also ends the address at a second ``://`` inside it;
    ``embedded='keep'`` leaves an address carried in the query intact.
    """
    # each step looks at the address once, so predicates pushed below stay small
    if embedded == "cut":
        return F.substring_index(F.substring_index(url, "://", 2), "://", -1)
    if embedded == "keep":
        return F.regexp_replace(url, r"(?s)\A.*?://", "")
    raise ValueError(f"embedded must be 'cut' or 'keep', not {embedded!r}")


def _host(bare: Column) -> Column:
    """Between the last ``@`` and the first ``:`` of what stands before the first slash."""
    authority = F.substring_index(bare, "/", 1)
    return F.substring_index(F.substring_index(authority, "@", -1), ":", 1)


def _path(bare: Column) -> Column:
    return F.regexp_replace(bare, r"\A[^/]*", "")


def contain_traversal(path: Column) -> Column:
    """Encode path segments that are exactly ``.`` or ``..`` so they cannot climb."""
    # dots first and their surroundings after, so that most characters are passed quickly
    up = F.regexp_replace(path, r"\.\.(?![^/])(?<![^/]\.\.)", "%2e%2e")
    return F.regexp_replace(up, r"\.(?![^/])(?<![^/]\.)", "%2e")


def pct_encode_special(text: Column) -> Column:
    return percent_encode(text, PATH_SPECIALS)


def pct_space(text: Column) -> Column:
    return F.replace(text, F.lit("%20"), F.lit(" "))


def _safe_path(path: Column) -> Column:
    """Path with special characters and climbing segments encoded, segment by segment.

    No character of a segment depends on another segment, so folders and file name are
    cut from the encoded path.
    """
    return _contained(pct_encode_special(path))


def _contained(encoded: Column) -> Column:
    """A path starts with a slash or is empty: without a dot after a slash nothing climbs."""
    return F.when(encoded.contains("/."), contain_traversal(encoded)).otherwise(encoded)


def _folders(path: Column) -> Column:
    """Up to the last slash, slashes at the ends removed."""
    return F.btrim(F.regexp_extract(path, r"(?s)\A(.*/)", 1), F.lit("/"))


def _file(path: Column) -> Column:
    return pct_space(F.substring_index(path, "/", -1))


def _folder_of_host(host: Column, merge_www: bool) -> Column:
    clean = F.rtrim(F.lower(host), F.lit("."))
    # only when a dot remains, so that www.com keeps its name
    return F.regexp_replace(clean, r"^www\.(?=[\s\S]*\.)", "") if merge_www else clean


def _or_default(name: Column) -> Column:
    return F.regexp_replace(name, r"^\z", DEFAULT_FILE)


def _join_key(domain: Column, subdir: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.nullif(domain, F.lit("")), F.nullif(subdir, F.lit("")), filename)


def url_domain_raw(url: Column, embedded: str = "cut") -> Column:
    """Host as written: without user part and port."""
    return _host(strip_scheme(url, embedded))


def url_domain(url: Column, merge_www: bool = True, embedded: str = "cut") -> Column:
    """Host as a folder name: lower case, no trailing dots, ``www.`` merged."""
    return _folder_of_host(url_domain_raw(url, embedded), merge_www)


def url_subdir(url: Column, embedded: str = "cut") -> Column:
    return _folders(_safe_path(_path(strip_scheme(url, embedded))))


def url_filename_raw(url: Column, embedded: str = "cut") -> Column:
    """Last path segment, empty when the address ends in a folder."""
    return _file(_safe_path(_path(strip_scheme(url, embedded))))


def url_filename(url: Column, embedded: str = "cut") -> Column:
    return _or_default(url_filename_raw(url, embedded))


def url_key(url: Column, merge_www: bool = True, embedded: str = "cut") -> Column:
    """Identity of the file an address maps to: ``domain/subdir/filename``."""
    return _join_key(
        url_domain(url, merge_www, embedded), url_subdir(url, embedded), url_filename(url, embedded)
    )


def with_url_parts(
    df: DataFrame,
    url: str = "url_origin",
    merge_www: bool = True,
    embedded: str = "cut",
    keep: Iterable[str] = ("url_key",),
) -> DataFrame:
    """Add parts of ``url`` as columns.

    ``keep`` names any of ``domain_raw``, ``domain``, ``subdir``, ``filename_raw``,
    ``filename``, ``url_key``; columns not asked for are pruned by the optimizer.
    """
    out = (
        df.withColumn("__bare", strip_scheme(F.col(url), embedded))
        .withColumns(
            {"__domain_raw": _host(F.col("__bare")), "__path": _safe_path(_path(F.col("__bare")))}
        )
        .withColumns(
            {
                "__domain": _folder_of_host(F.col("__domain_raw"), merge_www),
                "__subdir": _folders(F.col("__path")),
                "__filename_raw": _file(F.col("__path")),
            }
        )
        .withColumn("__filename", _or_default(F.col("__filename_raw")))
        .withColumn("__url_key", _join_key(F.col("__domain"), F.col("__subdir"), F.col("__filename")))
    )
    keep = list(keep)
    return out.select(
        *[F.col(c) for c in df.columns if c not in keep], *[F.col(f"__{k}").alias(k) for k in keep]
    )


def with_url_keys(df: DataFrame, ways: dict[str, tuple[bool, str]], url: str = "url_origin") -> DataFrame:
    """Add keys of ``url`` made in several ways: for each name ``merge_www`` and ``embedded``.

    Each is what :func:`url_key` gives; what they have in common is worked out once. The address that ``keep``
    leaves whole goes on where ``cut`` ends, so past a slash only its rest is encoded anew.
    """
    cut, keep = F.col("__cut"), F.col("__keep")
    rest = F.substring(keep, F.length(cut) + 1, F.length(keep))
    path = F.col("__cut_path")
    whole = (
        F.when(keep == cut, path)
        .when(cut.contains("/"), F.concat(path, pct_encode_special(rest)))
        .otherwise(pct_encode_special(_path(keep)))
    )
    kinds = ("cut", "keep")
    out = (
        df.withColumns({f"__{k}": strip_scheme(F.col(url), k) for k in kinds})
        .withColumn("__cut_path", pct_encode_special(_path(cut)))
        .withColumn("__keep_path", whole)
        .withColumns({f"__{k}_path": _contained(F.col(f"__{k}_path")) for k in kinds})
        .withColumns({f"__{k}_folders": _folders(F.col(f"__{k}_path")) for k in kinds})
        .withColumns({f"__{k}_file": _or_default(_file(F.col(f"__{k}_path"))) for k in kinds})
    )
    keys = {
        name: _join_key(_folder_of_host(_host(F.col(f"__{k}")), merge_www), F.col(f"__{k}_folders"), F.col(f"__{k}_file"))
        for name, (merge_www, k) in ways.items()
    }
    return out.select(*[F.col(c) for c in df.columns if c not in keys], *[c.alias(n) for n, c in keys.items()])
