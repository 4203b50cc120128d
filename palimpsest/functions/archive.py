"""Columns around archive addresses, responses and redirects."""

from __future__ import annotations

from http import HTTPStatus
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.schema import PRESET_CODES

# Shape of an archive address, ``<base><timestamp>id_/<origin>``.
ARCHIVE_BASE = "https://web.archive.org/web/"
ARCHIVE_MARK = "id_/"
# Fixed value: pattern of a full listing timestamp.
TIMESTAMP_PATTERN = "yyyyMMddHHmmss"


def archive_url(timestamp: Column, origin: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_BASE), timestamp, F.lit(ARCHIVE_MARK), origin)


def url_from_archive(url: Column) -> Column:
    """Captured address inside an archive address; NULL where there is none."""
    return F.when(
        url.contains(ARCHIVE_MARK), F.split_part(url, F.lit(ARCHIVE_MARK), F.lit(2))
    )


def archive_timestamp(url: Column) -> Column:
    """Timestamp of an archive address, ``''`` where it has none."""
    after = F.split_part(url, F.lit("web/"), F.lit(2))
    return F.split_part(F.split_part(after, F.lit("/"), F.lit(1)), F.lit("id_"), F.lit(1))


def capture_time(timestamp: Column) -> Column:
    """Listing timestamp as a real one; NULL for shorter prefixes."""
    return F.try_to_timestamp(timestamp, F.lit(TIMESTAMP_PATTERN))


def preset_response(statuscode: Column) -> Column:
    """Listed codes that close a capture at once; everything else is still open."""
    return F.when(statuscode.isin(PRESET_CODES), statuscode)


def status_phrase(status: Column) -> Column:
    """Reason phrase of a status code.

    The public table of codes is fixed and short, so it travels as a literal map
    instead of a join. Missing or zero status reads ``No Status``, unknown codes NULL.
    """
    table = F.create_map(
        *[F.lit(v) for v in chain.from_iterable((s.value, s.phrase) for s in HTTPStatus)]
    )
    code = status.cast("int")
    return F.when(F.coalesce(code, F.lit(0)) == 0, F.lit("No Status")).otherwise(
        F.try_element_at(table, code)
    )


def encode_url(url: Column) -> Column:
    """Percent-encode for a request, leaving ``:`` and ``/``; ``%`` is encoded again."""
    out = F.url_encode(url)
    # form encoding differs from path encoding in these
    for form, plain in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%2F", "/")]:
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def _no_empties(path: Column) -> Column:
    """One slash where several follow each other, except at the end."""
    return F.regexp_replace(path, r"/{2,}", "/")


def _dotless(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a rooted path; steps above the root are dropped."""
    segments = F.split(path, "/", -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    # a path that ends in a step keeps its closing slash
    ended = F.when(path.rlike(r"/\.{1,2}\z"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.regexp_replace(F.array_join(ended, "/"), r"\A/?", "/")


def resolve_url(base: Column, location: Column) -> Column:
    """A ``Location`` value as an absolute address, by the rules for references.

    ``base`` must be absolute. A relative path is merged with the base's folder, where
    repeated slashes collapse, as they do in common URL libraries.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_page = F.regexp_extract(base, r"^([^#]*)", 1)
    base_bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    base_path = F.substr(base_bare, F.length(root) + 1)
    path = F.regexp_extract(location, r"^([^?#]*)", 1)
    tail = F.substr(location, F.length(path) + 1)
    beside = F.concat(F.lit("/"), F.regexp_replace(base_path, r"[^/]*\z", ""), path)
    rooted = F.when(path.startswith("/"), path).otherwise(_no_empties(beside))
    return (
        F.when(location.isNull(), F.lit(None))
        .when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme, F.lit(":"), location))
        .when(location == "", base)
        .when(location.startswith("?"), F.concat(base_bare, location))
        .when(location.startswith("#"), F.concat(base_page, location))
        .otherwise(F.concat(root, _dotless(rooted), tail))
    )
