"""Columns for names and places of stored files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.schema import NAME_SPECIALS, URL_SPECIALS

# Fixed value: longest full path some file systems take.
PATH_LIMIT = 255


def sanitize_name(name: Column) -> Column:
    """An address as one file name: special characters to dots, no empty dot parts."""
    dotted = F.translate(name, "".join(NAME_SPECIALS), "." * len(NAME_SPECIALS))
    return F.btrim(F.regexp_replace(dotted, r"\.{2,}", "."), F.lit("."))


def sanitize_url(url: Column) -> Column:
    return urls.percent_encode(url, URL_SPECIALS)


def output_path(key: Column, timestamp: Column | None = None) -> Column:
    """Path of a key below the output root; ``timestamp`` adds a level after the domain."""
    safe = urls.contain_traversal(key)
    if timestamp is not None:
        domain = F.split_part(safe, F.lit("/"), F.lit(1))
        safe = F.concat_ws("/", domain, timestamp, F.regexp_replace(safe, r"^[^/]*/?", ""))
    return F.rtrim(F.regexp_replace(safe, "/{2,}", "/"), F.lit("/"))


def has_extension(path: Column) -> Column:
    return path.rlike(r"[^./][^/]*\.[^./]*\z")


def add_html_ext(path: Column, html: Column) -> Column:
    """Give an extensionless file that holds HTML an ``.html`` ending."""
    return F.when(html & ~has_extension(path), F.concat(path, F.lit(".html"))).otherwise(path)


def path_too_long(path: Column, limit: int = PATH_LIMIT) -> Column:
    return F.length(path) > limit


# Usual limits of a path segment and a path, in bytes.
SEGMENT_BYTES, PATH_BYTES = 255, 4096


def valid_link_path(path: Column, segment: int = SEGMENT_BYTES, whole: int = PATH_BYTES) -> Column:
    """Whether a path can exist: no segment beyond ``segment`` bytes, ``whole`` in all."""
    # a segment's bytes are at least its characters, so only long ones are measured
    longest = F.array_max(F.transform(F.split(path, "/", -1), F.octet_length))
    return (
        (path != "")
        & (F.octet_length(path) <= whole)
        & ((F.octet_length(path) <= segment) | (longest <= segment))
    )
