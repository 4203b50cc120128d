"""Capture listings: line-oriented JSON text with one array per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import archive, urls
from palimpsest.schema import LISTING_FIELDS

# A flat JSON array of strings and nulls, anchored at both ends. The JSON reader accepts
# text after the closing bracket, so the shape is tested first. Possessive quantifiers
# keep long addresses from deepening the stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ITEM = rf"(?:{_STRING}|null)"
FLAT_ARRAY = rf"(?s)\A\[\s*+{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+\]\z"

# Characters that count as blank at the ends of a line.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

HEADER_MARK = "[["

# Of stored captures: small enough that one site is a few row groups, large enough to read in one go.
ROW_GROUP_BYTES = 32 * 1024 * 1024


def clean_line(text: Column) -> Column:
    """Strip blanks, the bracket that closes the whole listing or one trailing comma."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(
        bare.endswith("]]") | bare.endswith(","), F.left(bare, F.length(bare) - 1)
    ).otherwise(bare)


def _text(spark: SparkSession, path: str | list[str], files: DataFrame | None) -> DataFrame:
    """``src_file, value`` of all files; given a table of files, of all that were changed around the same time."""
    reader = spark.read
    if files is not None:
        hours = F.expr("INTERVAL 2 HOURS")
        shape = "yyyy-MM-dd'T'HH:mm:ss"
        first, last = (F.min("modified") - hours, F.max("modified") + hours)
        between = files.agg(F.date_format(first, shape).alias("first"), F.date_format(last, shape).alias("last")).first()
        if between["first"] is not None:
            reader = reader.option("modifiedAfter", between["first"]).option("modifiedBefore", between["last"])
    return reader.text(path).select(F.col("_metadata.file_path").alias("src_file"), "value")


def scan_listing(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """Lines of one or many listings as ``(src_file, line_no, line)``, headers dropped.

    ``line_no`` rises with the position inside a file, because Spark numbers rows by
    partition and plans the splits of a file in offset order. Files follow each other by
    name. Large files are split and read in parallel. ``files``, a stored table with ``src_file``
    and ``modified``, leaves out all others.
    """
    numbered = _text(spark, path, files).select("src_file", F.monotonically_increasing_id().alias("line_no"), "value")
    if files is not None:
        numbered = numbered.join(files.select("src_file"), "src_file", "left_semi")
    return (
        numbered.where(~is_header(F.col("value")))
        .withColumn("line", clean_line(F.col("value")))
        .drop("value")
    )


def listing_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Names, sizes and times of a listing's files; nothing of their content is read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("_metadata.file_path").alias("src_file"), "length", F.col("modificationTime").alias("modified"))


def is_header(text: Column) -> Column:
    """The header opens the listing, so it alone starts with two brackets."""
    return F.ltrim(text).startswith(HEADER_MARK)


def header_problems(spark: SparkSession, path: str | list[str], files: DataFrame | None = None) -> DataFrame:
    """Files that do not hold exactly one header line."""
    raw = _text(spark, path, files)
    if files is not None:
        raw = raw.join(files.select("src_file"), "src_file", "left_semi")
    return (
        raw.groupBy("src_file")
        .agg(F.count_if(is_header(F.col("value"))).alias("headers"))
        .where("headers <> 1")
    )


def count_rows(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("listing_rows"))


def parse_listing(lines: DataFrame) -> DataFrame:
    """Split lines into fields and give each a verdict; no line is lost.

    ``verdict`` is ``ok``, ``mailto`` (not a resource that can be fetched), ``faulty``
    (not readable as a flat array) or ``malformed`` (too short, or without timestamp or
    address).
    """
    fields = F.from_json(
        F.regexp_extract("line", FLAT_ARRAY, 0), "array<string>", {"allowSingleQuotes": "false"}
    )
    named = {
        name if name != "original" else "url_origin": F.get(F.col("__fields"), F.lit(i))
        for i, name in enumerate(LISTING_FIELDS)
    }
    short = F.size("__fields") < len(LISTING_FIELDS)
    verdict = (
        F.when(F.col("__fields").isNull(), "faulty")
        .when(short | F.col("timestamp").isNull() | F.col("url_origin").isNull(), "malformed")
        .when(is_mailto(F.col("url_origin")), "mailto")
        .otherwise("ok")
    )
    rest = [c for c in lines.columns if c != "line"]
    # exploding an array of one keeps later filters from repeating the JSON parse
    return (
        lines.withColumn("__fields", F.explode(F.array(fields)))
        .withColumns(named)
        .withColumn("verdict", verdict)
        .select(*rest, "line", *named, "verdict")
    )


def is_mailto(origin: Column) -> Column:
    return F.lower(origin).startswith("mailto")


def drop_mailto(df: DataFrame) -> DataFrame:
    return df.where(~is_mailto(F.col("url_origin")))


def drop_faulty(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("verdict").isin("faulty", "malformed"))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that could not be read, with their reason."""
    return parsed.where(F.col("verdict").isin("faulty", "malformed")).select(
        *[c for c in ("src_file", "line_no") if c in parsed.columns], "line", "verdict"
    )


def to_captures(parsed: DataFrame, merge_www: bool = True, embedded: str = "cut") -> DataFrame:
    """Readable lines as captures: archive address, file key and preset response."""
    ok = parsed.where(F.col("verdict") == "ok").drop("line", "verdict")
    keyed = ok
    if not {"domain", "url_key"} <= set(ok.columns):
        keyed = urls.with_url_parts(
            ok, "url_origin", merge_www, embedded, keep=("domain", "url_key")
        )
    return keyed.withColumns(
        {
            "scid": F.col("line_no"),
            "url_archive": archive.archive_url(F.col("timestamp"), F.col("url_origin")),
            "response": archive.preset_response(F.col("statuscode")),
        }
    )


def land_captures(captures: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store captures as parquet, clustered by domain and key.

    Range partitioning spreads a domain that holds much of the data over many tasks and
    files, and the clustering lets filters on domain, key and time skip row groups by
    their statistics. Addresses and digests are in no such order; for them a Bloom filter per
    row group tells which ones cannot hold a value.
    """
    writer = (
        captures.repartitionByRange("domain", "url_key", "timestamp")
        .sortWithinPartitions("domain", "url_key", "timestamp")
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
    )
    for name in ("url_origin", "url_archive", "digest"):
        if name in captures.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)
