"""Archive addresses, references, encodings, bodies and reports on literal values."""

import gzip
from datetime import datetime
from urllib.parse import quote, urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import archive, content, report

BASES = [
    "https://web.archive.org/web/20240101000000id_/http://example.com/a/b/c?x=1#y",
    "https://web.archive.org/web/2024id_/https://example.com",
    "http://h.com",
    "http://h.com/a//b/",
]
REFERENCES = [
    "http://other.com/x", "//cdn.com/x/../y", "/root/./a/../b", "rel", "rel/../x", "../up", "../../../../../up",
    "./", ".", "..", "?q=1", "#f", "", "a/b?c=/../d#e", "/", "/..", "mailto:x@y.z", "x//y/", "/a//b",
]


def test_references_resolve_as_in_the_standard_library(spark):
    pairs = [(b, r, urljoin(b, r)) for b in BASES for r in REFERENCES]
    df = spark.createDataFrame(pairs, "base string, ref string, want string")
    got = df.withColumn("got", archive.resolve_url(F.col("base"), F.col("ref")))
    assert [tuple(r) for r in got.where("got <> want").collect()] == []


segment = st.sampled_from(["a", "b", ".", "..", "", "x.y", "é"])
reference = st.lists(segment, min_size=1, max_size=6).map("/".join).filter(lambda r: not r.startswith("//"))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(BASES), reference), min_size=30, max_size=60))
def test_any_path_reference(spark, pairs):
    rows = [(b, r, urljoin(b, r)) for b, r in pairs]
    df = spark.createDataFrame(rows, "base string, ref string, want string")
    got = df.withColumn("got", archive.resolve_url(F.col("base"), F.col("ref")))
    assert [tuple(r) for r in got.where("got <> want").collect()] == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=20), min_size=20, max_size=40))
def test_encoding_as_in_the_standard_library(spark, texts):
    df = spark.createDataFrame([(t, quote(t, safe=":/")) for t in texts], "t string, want string")
    got = df.withColumn("got", archive.encode_url(F.col("t")))
    assert [tuple(r) for r in got.where("got <> want").collect()] == []


def test_archive_addresses(spark):
    [row] = (
        spark.createDataFrame([("https://web.archive.org/web/20240101id_/http://a.com/id_/x", "http://a.com/")], "a string, b string")
        .select(
            archive.url_from_archive(F.col("a")).alias("origin"),
            archive.url_from_archive(F.col("b")).alias("none"),
            archive.archive_timestamp(F.col("a")).alias("stamp"),
            archive.archive_timestamp(F.col("b")).alias("nostamp"),
            archive.archive_url(F.lit("2024"), F.col("b")).alias("made"),
        )
        .collect()
    )
    assert row.origin == "http://a.com/" and row.none is None
    assert row.stamp == "20240101" and row.nostamp == ""
    assert row.made == "https://web.archive.org/web/2024id_/http://a.com/"


def test_capture_time_of_prefix_is_null(spark):
    rows = spark.createDataFrame([("20240102030405",), ("2024",)], "t string").select(archive.capture_time(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == [datetime(2024, 1, 2, 3, 4, 5), None]


def test_status_phrases(spark):
    rows = spark.createDataFrame([(200,), (404,), (0,), (None,), (599,)], "s int").select(archive.status_phrase(F.col("s")).alias("p")).collect()
    assert [r.p for r in rows] == ["OK", "Not Found", "No Status", "No Status", None]


def test_bodies(spark):
    page = b"  <!-- a --><!-- b\n -->\n<!DOCTYPE html><p>x"
    rows = [
        ("a", "gzip", gzip.compress(page)),
        ("b", "gzip", page),
        ("c", None, b"plain"),
        ("d", "gzip", gzip.compress(page)[:-9]),
        ("e", None, None),
        ("f", None, b" " * content.SNIFF_BYTES + b"<html>"),
        ("g", "gzip", None),
    ]
    df = spark.createDataFrame(rows, "k string, encoding string, body binary")
    got = {
        r.k: r
        for r in content.decode_payload(df).withColumn("html", content.is_html(F.col("body"))).collect()
    }
    assert got["a"].decode_ok and bytes(got["a"].body) == page and got["a"].html
    assert not got["b"].decode_ok and bytes(got["b"].body) == page
    assert got["c"].decode_ok and not got["c"].html
    assert not got["d"].decode_ok and not got["d"].html
    assert got["e"].body is None and not got["e"].html and got["e"].decode_ok
    assert not got["f"].html
    assert got["g"].body is None and got["g"].decode_ok


def test_progress(spark):
    pairs = [(0, 0, "0"), (1, 8, "12%"), (3, 8, "38%"), (1, 200, "0%"), (3, 200, "2%"), (7, 7, "100%")]
    df = spark.createDataFrame(pairs, "h long, t long, want string")
    got = df.select("want", report.progress_pct(F.col("h"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [p[2] for p in pairs]
    [text] = spark.range(1).select(report.progress_text(F.lit(1234567), F.lit(89)).alias("x")).collect()
    assert text.x == "1,234,567 / 89"


def test_save_answers(spark):
    at = datetime(2024, 1, 2, 12, 0, 0)

    def location(stamp):
        return f"https://web.archive.org/web/{stamp}id_/http://a.com/"

    rows = [
        (302, location("20240102115945"), at, "new", None),
        (302, location("20240102115000"), at, "existing", 50),
        (302, location("20240101120000"), at, "existing", 0),
        (429, None, at, "rate_limited", None),
        (520, None, at, "job_failed", None),
        (404, None, at, "not_found", None),
        (500, None, at, "unhandled", None),
    ]
    df = spark.createDataFrame(rows, "status int, location string, ts timestamp, want string, wait long")
    args = [F.col(c) for c in ("status", "location", "ts")]
    got = df.select("want", "wait", report.classify_save_response(*args).alias("g"), report.save_wait_minutes(*args).alias("w")).collect()
    assert [(r.g, r.w) for r in got] == [(r.want, r.wait) for r in got]


def test_bodies_of_one_batch_beyond_two_gigabytes(spark):
    import gzip

    packed = gzip.compress(b"x" * (1 << 20))
    rows = spark.range(2200).repartition(1).select(
        F.col("id").cast("string").alias("url_archive"), F.lit("gzip").alias("encoding"), F.lit(packed).alias("body")
    )
    sizes = content.decode_payload(rows).select(F.octet_length("body").alias("n"), "decode_ok")
    assert [tuple(r) for r in sizes.groupBy("n", "decode_ok").count().collect()] == [(1 << 20, True, 2200)]
