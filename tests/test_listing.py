"""Reading listings: verdicts, headers, splits, several files."""

import os

from pyspark.sql import functions as F

from palimpsest.operators import filters, report, versions
from palimpsest.plans.job import CaptureJob
from palimpsest.sources import listing, results

HEADER = '[["timestamp","digest","mimetype","statuscode","original"],'


def write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines))
    return path


def verdicts(spark, lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_no long, value string")
    df = df.select("line_no", listing.clean_line(F.col("value")).alias("line"))
    return [r.verdict for r in listing.parse_listing(df).orderBy("line_no").collect()]


def test_verdicts(spark):
    cases = {
        '["2024","D","text/html","200","http://a.com/"],': "ok",
        '  ["2024","D","text/html","200","http://a.com/"]]\r': "ok",
        ' ["2024","D","text/html","200","http://a.com/"], ': "ok",
        '["2024","D",null,null,"http://a.com/"]': "ok",
        '["2024","D","m","200","http://a.com/","more"]': "ok",
        '["2024","D","m","200","http://a.com/\\u00e9\\"q\\""],': "ok",
        '["2024","D","m","200","MailTo:x@y.z"],': "mailto",
        '["2024","D","m","200","http://a.com/': "faulty",
        "": "faulty",
        "[]": "faulty",
        "null": "faulty",
        "5": "faulty",
        '{"a":1}': "faulty",
        "['2024','D','m','200','http://a.com/']": "faulty",
        '["a"] x': "faulty",
        '["2024","D","m","200","http://a.com/"]],': "faulty",
        '["2024","D","m","200","http://a.com/\\x"]': "faulty",
        '["2024","D","m","200"],': "malformed",
        '["2024","D","m","200",null],': "malformed",
        '[null,"D","m","200","http://a.com/"],': "malformed",
    }
    assert dict(zip(cases, verdicts(spark, cases))) == cases


def test_very_long_line(spark):
    long = "x" * 300_000
    assert verdicts(spark, [f'["2024","D","m","200","http://a.com/{long}"],']) == ["ok"]


def test_fields_and_captures(spark):
    line = '["20240102030405","DIG","text/html","404","http://www.a.com/x"]'
    df = spark.createDataFrame([(7, line)], "line_no long, line string")
    [row] = listing.to_captures(listing.parse_listing(df)).collect()
    assert row.scid == 7 and row.digest == "DIG" and row.mimetype == "text/html"
    assert row.url_archive == "https://web.archive.org/web/20240102030405id_/http://www.a.com/x"
    assert row.url_key == "a.com/x" and row.response == "404" and row.domain == "a.com"


def test_scan_keeps_the_order_of_one_split_file(spark, folder, conf):
    conf(files_maxPartitionBytes="2000")
    lines = [HEADER] + [f'["2024","D","m","200","http://a.com/{i}"],' for i in range(2000)]
    lines[-1] = lines[-1][:-1] + "]"
    path = write(folder, "one.cdx", lines)
    scanned = listing.scan_listing(spark, path)
    assert scanned.columns == ["src_file", "line_no", "line"]
    assert scanned.rdd.getNumPartitions() > 4
    parsed = listing.parse_listing(scanned).orderBy("line_no").collect()
    assert [r.url_origin for r in parsed] == [f"http://a.com/{i}" for i in range(2000)]
    assert {r.verdict for r in parsed} == {"ok"}
    assert listing.count_rows(scanned).first().listing_rows == 2000


def test_several_files_follow_each_other_by_name(spark, folder):
    def row(code):
        return f'["2024","D","m","{code}","http://a.com/"],'

    # the longer file comes later by name, though Spark plans it first
    write(folder, "a.cdx", [HEADER, row(404)])
    write(folder, "b.cdx", [HEADER] + [row(200)] * 500)
    captures = listing.to_captures(listing.parse_listing(listing.scan_listing(spark, folder)))
    assert [r.statuscode for r in versions.dedup_first(captures).collect()] == ["404"]
    assert [r.statuscode for r in versions.keep_last(captures).collect()] == ["404"]
    lines = listing.parse_listing(listing.scan_listing(spark, folder))
    for mode in versions.MODES:
        funnel = report.capture_funnel(lines.withColumn("url_key", F.lit("k")), mode).first()
        assert (funnel.total, funnel.duplicates, funnel.kept, funnel.skip_statuscode) == (501, 500, 1, 1)
    numbered = versions.enumerate_captures(captures).orderBy("counter").collect()
    assert [r.counter for r in numbered] == list(range(1, 502))
    assert numbered[0].statuscode == "404"


def test_header_problems(spark, folder):
    write(folder, "good.cdx", [HEADER, '["2024","D","m","200","http://a.com/"]]'])
    write(folder, "none.cdx", ['["2024","D","m","200","http://a.com/"]]'])
    write(folder, "two.cdx", [HEADER, HEADER])
    bad = {os.path.basename(r.src_file): r.headers for r in listing.header_problems(spark, folder).collect()}
    assert bad == {"none.cdx": 0, "two.cdx": 2}


def test_results_round_trip(spark, folder):
    rows = [
        ("2024", 'http://x/,"q"', "http://o/\nline", None, None, "200", "f,1"),
        ("2025", "http://y/", "http://p/", "http://r/", "2023", "404", None),
        ("2026", "http://z/", "http://q/", None, None, None, None),
    ]
    schema = "timestamp string, url_archive string, url_origin string, redirect_url string, redirect_timestamp string, response string, file string"
    results.write_results(spark.createDataFrame(rows, schema), f"{folder}/r")
    back = results.scan_results(spark, f"{folder}/r").drop("src_file", "csv_line").orderBy("timestamp")
    assert [tuple(r) for r in back.collect()] == rows[:2]


def test_results_are_split_unless_a_value_has_a_line_break(spark, folder, conf):
    schema = "timestamp string, url_archive string, url_origin string, redirect_url string, redirect_timestamp string, response string, file string"
    rows = [(f"{i:014d}", f'http://x/{i},"q"', f"http://o/{i}", None, None, "200", "") for i in range(3_000)]
    results.write_results(spark.createDataFrame(rows, schema).coalesce(1), f"{folder}/r")
    conf(files_maxPartitionBytes="32k", files_openCostInBytes="1k")
    assert not results.has_line_breaks(spark, f"{folder}/r")
    back = results.scan_results(spark, f"{folder}/r")
    assert back.rdd.getNumPartitions() > 4
    assert [r.timestamp for r in back.orderBy("csv_line").collect()] == [r[0] for r in rows]
    results.write_results(spark.createDataFrame([("1", "http://x/\ny", "http://o/", None, None, "200", "")], schema), f"{folder}/s")
    assert results.has_line_breaks(spark, f"{folder}/s")
    assert results.scan_results(spark, f"{folder}/s").first().url_archive == "http://x/\ny"


def parsed_of(spark, origins):
    rows = [(i, f"202401{i:02d}000000", "200", u, "ok") for i, u in enumerate(origins, 1)]
    return spark.createDataFrame(rows, "line_no long, timestamp string, statuscode string, url_origin string, verdict string")


def test_filter_url(spark):
    origins = [
        "http://example.com", "https://www.Example.com:80/", "http://example.com./a", "http://example.com/a/",
        "http://example.com/ab", "http://example.com/a/b?c=http://x.y/", "http://sub.example.com/a", "http://u@example.com/a",
    ]
    df = parsed_of(spark, origins)

    def lines(url, explicit):
        return [r.line_no for r in filters.filter_url(df, url, explicit).orderBy("line_no").collect()]

    assert lines("example.com", False) == [1, 2, 3, 4, 5, 6, 8]
    assert lines("https://www.example.com/", True) == [1, 2]
    assert lines("example.com/a", True) == [3, 4, 8]
    assert lines("example.com/a", False) == [3, 4, 6, 8]


def test_other_filters(spark):
    df = parsed_of(spark, ["http://a.com/x.jpg", "http://a.com/x.JPG", "http://a.com/xjpg", "http://a.com/x.jpg?y", "http://a.com/x.css"])

    def lines(out):
        return [r.line_no for r in out.orderBy("line_no").collect()]

    assert lines(filters.filter_filetype(df, ["jpg", " CSS"])) == [1, 5]
    assert lines(filters.filter_filetype(df, ["jpg"], ignore_case=True)) == [1, 2]
    assert lines(filters.filter_time(df, "20240102", "20240103")) == [2, 3]
    assert lines(filters.filter_time(df, None, "202401")) == [1, 2, 3, 4, 5]
    assert lines(filters.limit_captures(df, 2)) == [1, 2]


def test_job_selection_keeps_unread_lines(spark):
    df = parsed_of(spark, ["http://a.com/x.jpg", "http://b.com/"]).unionByName(
        spark.createDataFrame([(9, None, None, None, "faulty")], "line_no long, timestamp string, statuscode string, url_origin string, verdict string")
    )
    job = CaptureJob(url="a.com", filetype=("jpg",), statuscode=("200",), start="2024", end="2024")
    assert [r.line_no for r in job.selected(df).orderBy("line_no").collect()] == [1, 9]
    assert [r.line_no for r in CaptureJob(limit=1).selected(df).collect()] == [1]
