"""Streams give what a batch gives."""

import os

from pyspark.sql import functions as F

from palimpsest.operators import versions
from palimpsest.sources import listing
from palimpsest.streaming import captures as stream
from palimpsest.streaming import progress

HEADER = '[["timestamp","digest","mimetype","statuscode","original"],'


def drop(folder, name, rows):
    lines = [HEADER] + [f'["{t}","D","m","{s}","{u}"],' for t, s, u in rows]
    with open(os.path.join(folder, name), "w") as out:
        out.write("\n".join(lines))


def test_files_as_they_arrive(spark, folder):
    source, landed, log = (f"{folder}/{n}" for n in ("in", "landed", "log"))
    os.makedirs(source)
    batches = [
        [("20240105", "200", "http://a.com/x"), ("20240105", "404", "http://a.com/x"), ("20240101", "200", "http://b.com/")],
        # late data: older than the winner, then a tie that must not win
        [("20240101", "200", "http://a.com/x"), ("20240105", "301", "http://www.a.com/x")],
        [("20240109", "302", "http://b.com/"), ("20240105", "404", "http://a.com/x")],
    ]
    for i, rows in enumerate(batches):
        drop(source, f"{i}.cdx", rows)
        stream.land_lines(spark, source, landed, f"{folder}/c1").awaitTermination()
        lines = stream.read_landed(spark, landed)
        winners = stream.keep_versions_stream(stream.stream_captures(lines), "last")
        stream.append_changes(winners, log, f"{folder}/c2").awaitTermination()
        got = {r.url_key: (r.timestamp, r.statuscode, r.url_origin) for r in stream.current(spark, log).collect()}
        batch = listing.to_captures(listing.parse_listing(listing.scan_listing(spark, source)))
        want = {r.url_key: (r.timestamp, r.statuscode, r.url_origin) for r in versions.keep_last(batch).collect()}
        assert got == want, i
    assert got["a.com/x"] == ("20240105", "200", "http://a.com/x")


def test_first_versions_and_duplicates(spark, folder):
    source, landed = f"{folder}/in", f"{folder}/landed"
    os.makedirs(source)
    drop(source, "0.cdx", [("20240105", "200", "http://a.com/x"), ("20240105", "404", "http://a.com/x"), ("20240103", "200", "http://a.com/x")])
    stream.land_lines(spark, source, landed, f"{folder}/c1").awaitTermination()

    def table(df, name):
        query = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    rows = stream.stream_captures(stream.read_landed(spark, landed))
    first = table(stream.keep_versions_stream(rows, "first"), "first_versions")
    assert [(r.url_key, r.timestamp) for r in first] == [("a.com/x", "20240103")]
    distinct = table(stream.dedup_stream(rows), "distinct_rows")
    assert sorted((r.timestamp, r.statuscode) for r in distinct) == [("20240103", "200"), ("20240105", "200")]


def test_a_failing_callback_does_no_harm(spark, folder):
    source, landed = f"{folder}/in", f"{folder}/landed"
    os.makedirs(source)
    drop(source, "0.cdx", [("20240105", "404", "http://a.com/x"), ("20240105", "200", "http://a.com/y")])
    stream.land_lines(spark, source, landed, f"{folder}/c1").awaitTermination()
    seen = []

    def callback(status):
        seen.append(status)
        raise RuntimeError("no")

    rows = stream.stream_captures(stream.read_landed(spark, landed))
    query = progress.stream_progress(rows, callback, f"{folder}/c2", availableNow=True)
    query.awaitTermination()
    assert query.exception() is None
    assert seen[-1] == {"task": "download", "current": 1, "total": 2, "progress": "50%"}


def test_status_of_a_stored_table(spark, folder):
    spark.createDataFrame([("404",), (None,)], "response string").withColumn("file", F.lit("")).write.parquet(folder + "/t")
    assert progress.table_status(spark, folder + "/t", "done").first().asDict() == {
        "task": "done", "current": 1, "total": 2, "progress": "50%",
    }
