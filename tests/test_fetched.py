"""Payloads, redirects, conflicts and outcomes against brute force."""

import random
from urllib.parse import urljoin

from tests.conftest import captures_of
from pyspark.sql import functions as F

from palimpsest.functions import archive
from palimpsest.operators import fetched, links, overlay, versions
from palimpsest.plans.job import CaptureJob
from palimpsest.schema import PAYLOADS
from palimpsest.session import cut_lineage
from palimpsest.sources import payloads as payload_source

INDEX = "url_archive string, status int, location string, is_html boolean"


def address(i, host="http://h.com/"):
    return f"https://web.archive.org/web/{20240101000000 + i}id_/{host}{i}"


def test_attach_leaves_closed_captures_alone(spark):
    captures = captures_of(spark, [(1, "2024", "http://a/", "200"), (2, "2024", "http://b/", "404"), (3, "2024", "http://c/", "200")])
    index = spark.createDataFrame(
        [(f"https://web.archive.org/web/2024id_/http://{h}/", 200, None, True) for h in "ab"], INDEX
    )
    got = {r.scid: r.status for r in fetched.attach_payloads(captures, index).collect()}
    assert got == {1: 200, 2: None, 3: None}


def brute_trail(nodes, start, requests=5):
    """Requests sent one by one; the first goes to the redirecting address again."""
    status, location = nodes[start]
    now, stamp = start, None
    for i in range(requests):
        if i:
            if now not in nodes:
                return stamp, now, None
            status, location = nodes[now]
        if location is None:
            break
        nxt = urljoin(start, location)
        parts = nxt.split("web/")
        stamp = parts[1].split("/")[0].split("id_")[0] if len(parts) > 1 else ""
        visited, now = now, nxt
        if i == requests - 1:
            return stamp, visited, status
    return stamp, now, status


def test_redirects_against_brute_force(spark):
    rng = random.Random(7)
    nodes = {}
    n = 300
    for i in range(n):
        if rng.random() < 0.7:
            # a third of all redirects lead to one address, a few out of the archive
            to = address(0) if rng.random() < 0.34 else address(rng.randrange(n + 20))
            to = rng.choice([to, to, to, "/web/2020id_/x/../y", "http://else.com/"])
            nodes[address(i)] = (rng.choice([302, 302, 301]), to)
        else:
            nodes[address(i)] = (rng.choice([200, 404]), None)
    nodes[address(0)] = (302, address(1))
    for i in range(1, 8):
        nodes[address(i)] = (302, address(i + 1))
    index = spark.createDataFrame([(a, s, loc, True) for a, (s, loc) in nodes.items()], INDEX)
    rows = [(i, a, *nodes[a]) for i, a in enumerate(nodes)]
    attached = spark.createDataFrame([(*r, True) for r in rows], "scid long, url_archive string, status int, location string, is_html boolean")
    got = {r.redirect_url: (r.redirect_timestamp, r.redirect_target, r.final_status) for r in fetched.resolve_redirects(attached, index).collect()}
    starts = [a for a, (s, loc) in nodes.items() if s == 302 and loc]
    assert len(starts) > 80 and set(got) == set(starts)
    for a in starts:
        assert got[a] == brute_trail(nodes, a), a
    assert fetched.resolve_redirects(attached, index).where("hops = 4").count() > 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


SMALL_SKEW = dict(
    autoBroadcastJoinThreshold="-1",
    adaptive_autoBroadcastJoinThreshold="-1",
    adaptive_skewJoin_skewedPartitionThresholdInBytes="20000",
    adaptive_skewJoin_skewedPartitionFactor="2",
    adaptive_advisoryPartitionSizeInBytes="20000",
)


def test_a_target_of_most_redirects_is_split(spark, conf):
    conf(**SMALL_SKEW)
    n = 40_000
    ids = spark.range(n).repartition(16)
    page = archive.archive_url(F.lit("2024"), F.concat(F.lit("http://h.com/"), F.col("id").cast("string")))
    goal = F.when(F.col("id") % 3 == 0, F.lit(address(0))).otherwise(page)
    attached = ids.select(
        F.col("id").alias("scid"),
        F.concat(F.lit("https://web.archive.org/web/2023id_/http://s.com/"), F.col("id").cast("string")).alias("url_archive"),
        F.lit(302).alias("status"),
        goal.alias("location"),
        F.lit(True).alias("is_html"),
    )
    index = ids.select(
        F.when(F.col("id") == 0, F.lit(address(0))).otherwise(page).alias("url_archive"),
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("location"),
        F.lit(True).alias("is_html"),
    )
    trails = fetched.resolve_redirects(attached, cut_lineage(index, "index"))
    assert "skew=true" in final_plan(trails)
    assert trails.where("final_status = 200 AND hops = 1").count() == n


def test_a_link_on_every_page_is_split(spark, conf):
    conf(**SMALL_SKEW)
    n = 40_000
    ids = spark.range(n).repartition(16)
    page = F.concat(F.lit("http://h.com/"), F.col("id").cast("string"))
    found = ids.select(
        F.col("id").alias("page_id"),
        F.lit("/").alias("link"),
        F.when(F.col("id") % 3 == 0, F.lit("http://h.com/0")).otherwise(page).alias("target"),
    )
    rows = ids.select(
        F.col("id").alias("scid"), F.concat(F.lit("h.com/"), F.col("id").cast("string")).alias("url_key"),
        page.alias("url_archive"), F.lit("2024").alias("timestamp"),
    )
    resolved = links.resolve_links(found, versions.keep_last(rows))
    assert "skew=true" in final_plan(resolved)
    assert resolved.where("scid IS NOT NULL").count() == n


def test_conflicts(spark):
    rows = [
        (1, "h/a", True), (2, "h/a/b", True), (3, "h/a/b/c.txt", False), (4, "h/x", False), (5, "h/x/y", False),
        (6, "h/xy", True), (7, "h/a/index.html", True),
    ]
    files = spark.createDataFrame(rows, "scid long, rel_path string, is_html boolean")
    assert sorted(r.rel_path for r in fetched.path_conflicts(files).collect()) == ["h/a", "h/a/b", "h/x"]
    settled = fetched.settle_conflicts(files)
    assert {r.scid: r.rel_path for r in settled.collect()} == {
        1: "h/a/index.html", 2: "h/a/b/index.html", 3: "h/a/b/c.txt", 4: "h/x/x", 5: "h/x/y", 6: "h/xy", 7: "h/a/index.html",
    }
    done = {r.scid: r.outcome for r in fetched.write_once(settled).collect()}
    assert done[1] == "SUCCESS" and done[7] == "EXISTING"


def test_outcomes(spark):
    captures = captures_of(
        spark,
        [
            (1, "2024", "http://a.com/about", "200"),
            (2, "2024", "http://a.com/data.bin", "200"),
            (3, "2024", "http://a.com/moved", "302"),
            (4, "2024", "http://a.com/gone", "200"),
            (5, "2024", "http://a.com/lost", "302"),
            (6, "2024", "http://a.com/never", "200"),
            (7, "2024", "http://www.a.com/about", "200"),
        ],
    )

    def at(path, host="a.com"):
        return f"https://web.archive.org/web/2024id_/http://{host}/{path}"

    payloads = spark.createDataFrame(
        [
            (at("about"), 200, None, None, bytearray(b"<html>1")),
            (at("data.bin"), 200, None, None, bytearray(b"\x00\x01")),
            (at("moved"), 302, at("about"), None, None),
            (at("gone"), 404, None, None, None),
            (at("lost"), 302, at("nowhere"), None, None),
            (at("about", "www.a.com"), 200, None, None, bytearray(b"<html>2")),
        ],
        PAYLOADS,
    )
    index = fetched.payload_index(payloads)
    done = CaptureJob(mode="last").outcomes(CaptureJob().overlaid(captures), index)
    got = {r.scid: (r.outcome, r.file, r.response, r.final_status) for r in done.collect()}
    assert got == {
        1: ("SUCCESS", "a.com/about.html", "200", 200),
        2: ("SUCCESS", "a.com/data.bin", "200", 200),
        3: ("SUCCESS", "a.com/moved.html", "302", 200),
        4: ("UNKNOWN", None, "404", 404),
        5: ("UNKNOWN", None, "302", None),
        7: ("EXISTING", "a.com/about.html", "200", 200),
    }
    bodies = {r.rel_path: bytes(r.body) for r in fetched.stored_files(done, payloads).collect()}
    assert bodies == {"a.com/about.html": b"<html>1", "a.com/data.bin": b"\x00\x01", "a.com/moved.html": b"<html>1"}
    plain = CaptureJob(mode="all", redirects=False).outcomes(CaptureJob().overlaid(captures), index)
    files = {r.scid: r.file for r in plain.collect()}
    assert files[1] == "a.com/2024/about.html" and files[3] is None


def test_redirects_to_one_body_store_it_at_each_path(spark):
    captures = captures_of(spark, [(i, "2024", f"http://a.com/{i}", "302") for i in range(1, 40)])
    goal = "https://web.archive.org/web/2024id_/http://a.com/0"
    rows = [(goal, 200, None, None, bytearray(b"<html>"))]
    rows += [(f"https://web.archive.org/web/2024id_/http://a.com/{i}", 302, goal, None, None) for i in range(1, 40)]
    payloads = spark.createDataFrame(rows, PAYLOADS)
    done = CaptureJob().outcomes(CaptureJob().overlaid(captures), fetched.payload_index(payloads))
    assert fetched.stored_files(done, payloads).count() == 39


def test_overlay_last_row_wins_and_is_stable(spark):
    captures = captures_of(spark, [(1, "2024", "http://a/", "200"), (2, "2025", "http://a/", "404"), (3, "2026", "http://c/", "200")])
    earlier = spark.createDataFrame(
        [
            ("r", 0, "2024", "X", "http://a/", None, None, "500", None),
            ("r", 1, "2024", "Y", "http://a/", "R", "T", "200", "f"),
            ("q", 9, "2024", "Z", "http://a/", None, None, "404", None),
            ("r", 2, "2025", "W", "http://a/", None, None, None, None),
            ("r", 3, "1999", "V", "http://a/", None, None, "200", "g"),
        ],
        "src_file string, csv_line long, timestamp string, url_archive string, url_origin string, redirect_url string, redirect_timestamp string, response string, file string",
    )
    once = overlay.overlay_results(captures, earlier)
    got = {r.scid: (r.url_archive, r.response, r.file, r.redirect_url) for r in once.collect()}
    assert got[1] == ("Y", "200", "f", "R")
    assert got[2] == ("W", None, None, None)
    assert got[3][1] is None
    twice = overlay.overlay_results(once, earlier)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    counts = overlay.overlay_counts(captures, earlier).first()
    assert (counts.csv_rows, counts.matched_rows) == (5, 2)


def test_outcomes_without_value_change_nothing(spark):
    captures = captures_of(spark, [(1, "2024", "http://a/", "404"), (2, "2024", "http://b/", "200")])
    news = spark.createDataFrame([(1, None, None), (2, "200", "f")], "scid long, response string, file string")
    got = {r.scid: (r.response, r.file) for r in overlay.apply_outcomes(captures, news).collect()}
    assert got == {1: ("404", None), 2: ("200", "f")}


def test_bucketed_bodies_are_not_shuffled(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive_autoBroadcastJoinThreshold="-1")
    rows = [(address(i), 200, None, None, bytearray(b"<html>" + str(i).encode())) for i in range(200)]
    table = "payloads_bucketed"
    payload_source.save_bucketed(payload_source.with_sniffed(spark.createDataFrame(rows, PAYLOADS)), table, 8)
    stored = spark.table(table)
    outcomes = spark.createDataFrame(
        [(address(i), address(i), "2024", f"h.com/{i}", "SUCCESS") for i in range(0, 200, 2)],
        "url_archive string, body_address string, timestamp string, file string, outcome string",
    )
    files = fetched.stored_files(outcomes, stored)
    text = files._jdf.queryExecution().executedPlan().toString()
    own = text[: text.index("targets")]
    assert "Bucketed: true" in own
    scan = own.index("payloads_bucketed")
    assert "Exchange" not in own[own.index("Sort [body_address#", own.index("Exchange")) : scan]
    assert files.count() == 100
    index = fetched.payload_index(stored)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in index[index.index("ReadSchema") :]


def test_one_payload_per_address(spark):
    rows = [("a", 302, "x", None, None), ("a", 200, None, None, bytearray(b"1")), ("b", 404, None, None, None)]
    df = spark.createDataFrame(rows, PAYLOADS)
    one = payload_source.one_per_address(df, "status")
    assert sorted((r.url_archive, r.status) for r in one.collect()) == [("a", 200), ("b", 404)]
    assert [tuple(r) for r in payload_source.repeated_addresses(df).collect()] == [("a", 2)]
