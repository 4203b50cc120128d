"""Results laid over stored tables, body filters, deep redirects, and funnels that read once."""

import glob
import os
import random
from itertools import count

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.operators import fetched, filters, overlay, report, versions
from palimpsest.session import cut_lineage
from palimpsest.sources import buckets, listing
from palimpsest.sources.buckets import BucketTable

from .conftest import captures_of

RESULT = "csv_line long, timestamp string, url_origin string, url_archive string, redirect_url string, redirect_timestamp string, response string, file string"


def stored(spark, folder, rows, buckets=8):
    empty = {c: F.lit(None).cast("string") for c in ("redirect_url", "redirect_timestamp", "file")}
    captures = captures_of(spark, rows).withColumns(empty)
    table = BucketTable(spark, f"{folder}/table", captures.schema, ["timestamp", "url_origin"], buckets)
    table.prepare(0, captures)
    table.replay(0)
    return table, captures


def files_of(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.rows_path}/**/*.parquet", recursive=True)}


LINES = count()


def result(t, u, response, file=None):
    return (next(LINES), t, u, f"https://web.archive.org/web/{t}id_/{u}", None, None, response, file)


def test_update_in_place_equals_overlay(spark, folder):
    rng = random.Random(2)
    rows = [(i, f"2024010{rng.randrange(1, 6)}", f"http://h{i}.com/", rng.choice(["200", "404"])) for i in range(80)]
    table, captures = stored(spark, folder, rows)
    some = [result(t, u, rng.choice(["200", None]), rng.choice([None, "f"])) for _, t, u, _ in rows[::3]] + [result("1999", "http://no.com/", "200")]
    news = spark.createDataFrame(some, RESULT)
    overlay.overlay_update(table, news, 1)
    want = overlay.overlay_results(captures, news)
    got = table.read().drop("bucket")
    assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def test_untouched_buckets_keep_their_files(spark, folder):
    rows = [(i, "20240101", f"http://h{i}.com/", "200") for i in range(60)]
    table, _ = stored(spark, folder, rows)
    before = files_of(table)
    news = spark.createDataFrame([result("20240101", "http://h5.com/", "200", "f")], RESULT)
    changed = overlay.overlay_update(table, news, 1)
    after = files_of(table)
    gone = {f.split("bucket=")[1].split("/")[0] for f in before if after.get(f) != before[f]}
    assert len(changed) == 1 and gone == {str(changed[0])}
    # the same results again change no value, so nothing is written
    assert overlay.overlay_update(table, news, 2) == [] and files_of(table) == after


def test_an_update_that_died_is_put_in_place_again(spark, folder, monkeypatch):
    table, captures = stored(spark, folder, [(i, "20240101", f"http://h{i}.com/", "200") for i in range(20)])
    news = spark.createDataFrame([result("20240101", "http://h5.com/", "200", "f")], RESULT)

    def dies(self, number):
        raise RuntimeError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "replay", dies)
        with pytest.raises(RuntimeError):
            overlay.overlay_update(table, news, 1)
    assert overlay.overlay_update(table, news, 1) == []
    assert {r.url_origin for r in table.read().where("file = 'f'").collect()} == {"http://h5.com/"}
    assert table.read().count() == captures.count()


def test_replay_moves_what_is_written_already(spark, folder, monkeypatch):
    """No row is written a second time, and what a replay that died left is moved by the next."""
    table, captures = stored(spark, folder, [(i, "20240101", f"http://h{i}.com/", "200") for i in range(20)], buckets=4)
    table.prepare(1, captures.withColumn("file", F.lit("f")))
    written = {os.path.basename(f) for f in glob.glob(f"{table._pending(1)}/**/*.parquet", recursive=True)}
    move, calls = buckets.move, count()

    def dies(*paths):
        if next(calls) == 1:
            raise RuntimeError("gone")
        move(*paths)

    monkeypatch.setattr(buckets, "move", dies)
    with pytest.raises(RuntimeError):
        table.replay(1)
    for _ in range(2):
        table.replay(1)
        assert {os.path.basename(f) for f in files_of(table)} == written
        assert table.read().where("file = 'f'").count() == captures.count()


def test_rows_and_results_meet_once(spark, folder, monkeypatch):
    table, _ = stored(spark, folder, [(i, "20240101", f"http://h{i}.com/", "200") for i in range(20)])
    news = spark.createDataFrame([result("20240101", "http://h5.com/", "200", "f")], RESULT)
    plans, collect = [], type(news).collect
    monkeypatch.setattr(type(news), "collect", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or collect(df))
    overlay.overlay_update(table, news, 1)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


# ---------------------------------------------------------------- body filter


def test_a_filter_loses_no_address_and_lets_few_others_pass(spark):
    def addresses(prefix, n):
        return cut_lineage(spark.range(n).select(F.concat(F.lit(prefix), "id").alias("a")), "addresses")

    wanted, others = addresses("http://w/", 3_000), addresses("http://o/", 20_000)
    assert fetched.possibly_among(wanted, "a", wanted).count() == 3_000
    assert fetched.possibly_among(others, "a", wanted).count() < 20_000 / 10
    assert fetched.possibly_among(others, "a", wanted.limit(0)).count() == 0
    with_null = others.limit(3).union(spark.createDataFrame([(None,)], "a string"))
    assert fetched.possibly_among(with_null, "a", wanted).where("a IS NULL").count() <= 1


def test_bodies_meet_the_filter_ahead_of_the_exchange(spark, conf):
    """Of a table too large to broadcast only wanted bodies, and a few others, are shuffled."""
    conf(autoBroadcastJoinThreshold="-1", adaptive_enabled="false")
    payloads = cut_lineage(
        spark.range(5_000).select(
            F.concat(F.lit("https://web.archive.org/web/1id_/"), "id").alias("url_archive"),
            F.lit(200).alias("status"),
            F.lit(None).cast("string").alias("location"),
            F.lit(None).cast("string").alias("encoding"),
            F.encode(F.repeat(F.lit("x"), 500), "utf-8").alias("body"),
        ),
        "payloads",
    )
    goals = cut_lineage(payloads.where("url_archive LIKE '%7'").select("url_archive"), "goals")
    found = fetched.wanted_bodies(payloads, goals)
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    # from the top down: the join of bodies and goals, the exchange, the filter, the scan
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(url_archive") < plan.index("BroadcastHashJoin")
    assert fetched.possibly_among(payloads, "url_archive", goals).count() < 500 + 4_500 / 10


def test_attached_bodies_are_those_of_open_captures(spark):
    captures = captures_of(spark, [(0, "1", "http://a.com/", "200"), (1, "1", "http://b.com/", "404"), (2, "1", "http://c.com/", "200")])
    bodies = [(f"https://web.archive.org/web/1id_/http://{h}.com/", 200, None, None, h.encode()) for h in "abxyz"]
    payloads = spark.createDataFrame(bodies, "url_archive string, status int, location string, encoding string, body binary")
    got = {r.scid: r.body for r in fetched.attach_payloads(captures, payloads).collect()}
    assert got == {0: bytearray(b"a"), 1: None, 2: None}


# ---------------------------------------------------------------- deep redirects


def walked(start, onward):
    seen = [start]
    while seen[-1] in onward:
        following = onward[seen[-1]]
        if following in seen:
            return None, None, min(seen[seen.index(following) :])
        seen.append(following)
    return seen[-1], len(seen) - 1, None


def address(n):
    return f"https://web.archive.org/web/2024id_/http://h.com/{n}"


@pytest.mark.parametrize("kind", ["chain", "loop", "tails", "random", "star"])
def test_redirects_of_any_depth(spark, kind):
    rng = random.Random(kind)
    onward = {
        "chain": {i: i + 1 for i in range(41)},
        "loop": {**{i: (i + 1) % 33 for i in range(33)}, 50: 50, 60: 61, 61: 60},
        "tails": {**{i: i + 1 for i in range(30)}, 30: 12, **{100 + i: 99 + i for i in range(1, 20)}, 100: 5},
        "random": {i: rng.randrange(120) for i in range(0, 100)},
        "star": {**{i: 1_000 for i in range(200)}, 1_000: 1_001},
    }[kind]
    rows = [(address(a), 302, address(b)) for a, b in onward.items()]
    ends = {b for b in onward.values()} - onward.keys()
    rows += [(address(e), 200, None) for e in sorted(ends)[::2]]
    index = spark.createDataFrame(rows, "url_archive string, status int, location string").withColumn("is_html", F.lit(False))
    got = {r.address: (r.target, r.hops, r.loop) for r in fetched.redirect_ends(index).collect()}
    names = {address(a): address(b) for a, b in onward.items()}
    assert got == {a: walked(a, names) for a in names}


def test_no_redirects_end_nowhere(spark):
    index = spark.createDataFrame([(address(1), 200, None)], "url_archive string, status int, location string")
    assert fetched.redirect_ends(index).collect() == []


# ---------------------------------------------------------------- funnels


@pytest.mark.parametrize("mode, skip_first", [("last", False), ("first", False), ("all", False), ("last", True), ("all", True)])
def test_funnel_read_once_equals_the_other(spark, mode, skip_first):
    rng = random.Random(11)
    lines = [f'["202401{rng.randrange(1, 5):02d}","D","m","{rng.choice(["200", "301", "404"])}","http://{rng.choice("abc")}.com/{rng.randrange(3)}"]' for _ in range(150)]
    lines += ['["20240101","D","m","200"]', "[broken", '["20240101","D","m","200","mailto:x@y"]'] * 3
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    parsed = cut_lineage(urls.with_url_parts(listing.parse_listing(frame)), "lines")
    captures = listing.to_captures(parsed)
    some = spark.createDataFrame([result(f"202401{k:02d}", f"http://{h}.com/{n}", "200", "f") for k in (1, 3) for h in "ab" for n in range(3)], RESULT)
    overlaid = overlay.overlay_results(versions.keep_versions(captures, mode, skip_first), some)
    for over in (None, overlaid):
        want = report.capture_funnel(parsed, mode, skip_first, over).first()
        got = report.capture_funnel_once(parsed, mode, skip_first, over).first()
        assert got == want and got.total == len(lines) and got.malformed == 3 and got.faulty == 3


def test_the_counting_step_scans_once_and_combines_first(spark):
    frame = spark.createDataFrame([(0, '["1","D","m","200","http://a.com/"]')], "line_no long, line string")
    parsed = cut_lineage(urls.with_url_parts(listing.parse_listing(frame)), "lines")
    plan = report.counted_captures(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("partial_min_by") == 1 and plan.count("Exchange") == 1


def test_an_empty_listing_has_an_empty_funnel(spark):
    frame = spark.createDataFrame([], "line_no long, line string")
    parsed = cut_lineage(urls.with_url_parts(listing.parse_listing(frame)), "lines")
    row = report.capture_funnel_once(parsed).first().asDict()
    assert set(row.values()) == {0}


# ---------------------------------------------------------------- paths and stored captures


def folders_of(paths):
    return {"/".join(p.split("/")[:k]) for p in paths for k in range(1, p.count("/") + 1)}


@pytest.mark.parametrize("partitions", [1, 7])
def test_conflicts_by_neighbours(spark, conf, partitions):
    conf(shuffle_partitions=str(partitions), adaptive_coalescePartitions_enabled="false")
    rng = random.Random(partitions)
    steps = ["a", "b", "a.b", "a b", "a-", "a\x01", "\x00", "\x01", "", "é", "a!", "a0"]
    paths = ["/".join(rng.choice(steps) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    paths += [f"deep/{'x/' * k}end" for k in range(40)] + [f"deep/{'x/' * k}x" for k in range(0, 40, 3)]
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "scid long, rel_path string")
    got = [r.rel_path for r in fetched.path_conflicts(files).collect()]
    assert len(got) == len(set(got)) and set(got) == set(paths) & folders_of(paths)
    earlier = spark.createDataFrame([("solo/below",), ("a",)], "rel_path string")
    more = files.union(spark.createDataFrame([(9_999, "solo")], files.schema))
    again = {r.rel_path for r in fetched.path_conflicts(more, earlier).collect()}
    assert again == set(got) | {"solo"}


def test_conflicts_of_nothing_and_of_one_path(spark):
    one = spark.createDataFrame([("a",)], "rel_path string")
    assert fetched.path_conflicts(one).collect() == [] == fetched.path_conflicts(one.limit(0)).collect()


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    while leaf.nodeName().startswith(("AdaptiveSparkPlan", "ShuffleQueryStage")):
        leaf = (leaf.executedPlan() if leaf.nodeName().startswith("Adaptive") else leaf.plan()).collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_filters_skip_row_groups_of_landed_captures(spark, folder):
    rows = [(i, f"2024{i % 12 + 1:02d}01", f"http://h{i % 50:02d}.com/p{i}", "200") for i in range(30_000)]
    captures = captures_of(spark, rows)
    listing.land_captures(captures, f"{folder}/landed", row_group_bytes=64 * 1024)
    stored = spark.read.parquet(f"{folder}/landed")
    site = filters.filter_url(stored, "http://h07.com/")
    assert site.count() == 600 and rows_scanned(site) < 30_000 / 4
    address = "http://h07.com/p9907"
    assert [r.scid for r in stored.where(F.col("url_origin") == address).collect()] == [9_907]
    assert rows_scanned(stored.where(F.col("url_origin") == address)) < 30_000 / 4
    # an address within the bounds of every row group, and in none
    assert rows_scanned(stored.where(F.col("url_origin") == "http://h07.com/p99071")) < 30_000 / 4
    assert sorted(site.collect(), key=str) == sorted(filters.filter_url(captures, "http://h07.com/").select(*site.columns).collect(), key=str)
