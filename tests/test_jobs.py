"""Whole runs, reruns and the ledger."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.job import CaptureJob
from palimpsest.plans.ledger import Ledger
from palimpsest.schema import PAYLOADS
from palimpsest.sources import payloads as payload_source
from palimpsest.sources import results, tree
from palimpsest import session

HEADER = '[["timestamp","digest","mimetype","statuscode","original"],'


def listing_file(folder):
    rows = [
        ("20240101000000", "200", "http://a.com/about"),
        ("20240201000000", "200", "http://www.a.com/about"),
        ("20240201000000", "404", "http://www.a.com/about"),
        ("20240101000000", "404", "http://a.com/gone"),
        ("20240101000000", "302", "http://a.com/moved"),
        ("20240101000000", "200", "mailto:x@a.com"),
        ("20240101000000", "200", "http://a.com/open"),
    ]
    lines = [HEADER] + [f'["{t}","D","text/html","{s}","{u}"],' for t, s, u in rows] + ['["2024","D']
    path = os.path.join(folder, "a.cdx")
    with open(path, "w") as out:
        out.write("\n".join(lines))
    return path


def at(stamp, url):
    return f"https://web.archive.org/web/{stamp}id_/{url}"


def payloads(spark):
    rows = [
        (at("20240201000000", "http://www.a.com/about"), 200, None, None, bytearray(b"<html>about")),
        (at("20240101000000", "http://a.com/moved"), 302, at("20240201000000", "http://www.a.com/about"), None, None),
    ]
    return spark.createDataFrame(rows, PAYLOADS)


def final_rows(tables):
    return {r.url_origin: (r.response, r.file) for r in tables.final.collect()}


def test_run_rerun_and_resume(spark, folder):
    path, root = listing_file(folder), folder + "/run"
    job = CaptureJob()
    tables = job.run(spark, path, root, payloads(spark))
    want = {
        "http://www.a.com/about": ("200", "a.com/about.html"),
        "http://a.com/gone": ("404", None),
        "http://a.com/moved": ("302", "a.com/moved.html"),
        "http://a.com/open": (None, None),
    }
    assert final_rows(tables) == want
    funnel = tables.funnel().first().asDict()
    assert funnel == dict(total=8, faulty=1, malformed=0, mailto=1, duplicates=1, versions=1, kept=4, skip_statuscode=1, skip_existing=0, to_utilize=3)
    assert tables.status().first().asDict() == dict(task="done", current=3, total=4, progress="75%")
    assert tables.summary().first().asDict() == dict(downloaded=2, skipped=2)
    print_of = "2-" + payload_source.fingerprint(payloads(spark)).split("-")[1]
    stages = {r.stage: r.rows for r in tables.ledger.entries().collect()}
    assert stages == {
        "files-1": 1, "lines-1": 8, "versions-1": 4, "numbered-1": 4, "overlaid-1-1": 4, f"index-1-1-{print_of}": 2, f"bodies-1-1-{print_of}": 1,
        f"outcomes-1-1-{print_of}": 2, f"final-1-1-{print_of}": 4, "run-1": 4,
    }
    assert tables.ledger.entries().where("stage = 'run-1'").first().progress == "3 / 4"
    stored = spark.read.parquet(tables.ledger.stage_path("tree/run=1")).collect()
    assert {(r.domain, r.rel_path): bytes(r.body) for r in stored} == {
        ("a.com", "a.com/about.html"): b"<html>about",
        ("a.com", "a.com/moved.html"): b"<html>about",
    }

    # a rerun finds the selection done and changes nothing
    again = job.run(spark, path, root, payloads(spark))
    assert final_rows(again) == want
    assert again.funnel().first().skip_existing == 2 and again.funnel().first().to_utilize == 1
    assert spark.read.parquet(again.ledger.stage_path(f"outcomes-2-1-{print_of}")).count() == 0

    # another listing, or a changed one, is not taken for the one that was read
    other = os.path.join(folder, "b.cdx")
    with open(other, "w") as out:
        out.write(HEADER + '\n["20240101000000","D","text/html","200","http://b.com/"]]')
    with pytest.raises(ValueError, match="gone or has changed"):
        job.run(spark, other, root, payloads(spark))

    # payloads that came later close what was open; places taken stay taken
    late = spark.createDataFrame(
        [(at("20240101000000", "http://a.com/open"), 302, at("20240201000000", "http://www.a.com/about"), None, None)],
        PAYLOADS,
    )
    more = job.run(spark, path, root, payloads(spark).unionByName(late))
    assert final_rows(more) == {**want, "http://a.com/open": ("302", "a.com/open.html")}
    assert [r.rel_path for r in spark.read.parquet(more.ledger.stage_path("tree/run=3")).collect()] == ["a.com/open.html"]

    # another folder, but the earlier results: only the open capture is left to do
    assert results.scan_results(spark, tables.results_path).count() == 3
    third = job.run(spark, path, folder + "/second", payloads(spark), tables.results_path)
    assert final_rows(third) == want
    assert spark.read.parquet(third.ledger.stage_path(f"outcomes-1-1-{print_of}")).count() == 0

    # files that came to the listing join it
    wider = job.run(spark, [path, other], root, payloads(spark))
    assert set(final_rows(wider)) == {*want, "http://b.com/"}
    assert wider.lines.count() == 9 and wider.funnel().first().kept == wider.versions.count() == 5


def test_a_run_that_died_goes_on(spark, folder, monkeypatch):
    path, root = listing_file(folder), folder + "/run"
    monkeypatch.setattr(tree, "write_snapshot_tree", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        CaptureJob().run(spark, path, root, payloads(spark))
    monkeypatch.undo()
    tables = CaptureJob().run(spark, path, root, payloads(spark))
    assert final_rows(tables)["http://a.com/moved"] == ("302", "a.com/moved.html")
    assert tables.ledger.runs() == 1
    assert spark.read.parquet(tables.ledger.stage_path("tree/run=1")).count() == 2


def test_places_of_earlier_runs(spark):
    from palimpsest.operators import fetched

    stored = spark.createDataFrame([("h/a/b",), ("h/c",)], "rel_path string")
    files = spark.createDataFrame([(1, "h/a", True), (2, "h/c", True), (3, "h/d", True)], "scid long, rel_path string, is_html boolean")
    settled = fetched.settle_conflicts(files, stored)
    assert {r.scid: r.rel_path for r in settled.collect()} == {1: "h/a/index.html", 2: "h/c", 3: "h/d"}
    done = {r.scid: r.outcome for r in fetched.write_once(settled, stored).collect()}
    assert done == {1: "SUCCESS", 2: "EXISTING", 3: "SUCCESS"}


def test_a_stage_that_failed_is_built_again(spark, folder):
    ledger = Ledger(spark, folder, "job")
    with pytest.raises(Exception):
        ledger.run_stage("s", lambda: spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")))
    assert not ledger.is_done("s")
    assert ledger.run_stage("s", lambda: spark.range(3)).count() == 3
    assert ledger.run_stage("s", lambda: pytest.fail("built twice")).count() == 3
    assert not Ledger(spark, folder, "other").is_done("s")


def test_funnels_of_all_options(spark, folder):
    path = listing_file(folder)
    for mode in ("all", "first", "last"):
        for skip_first in (False, True):
            tables = CaptureJob(mode=mode, skip_first=skip_first).run(spark, path, folder + "/run")
            funnel = tables.funnel().first()
            assert funnel.kept == tables.versions.count()
            assert funnel.to_utilize == tables.final.where("response IS NULL").count()
            gone = funnel.faulty + funnel.malformed + funnel.mailto + funnel.duplicates + funnel.versions
            assert funnel.total == gone + funnel.kept + (funnel.skip_statuscode if skip_first else 0)


def test_a_site_in_a_job_that_tells_hosts_apart(spark, folder):
    job = CaptureJob(url="a.com", merge_www=False)
    found = job.run(spark, listing_file(folder), folder + "/run").versions.collect()
    assert {r.url_key for r in found} >= {"www.a.com/about", "a.com/about"}


def test_limit_over_files(spark, folder):
    for name, days in (("b.cdx", ("01",)), ("a.cdx", ("02", "03", "04"))):
        with open(os.path.join(folder, name), "w") as out:
            out.write("\n".join([HEADER] + [f'["202401{d}000000","D","m","200","http://a.com/{name}{d}"],' for d in days]))
    found = CaptureJob(limit=2).run(spark, folder, folder + "-run").versions.collect()
    assert {r.url_origin for r in found} == {"http://a.com/a.cdx02", "http://a.com/a.cdx03"}


def test_a_listing_without_header_is_refused(spark, folder):
    with open(os.path.join(folder, "a.cdx"), "w") as out:
        out.write('["20240101000000","D","m","200","http://a.com/"]]')
    with pytest.raises(ValueError, match="header"):
        CaptureJob().run(spark, folder, folder + "-run")


def test_job_ids(spark):
    base = CaptureJob(url="a.com")
    assert base.job_id == CaptureJob(url="a.com").job_id
    others = [CaptureJob(), CaptureJob(url="a.com", mode="first"), CaptureJob(url="a.com", limit=1), CaptureJob(url="a.com", start="1")]
    assert len({j.job_id for j in [base, *others, CaptureJob(url="a.com", end="1")]}) == 6
    with pytest.raises(ValueError):
        CaptureJob(mode="newest")


def test_repeated_payloads_are_refused(spark, folder):
    twice = payloads(spark).unionAll(payloads(spark))
    with pytest.raises(ValueError, match="2 payloads"):
        CaptureJob().run(spark, listing_file(folder), folder + "/run", twice)


def test_long_paths(spark, folder):
    tables = CaptureJob().run(spark, listing_file(folder), folder + "/run", payloads(spark))
    assert {r.file for r in tables.too_long("/srv/", 20).collect()} == {"a.com/about.html", "a.com/moved.html"}
    assert tables.too_long("/srv/").count() == 0


def test_loose_files(spark, folder):
    rows = [("a.com/x/index.html", bytearray(b"1")), ("b.com/y", bytearray(b"2")), ("b.com/none", None)]
    stored = spark.createDataFrame(rows, "rel_path string, body binary")
    for _ in range(2):
        tree.export_files(stored, folder + "/out")
    found = {}
    for where, _, names in os.walk(folder + "/out"):
        for name in names:
            full = os.path.join(where, name)
            found[os.path.relpath(full, folder + "/out")] = open(full, "rb").read()
    assert found == {"a.com/x/index.html": b"1", "b.com/y": b"2"}


def test_tree_by_timestamp(spark, folder):
    rows = [("a.com", "2024", "a.com/2024/x", bytearray(b"1"))]
    tree.write_snapshot_tree(spark.createDataFrame(rows, "domain string, timestamp string, rel_path string, body binary"), folder + "/t", by_timestamp=True)
    assert [d for d in os.listdir(folder + "/t") if "=" in d][0].startswith("part=")
    assert spark.read.parquet(folder + "/t").select("domain", "timestamp", "rel_path").collect() == [("a.com", "2024", "a.com/2024/x")]


@pytest.mark.parametrize("size, least, most", [("64k", 5, 64), ("64m", 1, 1)])
def test_writers_grow_with_the_bytes_of_a_domain(spark, folder, conf, size, least, most):
    """One domain with most of the data is as many files as its bytes ask for."""
    conf(adaptive_advisoryPartitionSizeInBytes=size, shuffle_partitions="16")
    noise = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.md5(F.concat(F.col("id").cast("string"), k.cast("string"))))
    rows = spark.range(0, 4_000, 1, 8).select(
        F.when(F.col("id") % 4 > 0, "hot.com").otherwise(F.concat(F.lit("h"), (F.col("id") % 40).cast("string"))).alias("domain"),
        F.concat(F.lit("p"), "id").alias("rel_path"),
        F.encode(F.concat_ws("", noise), "utf-8").alias("body"),
    )
    tree.write_snapshot_tree(rows, folder + "/t", parts=16)
    stored = spark.read.parquet(folder + "/t").withColumn("file", F.input_file_name())
    files = {r.domain: r.n for r in stored.groupBy("domain").agg(F.count_distinct("file").alias("n")).collect()}
    assert least <= files["hot.com"] <= most
    assert stored.select("rel_path").distinct().count() == stored.count() == 4_000


def test_years_count_back_from_the_first_run(spark, folder):
    job, ledger = CaptureJob(range_years=2), Ledger(spark, folder, CaptureJob(range_years=2).job_id)
    ledger.enter("as-of 2020-06-01", 0, "")
    assert job.dated(ledger).as_of == date(2020, 6, 1) and job.dated(ledger).range_years == 2
    other = Ledger(spark, folder, CaptureJob(range_years=3).job_id)
    first = CaptureJob(range_years=3).dated(other).as_of
    assert first is not None and CaptureJob(range_years=3).dated(other).as_of == first
    assert CaptureJob().dated(ledger) == CaptureJob()
    given = CaptureJob(range_years=2, as_of=date(2001, 1, 1))
    assert given.dated(ledger) is given


def test_shared_folder_comes_from_the_session(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shell_options():
    from palimpsest.__main__ import job_of, parse

    opts = parse(["in", "out", "--first", "--url", "a.com", "--statuscode", "200, 302", "--keep-www", "--limit", "5"])
    assert job_of(opts) == CaptureJob(
        url="a.com", mode="first", statuscode=("200", "302"), merge_www=False, limit=5
    )
    for wrong in (["in", "out"], ["in", "out", "--first", "--last"]):
        with pytest.raises(SystemExit):
            parse(wrong)


def test_loose_files_progress_and_lines_of_a_run(spark, folder):
    seen = []
    tables = CaptureJob().run(
        spark, listing_file(folder), folder + "/run", payloads(spark), export_root=folder + "/out", progress=seen.append
    )
    assert [(s["task"], s["current"], s["total"]) for s in seen] == [("select", 1, 4), ("download", 3, 4)]
    assert open(folder + "/out/a.com/about.html", "rb").read() == open(folder + "/out/a.com/moved.html", "rb").read()
    assert len(tables.outcome_lines().collect()) == 2


def test_only_wanted_bodies_are_read(spark, folder):
    from palimpsest.operators import fetched

    rows = payloads(spark)
    assert "body" not in fetched.narrow_index(rows).columns
    goals = spark.createDataFrame([(at("20240201000000", "http://www.a.com/about"),)], "body_address string")
    assert [(r.url_archive, r.is_html) for r in fetched.wanted_bodies(rows, goals).collect()] == [(goals.first()[0], True)]
