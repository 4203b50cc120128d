"""Streams merged into stored tables, overlaid, bounded, watched and compacted."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import overlay, versions
from palimpsest.session import children
from palimpsest.sources import results as result_source
from palimpsest.sources.buckets import BucketTable
from palimpsest.streaming import captures as stream
from palimpsest.streaming import progress
from palimpsest.streaming.store import CaptureStore, merge_captures

from .conftest import captures_of

PLAIN = ["timestamp", "url_origin", "url_key", "statuscode", "response"]


def sample(seed=1, n=120):
    rng = random.Random(seed)
    hosts = ["http://a.com/", "http://www.a.com/", "http://b.org/x", "http://b.org:80/x", "http://c.net/y.html"]
    return [
        (i, f"202401{rng.randrange(1, 9):02d}", rng.choice(hosts) + rng.choice(["", "", "?p=1"]), rng.choice(["200", "404", "302"]))
        for i in range(n)
    ]


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def rows_of(df, columns=PLAIN):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def files_of(store):
    found = glob.glob(f"{store.table.rows_path}/**/*.parquet", recursive=True)
    return {f: os.stat(f).st_mtime_ns for f in found}


@pytest.mark.parametrize("mode", versions.MODES)
def test_batches_give_what_one_run_gives(spark, folder, mode):
    rows = sample()
    store = CaptureStore(spark, f"{folder}/store", mode, buckets=4)
    for k, part in enumerate(cut(rows, 4)):
        state = store.merge(captures_of(spark, part), "s", k)
        so_far = captures_of(spark, rows[: (k + 1) * len(part)])
        want = versions.keep_versions(so_far, mode).withColumn("file", F.lit(None).cast("string"))
        assert rows_of(store.read()) == rows_of(want), k
        counted = want.agg(F.count("*"), F.count("response")).first()
        assert (state.total, state.handled) == tuple(counted)
    assert store.status("t") == progress.report.job_status(want, "t").first().asDict()


def test_a_batch_that_comes_again_changes_nothing(spark, folder):
    rows = sample()
    store = CaptureStore(spark, f"{folder}/store", "last", buckets=4)
    first, second = cut(rows, 2)
    store.merge(captures_of(spark, first), "s", 0)
    state = store.merge(captures_of(spark, second), "s", 1)
    want = rows_of(store.read())
    assert store.merge(captures_of(spark, second), "s", 1) == state
    assert rows_of(store.read()) == want
    # the same lines under another number: nothing wins, so no bucket is written
    before = files_of(store)
    again = store.merge(captures_of(spark, second), "other stream", 0)
    assert files_of(store) == before and (again.total, again.handled) == (state.total, state.handled)


def test_only_buckets_in_which_something_won_are_written(spark, folder):
    store = CaptureStore(spark, f"{folder}/store", "last", buckets=16)
    hosts = [(i, "20240101", f"http://h{i}.com/", "200") for i in range(40)]
    store.merge(captures_of(spark, hosts), "s", 0)
    before = files_of(store)
    store.merge(captures_of(spark, [(0, "20240105", "http://h7.com/", "200"), (1, "20230101", "http://h8.com/", "200")]), "s", 1)
    after = files_of(store)
    kept = {f for f in before if after.get(f) == before[f]}
    changed = {f.split("bucket=")[1].split("/")[0] for f in set(before) - kept}
    assert len(changed) == 1
    assert dict(store.read().select("url_key", "timestamp").collect())["h7.com/index.html"] == "20240105"


@pytest.mark.parametrize("where", ["prepare", "replay", "half"])
def test_an_update_that_died_is_made_again(spark, folder, monkeypatch, where):
    rows = sample()
    store = CaptureStore(spark, f"{folder}/store", "last", buckets=4)
    first, second = cut(rows, 2)
    store.merge(captures_of(spark, first), "s", 0)
    whole = getattr(BucketTable, "replay" if where == "half" else where)

    def dies(self, number, *rest):
        if where == "half":  # the folder of a bucket is gone, its new content is not there yet
            bucket = os.path.basename(glob.glob(f"{self._pending(number)}/bucket=*")[0])
            for f in glob.glob(f"{self.rows_path}/{bucket}/*.parquet"):
                os.remove(f)
        raise RuntimeError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "replay" if where == "half" else where, dies)
        with pytest.raises(RuntimeError):
            store.merge(captures_of(spark, second), "s", 1)
    assert getattr(BucketTable, "replay" if where == "half" else where) is whole
    state = CaptureStore(spark, f"{folder}/store", "last", buckets=4).merge(captures_of(spark, second), "s", 1)
    want = versions.keep_last(captures_of(spark, rows))
    assert rows_of(store.read()) == rows_of(want)
    assert state.total == want.count() and state.handled == want.where("response IS NOT NULL").count()


def results(spark, root, run, rows):
    frame = spark.createDataFrame(rows, "timestamp string, url_origin string, response string, file string")
    frame = frame.withColumns({c: F.lit(None).cast("string") for c in ("redirect_url", "redirect_timestamp")})
    whole = frame.withColumn("url_archive", F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("id_/"), "url_origin"))
    result_source.write_results(whole.coalesce(1), f"{root}/run={run}")


def test_results_of_later_runs_reach_stored_rows(spark, folder):
    """What an earlier run closed never comes back as open; each update uses the run that was the latest then."""
    rows = [(0, "20240101", "http://a.com/", "200"), (1, "20240101", "http://b.com/", "200"), (2, "20240101", "http://c.com/", "200")]
    root = f"{folder}/results"
    results(spark, root, 1, [("20240101", "http://a.com/", "200", "a.com/index.html")])
    store = CaptureStore(spark, f"{folder}/store", "all", root, buckets=4)
    store.merge(captures_of(spark, rows), "s", 0)
    closed = {r.url_origin: r.file for r in store.read().where("response IS NOT NULL").collect()}
    assert closed == {"http://a.com/": "a.com/index.html"}
    results(spark, root, 2, [("20240101", "http://a.com/", "200", "a.com/new.html"), ("20240101", "http://b.com/", "404", None)])
    os.makedirs(f"{root}/run=3")  # begun, not whole
    state = store.merge(captures_of(spark, [(3, "20240102", "http://d.com/", "200")]), "s", 1)
    found = {r.url_origin: (r.response, r.file) for r in store.read().collect()}
    assert found == {
        "http://a.com/": ("200", "a.com/new.html"),
        "http://b.com/": ("404", None),
        "http://c.com/": (None, None),
        "http://d.com/": (None, None),
    }
    assert (state.results_run, state.total, state.handled) == (2, 4, 2)
    # the same lines once more, on a stream that begins anew
    store.merge(captures_of(spark, rows), "again", 0)
    assert {r.url_origin: (r.response, r.file) for r in store.read().collect()} == found


def test_overlay_equals_a_batch(spark, folder):
    rows, root = sample(4), f"{folder}/results"
    some = [(t, u, "200", f"f{i}") for i, (_, t, u, _) in enumerate(rows) if i % 3]
    results(spark, root, 1, some[: len(some) // 2])
    store = CaptureStore(spark, f"{folder}/store", "last", root, buckets=4)
    first, second = cut(rows, 2)
    store.merge(captures_of(spark, first), "s", 0)
    results(spark, root, 2, some)
    store.merge(captures_of(spark, second), "s", 1)
    want = overlay.overlay_results(versions.keep_last(captures_of(spark, rows)), result_source.scan_results(spark, f"{root}/run=2"))
    assert rows_of(store.read(), [*PLAIN, "file"]) == rows_of(want, [*PLAIN, "file"])


def land(spark, folder, batch, rows, stamp=None):
    """Lines as landed; ``stamp`` is the time of landing."""
    lines = [(i, f'["{t}","D","m","{c}","{u}"]') for i, t, u, c in rows]
    spark.createDataFrame(lines, "line_no long, line string").coalesce(1).write.parquet(f"{folder}/batch_id={batch}")
    for f in glob.glob(f"{folder}/batch_id={batch}/*.parquet"):
        os.utime(f, (stamp or time.time(),) * 2)


def test_a_stream_into_a_store(spark, folder):
    rows, seen = sample(2), []
    store = CaptureStore(spark, f"{folder}/store", "last", buckets=4)
    for k, part in enumerate(cut(rows, 3)):
        land(spark, f"{folder}/landed", k, part)
        lines = stream.read_landed(spark, f"{folder}/landed", files_per_trigger=1)
        merge_captures(stream.stream_captures(lines), store, f"{folder}/check", seen.append).awaitTermination()
    want = versions.keep_last(captures_of(spark, rows))
    assert rows_of(store.read()) == rows_of(want)
    assert [s["total"] for s in seen] == sorted(s["total"] for s in seen) and seen[-1]["total"] == want.count()


def test_bounded_duplicate_removal(spark, folder):
    """Repeats within a day go, the state forgets what is older, and a repeat after that comes through.

    State is dropped at the end of the batch that finds the watermark beyond it.
    """
    day = 86_400
    start = time.time() - 10 * day
    one, two = (0, "20240101", "http://a.com/", "200"), (1, "20050505", "http://b.com/", "200")
    batches = [(0, [one, two], 0), (1, [one], day / 2), (2, [(5, "20240102", "http://c.com/", "200")], 4 * day)]
    batches += [(3, [(6, "20240103", "http://d.com/", "200")], 4.5 * day), (4, [one], 5 * day)]
    for k, rows, late in batches:
        land(spark, f"{folder}/landed", k, rows, start + late)
    lines = stream.read_landed(spark, f"{folder}/landed", files_per_trigger=1, timed=True)
    kept = stream.drop_repeated_within(stream.stream_captures(lines), "1 day")
    query = kept.writeStream.format("memory").queryName("within_a_day").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.batch_id, r.url_origin) for r in spark.table("within_a_day").collect())
    assert got == [(0, "http://a.com/"), (0, "http://b.com/"), (2, "http://c.com/"), (3, "http://d.com/"), (4, "http://a.com/")]
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) == 3 and held[-1] <= 3 and min(held[3:]) < 3
    # behind it the store removes the repeat that came through
    store = CaptureStore(spark, f"{folder}/store", "all", buckets=4)
    lines = stream.read_landed(spark, f"{folder}/landed", files_per_trigger=1, timed=True)
    merge_captures(stream.drop_repeated_within(stream.stream_captures(lines), "1 day"), store, f"{folder}/c").awaitTermination()
    assert sorted(r.url_origin for r in store.read().collect()) == ["http://a.com/", "http://b.com/", "http://c.com/", "http://d.com/"]


def wait_for(seen, state, seconds=30):
    end = time.time() + seconds
    while time.time() < end and not any(s["state"] == state for s in seen):
        time.sleep(0.1)
    return [s for s in seen if s["state"] == state]


def test_liveness_of_a_stream(spark, folder, conf):
    conf(streaming_noDataProgressEventInterval="300")
    land(spark, f"{folder}/landed", 0, sample(3, 20))
    seen = []

    def callback(status):
        seen.append(status)
        raise RuntimeError("a callback that fails")

    with progress.liveness(spark, callback, "watched"):
        store = CaptureStore(spark, f"{folder}/store", "last", buckets=2)
        rows = stream.stream_captures(stream.read_landed(spark, f"{folder}/landed"))
        query = merge_captures(rows, store, f"{folder}/c", None, "watched", processingTime="200 milliseconds")
        idle = wait_for(seen, "idle")
        query.stop()
        finished = wait_for(seen, "finished")
    assert seen[0] == {"task": "watched", "state": "running", "batch": None, "rows": 0}
    assert {"task": "watched", "state": "running", "batch": 0, "rows": 20} in seen
    assert idle and idle[0]["batch"] == 0 and finished and query.exception() is None


def test_a_failing_stream_reaches_the_callback(spark, folder):
    land(spark, f"{folder}/landed", 0, sample(3, 5))
    seen = []

    def broken(batch, number):
        raise ValueError("cannot be merged")

    with progress.liveness(spark, seen.append, "doomed"):
        rows = stream.read_landed(spark, f"{folder}/landed")
        query = rows.writeStream.queryName("doomed").foreachBatch(broken).option("checkpointLocation", f"{folder}/c").start()
        with pytest.raises(Exception, match="cannot be merged"):
            query.awaitTermination()
        failed = wait_for(seen, "failed")
    assert failed and "cannot be merged" in failed[0]["error"]


def test_compaction_of_a_change_log(spark, folder):
    log, rows = f"{folder}/log", sample(6, 100)
    schema = captures_of(spark, rows).select("url_key", "timestamp", "statuscode").schema
    want, readers = {}, []
    assert stream.compact(spark, log) is None
    for k, part in enumerate(cut(rows, 5)):
        changes = versions.keep_last(captures_of(spark, part)).select(*schema.names).collect()
        spark.createDataFrame(changes, schema).coalesce(1).write.parquet(f"{log}/batch_id={k}")
        want |= {r.url_key: (r.timestamp, r.statuscode) for r in changes}
        readers.append((stream.current(spark, log), dict(want)))
        if k == 2:  # a snapshot that was begun and not finished is none
            os.makedirs(f"{log}/_snapshots/upto=2")
        if k in (0, 2, 3):
            assert stream.compact(spark, log) == k
            assert stream.compact(spark, log) == k
        got = {r.url_key: (r.timestamp, r.statuscode) for r in stream.current(spark, log).collect()}
        assert got == want
        # whoever began to read before the last compaction reads on
        reader, then = readers[-1]
        assert {r.url_key: (r.timestamp, r.statuscode) for r in reader.collect()} == then
    assert children(spark, f"{log}/_snapshots") == ["upto=2", "upto=3"]
    assert [n for n in children(spark, log) if n.startswith("batch")] == ["batch_id=3", "batch_id=4"]
