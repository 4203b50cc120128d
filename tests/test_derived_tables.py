"""Queries over small tables of the tests' own rows."""

import datetime
import os

import pytest

from palimpsest.checks import QUERIES, derived, of_streams, of_tables
from palimpsest.checks.of_streams import _landings
from palimpsest.operators import fetched
from palimpsest.session import cut_lineage
from palimpsest.streaming import captures as stream
from palimpsest.streaming import store as store_module
from palimpsest.streaming.store import CaptureStore
from tests.conftest import captures_of

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
KINDS = ("click", "view", "purchase", "signup", "error")


@pytest.fixture()
def tables(spark, folder):
    """Pages, of which some share an address, and events that meet them."""
    pages = [(k, f"http://www.site{k % 3}.com/a/{k // 2 * 2 if k < 4 else k}", f"<html><body>{k}</body></html>") for k in range(10)]
    events = [(k, START + datetime.timedelta(hours=k), k % 7, KINDS[k * 3 % 5]) for k in range(120)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    shape = "event_id long, ts timestamp, user_id long, event_type string"
    spark.createDataFrame(events, shape).write.parquet(f"{folder}/events.parquet")
    return folder


def test_capture_run_over_pages_that_share_an_address(spark, tables):
    shared = [(10, "http://www.site1.com/a/4", "<html>another</html>")]
    spark.createDataFrame(shared, "page_id long, url string, html string").write.mode("append").parquet(f"{tables}/pages.parquet")
    rows = QUERIES["capture_run"](spark, tables).collect()
    plain = QUERIES["keep_last"](spark, tables).collect()
    assert {r.url_archive for r in rows} == {r.url_archive for r in plain}


def test_landings_do_not_grow_in_number():
    folders = [f"f{k}" for k in range(37)]
    assert _landings(folders[:4]) == [["f0"], ["f1"], ["f2"], ["f3"]]
    assert len(_landings(folders)) == 4 and sum(_landings(folders), []) == folders


def test_files_that_land_together_are_numbered_by_name(spark, folder):
    many = [f'["line","{k}"],' for k in range(3000)]
    inbox = f"{folder}/in"
    os.makedirs(inbox)
    # the later file is the larger one, which Spark reads first
    for name, part in (("a", many[:10]), ("b", many[10:2000]), ("c", many[2000:])):
        with open(f"{inbox}/{name}.txt", "w") as out:
            out.write("\n".join(part) + "\n")
    stream.land_lines(spark, inbox, f"{folder}/landed", f"{folder}/c").awaitTermination()
    lines = spark.read.parquet(f"{folder}/landed/batch_id=0").orderBy("line_no").collect()
    assert [r.line for r in lines] == [m[:-1] for m in many]


def test_micro_batches_grow_in_size(spark, tables, monkeypatch):
    monkeypatch.setattr(of_streams, "LINES_PER_FILE", 10)
    path, together = of_streams._landed(spark, tables)
    assert together == 3 and spark.read.parquet(path).count() == QUERIES["count_cdx_rows"](spark, tables).first()[0]


def test_a_store_of_all_captures_sorts_only_new_ones(spark, folder, monkeypatch):
    store = CaptureStore(spark, f"{folder}/store", "all", buckets=4)
    first = captures_of(spark, [(k, "20240101000000", f"http://a.com/{k}", "200") for k in range(20)])
    store.merge(first, "test", 0)
    cut = []
    monkeypatch.setattr(store_module, "cut_lineage", lambda df, label: cut.append(cut_lineage(df, label)) or cut[-1])
    again = captures_of(spark, [(k, "20240101000000", f"http://a.com/{k}", "301") for k in range(15, 23)])
    state = store.merge(again, "test", 1)
    assert [t.count() for t in cut] == [3]
    assert (state.total, state.handled) == (23, 3) and store.read().count() == 23


def test_rounds_of_redirects_move_no_texts(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(fetched, "cut_lineage", lambda df, label: kept.setdefault(label, []).append(df.schema) or cut_lineage(df, label))
    site = "https://web.archive.org/web/20240101000000id_/http://a.com/"
    chain = [(f"{site}{k}", 302, f"{site}{k + 1}") for k in range(9)] + [(f"{site}x", 302, f"{site}y"), (f"{site}y", 302, f"{site}x")]
    index = spark.createDataFrame([*chain, (f"{site}9", 200, None)], "url_archive string, status int, location string")
    got = {r.address: (r.target, r.hops, r.loop) for r in fetched.redirect_ends(index).collect()}
    assert got == {
        **{f"{site}{k}": (f"{site}9", 9 - k, None) for k in range(9)},
        **{f"{site}{k}": (None, None, f"{site}x") for k in "xy"},
    }
    assert not any(f.dataType.simpleString() == "string" for s in kept["pointers"] for f in s)


def test_only_wanted_bodies_move(spark, tables, monkeypatch):
    shapes = "scid long, url_archive string, body_address string, timestamp string, outcome string, file string"
    done = spark.createDataFrame([(1, "u1", "u1", "2024", "SUCCESS", "a.com/1"), (2, "u2", "u3", "2024", "SUCCESS", "a.com/2")], shapes)
    bodies = spark.createDataFrame([(f"u{k}", b"%d" % k) for k in range(9)], "url_archive string, body binary")
    files = fetched.stored_files(done, bodies)
    assert sorted((r.rel_path, bytes(r.body)) for r in files.collect()) == [("a.com/1", b"1"), ("a.com/2", b"3")]
    assert "__bitmap" in files._jdf.queryExecution().analyzed().toString()
    plans, write = [], of_tables.tree.write_snapshot_tree
    monkeypatch.setattr(
        of_tables.tree, "write_snapshot_tree", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed().toString()) or write(df, *a)
    )
    QUERIES["write_snapshot_tree"](spark, tables)
    assert "__bitmap" in plans[0]


def test_the_index_of_payloads_is_that_of_their_bodies(spark, tables):
    whole = fetched.payload_index(derived.payloads(spark, tables))
    narrow = derived.payload_index(spark, tables)
    assert narrow.columns == whole.columns and narrow.count() > 0
    assert narrow.exceptAll(whole).isEmpty() and whole.exceptAll(narrow).isEmpty()


@pytest.mark.parametrize("name", ["overlay_update", "attach_payloads", "apply_outcomes", "overlay_results", "payload_index"])
def test_captures_are_derived_once(spark, tables, monkeypatch, name):
    calls, to_captures = [], derived.listing.to_captures
    monkeypatch.setattr(derived.listing, "to_captures", lambda *a, **k: calls.append(a) or to_captures(*a, **k))
    assert not QUERIES[name](spark, tables).isEmpty()
    assert len(calls) == 1
