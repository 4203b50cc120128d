"""Every registered query against its SQL counterpart, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from palimpsest.checks import ORACLE, QUERIES
from tools import check

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, SMALL, name)
    assert ok, note


def test_every_query_of_captures_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())


def test_no_query_pairs_everything_with_everything(spark):
    for name in ("capture_job", "resolve_redirects", "path_conflicts", "resolve_links", "capture_funnel"):
        text = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_funnel_of_the_fixture(spark):
    """The funnel known for this listing."""
    row = entry.queries()["capture_funnel"](spark, SMALL).first().asDict()
    assert row == dict(
        total=1100, faulty=6, malformed=5, mailto=12, duplicates=97, versions=925, kept=55, skip_statuscode=20, skip_existing=0, to_utilize=35
    )


def test_entry(spark):
    assert entry.entry(spark).count() == 55
