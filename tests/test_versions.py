"""Duplicates, versions and numbering against brute force."""

import random

from tests.conftest import captures_of
from pyspark.sql import functions as F

from palimpsest.operators import fetched, versions


def random_rows(n, seed):
    rng = random.Random(seed)
    hosts = ["http://a.com/", "http://www.a.com/", "https://a.com./", "http://b.com/x", "http://c.com/y?z"]
    rows = []
    for i in rng.sample(range(n * 50), n):
        # one address holds a third of all rows
        url = hosts[0] if rng.random() < 0.34 else rng.choice(hosts) + str(rng.randrange(20))
        rows.append((i, f"2024{rng.randrange(8):04d}", url, rng.choice(["200", "404", "301", "302"])))
    return rows


def brute(rows, keys, mode, skip_first=False):
    first = {}
    for row in sorted(rows):
        first.setdefault((row[1], row[2]), row)
    kept = list(first.values())
    if skip_first:
        kept = [r for r in kept if r[3] not in ("404", "301")]
    if mode == "all":
        return sorted(r[0] for r in kept)
    best = {}
    for row in sorted(kept):
        now = best.get(keys[row[0]])
        better = now is None or (row[1] > now[1] if mode == "last" else row[1] < now[1])
        if better:
            best[keys[row[0]]] = row
    return sorted(r[0] for r in best.values())


def test_versions_against_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(400, seed)
        captures = captures_of(spark, rows).repartition(5).cache()
        keys = {r.scid: r.url_key for r in captures.collect()}
        for mode in versions.MODES:
            for skip in (False, True):
                got = sorted(r.scid for r in versions.keep_versions(captures, mode, skip).collect())
                assert got == brute(rows, keys, mode, skip), (seed, mode, skip)


def test_one_step_equals_two(spark):
    captures = captures_of(spark, random_rows(500, 3))
    for keep in (versions.keep_last, versions.keep_first):
        one, two = keep(captures), keep(versions.dedup_first(captures))
        assert sorted(r.scid for r in one.collect()) == sorted(r.scid for r in two.collect())


def test_numbers_over_sparse_ids(spark):
    # ids as a scan of several partitions gives them, with wide gaps
    ids = [(p << 33) + r * 7 for p in (0, 1, 5, 300) for r in range(50)] + [70_000 * k for k in range(3, 40)]
    ids = sorted(set(ids))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "scid long").repartition(6)
    got = versions.enumerate_captures(df).orderBy("scid").collect()
    assert [r.scid for r in got] == sorted(ids)
    assert [r.counter for r in got] == list(range(1, len(ids) + 1))


def test_numbers_of_nothing(spark):
    assert versions.enumerate_captures(spark.createDataFrame([], "scid long")).count() == 0


def test_first_written_per_path(spark):
    rows = [(i, "hot" if i % 3 else f"p{i}") for i in range(3, 300)]
    df = spark.createDataFrame(rows, "scid long, rel_path string").repartition(7)
    got = {r.scid: r.outcome for r in fetched.write_once(df).collect()}
    seen = set()
    for scid, path in rows:
        assert got[scid] == ("EXISTING" if path in seen else "SUCCESS")
        seen.add(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_take_one_shuffle_and_limit_groups_before_it(spark):
    text = plan(versions.keep_versions(captures_of(spark, random_rows(50, 4)), "last"))
    assert text.count("Exchange hashpartitioning") == 1
    below = text[text.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below and "Partial" in below
    assert "dropDuplicates" not in text and "CartesianProduct" not in text


def test_time_and_status_filters_reach_the_scan(spark, folder, conf):
    from palimpsest.operators import filters
    from palimpsest.sources import listing

    conf(maxMetadataStringLength="10000")
    listing.land_captures(captures_of(spark, random_rows(200, 5)), folder + "/c")
    stored = spark.read.parquet(folder + "/c")
    df = filters.filter_url(filters.filter_time(filters.filter_statuscode(stored, ["200"]), "2024", "20240003"), "a.com")
    text = plan(df.select("scid"))
    pushed = text[text.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "LessThanOrEqual(timestamp" in pushed
    assert "EqualTo(domain,a.com)" in pushed and "statuscode" in pushed
    read = text[text.index("ReadSchema") :]
    assert "digest" not in read and "url_key" not in read


def test_landed_captures_are_spread_and_clustered(spark, folder, conf):
    from palimpsest.sources import listing

    conf(adaptive_enabled="false")
    rows = [(i, f"2024{i:05d}", f"http://one.com/{i}", "200") for i in range(3000)]
    listing.land_captures(captures_of(spark, rows), folder + "/c")
    files = spark.read.parquet(folder + "/c").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4  # one domain, many files
