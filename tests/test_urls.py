"""URL columns on literal addresses."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import paths, urls

KEYS = {
    "example.com": "example.com/index.html",
    "http://www.com/": "www.com/index.html",
    "HTTP://WWW.Example.com.:80/a//b/../c.JPG?x=1#y": "example.com/a//b/%2e%2e/c.JPG%3fx%3d1%23y",
    "http://u:p@h.com/a/./b%20c/d%20e": "h.com/a/%2e/b%20c/d e",
    "https://example.com?q=1/2": "example.com?q=1/2",
    "http://a.com/..": "a.com/%2e%2e",
    "http://a.com/?file=../../../../etc/passwd": "a.com/%3ffile%3d../%2e%2e/%2e%2e/%2e%2e/etc/passwd",
    "/rel/path": "rel/path",
    "": "index.html",
    "http://a.com/x/": "a.com/x/index.html",
    "http://ex.com/é~!|\\<>*:&=": "ex.com/é%7e%21%7c%5c%3c%3e%2a%3a%26%3d",
    "http://": "index.html",
    "http:///a": "a",
    "mailto:x@y.z": "y.z/index.html",
    "http://example.com/?blogger=http://other.com/page": "example.com/%3fblogger%3dhttp",
    "http://a.com/line\nbreak/x\n": "a.com/line\nbreak/x\n",
}


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, url string")
    return [r.v for r in df.select("i", column(F.col("url")).alias("v")).orderBy("i").collect()]


def test_keys(spark):
    assert dict(zip(KEYS, values(spark, KEYS, urls.url_key))) == KEYS


def test_parts_in_steps_equal_single_columns(spark):
    df = spark.createDataFrame([(u,) for u in KEYS], "url string")
    keep = ["domain_raw", "domain", "subdir", "filename_raw", "filename", "url_key"]
    for www in (True, False):
        for embedded in ("cut", "keep"):
            stepped = urls.with_url_parts(df, "url", www, embedded, keep)
            u = F.col("url")
            single = df.select(
                "url",
                urls.url_domain_raw(u, embedded).alias("domain_raw"),
                urls.url_domain(u, www, embedded).alias("domain"),
                urls.url_subdir(u, embedded).alias("subdir"),
                urls.url_filename_raw(u, embedded).alias("filename_raw"),
                urls.url_filename(u, embedded).alias("filename"),
                urls.url_key(u, www, embedded).alias("url_key"),
            )
            assert sorted(stepped.collect()) == sorted(single.collect())


def test_embedded_address_can_be_kept(spark):
    [key] = values(
        spark,
        ["http://example.com/?blogger=http://other.com/page"],
        lambda u: urls.url_key(u, embedded="keep"),
    )
    assert key == "example.com/%3fblogger%3dhttp%3a//other.com/page"
    with pytest.raises(ValueError):
        urls.strip_scheme(F.lit("x"), embedded="drop")


def test_www_can_stay(spark):
    got = values(spark, ["http://www.a.com/", "http://WWW.com./"], lambda u: urls.url_key(u, merge_www=False))
    assert got == ["www.a.com/index.html", "www.com/index.html"]


def test_output_paths(spark):
    keys = ["a.com/index.html", "a.com/a//b/c", "index.html", "a.com/../x", "a.com/x/"]
    plain = values(spark, keys, paths.output_path)
    timed = values(spark, keys, lambda k: paths.output_path(k, F.lit("2024")))
    assert plain == ["a.com/index.html", "a.com/a/b/c", "index.html", "a.com/%2e%2e/x", "a.com/x"]
    assert timed == ["a.com/2024/index.html", "a.com/2024/a/b/c", "index.html/2024", "a.com/2024/%2e%2e/x", "a.com/2024/x"]


def test_extensions(spark):
    names = ["a/b", "a/b.c", "a.b/c", ".rc", "a/.rc", "a/.rc.x", "x.", "a/..b", "a/b.tar.gz"]
    got = values(spark, names, lambda p: paths.add_html_ext(p, F.lit(True)))
    assert got == ["a/b.html", "a/b.c", "a.b/c.html", ".rc.html", "a/.rc.html", "a/.rc.x", "x.", "a/..b.html", "a/b.tar.gz"]


def test_names(spark):
    assert values(spark, ["https://example.com/a?b=c", "..a..", "~!"], paths.sanitize_name) == [
        "https.example.com.a.b.c",
        "a",
        "",
    ]


text = st.text(alphabet=st.sampled_from(list("abAB./:@%20?&=#~!|<>*\\ \n-éwW")), max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(text, min_size=20, max_size=60))
def test_keys_hold_what_paths_need(spark, texts):
    """No key climbs, none holds an encoded character in its folders, none is empty."""
    addresses = ["http://h.com/" + t.replace("://", ":/") for t in texts]
    for key in values(spark, addresses, urls.url_key):
        segments = key.split("/")
        assert segments[0] == "h.com" and segments[-1] != ""
        assert not {".", ".."} & set(segments)
        assert not set(urls.PATH_SPECIALS) & set(key)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abc/.", min_size=1, max_size=20), min_size=20, max_size=40))
def test_key_of_a_plain_key_is_itself(spark, texts):
    keys = values(spark, ["http://h.com/" + t for t in texts], urls.url_key)
    assert values(spark, ["http://" + k for k in keys], urls.url_key) == keys


def test_keys_made_together_equal_single_ones(spark):
    more = ["http://a.com?q=http://b.com/./x/../..", "a/..://b/./://c/..", "://", "http://a.com/.http://../..", "x@y:1?z://w@v:2/u", "http://a.com/é/.?u=ftp://ü/~", None]
    df = spark.createDataFrame([(u,) for u in [*KEYS, *more]], "url string")
    ways = {f"{www}_{e}": (www, e) for www in (True, False) for e in ("cut", "keep")}
    together = urls.with_url_keys(df, ways, "url")
    single = df.select("url", *[urls.url_key(F.col("url"), *way).alias(name) for name, way in ways.items()])
    assert sorted(together.collect(), key=str) == sorted(single.collect(), key=str)
    # the replacements of one address whole, and of the rest of a longer one in either case
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", #, %23)") <= 3
