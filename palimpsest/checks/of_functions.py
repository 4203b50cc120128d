"""Queries over column functions; each runs over whole tables and whole texts."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.checks import derived as d
from palimpsest.checks import oracle as o
from palimpsest.checks.registry import query
from palimpsest.functions import archive, content, paths, report, urls
from palimpsest.schema import NAME_SPECIALS, URL_SPECIALS



def U():
    return F.col("url")


def _over_addresses(name: str, make, sql_columns: str, source: str = "addresses") -> None:
    @query(name, o.stmt(o.ADDRESSED, f"SELECT kind, id, {sql_columns} FROM {source}"))
    def run(spark, sf):
        cols = [c.alias(n) for n, c in make().items()]
        return d.addresses(spark, sf).select("kind", "id", *cols)


_over_addresses(
    "url_strip_scheme",
    lambda: {"cut": urls.strip_scheme(U()), "whole": urls.strip_scheme(U(), "keep")},
    f"{o.bare('url')} AS cut, {o.bare('url', 'keep')} AS whole",
)
_over_addresses("url_domain_raw", lambda: {"domain_raw": urls.url_domain_raw(U())}, f"{o.host(o.bare('url'))} AS domain_raw")
_over_addresses(
    "url_subdir", lambda: {"subdir": urls.url_subdir(U())}, "subdir", o.url_parts("addresses", "url")
)
_over_addresses(
    "url_filename_raw", lambda: {"filename_raw": urls.url_filename_raw(U())}, "filename_raw", o.url_parts("addresses", "url")
)
_over_addresses(
    "url_filename", lambda: {"filename": urls.url_filename(U())}, "filename", o.url_parts("addresses", "url")
)
_over_addresses("pct_encode_special", lambda: {"encoded": urls.pct_encode_special(U())}, f"{o._enc('url')} AS encoded")
_over_addresses("pct_space", lambda: {"spaced": urls.pct_space(U())}, "replace(url, '%20', ' ') AS spaced")
_over_addresses("contain_traversal", lambda: {"contained": urls.contain_traversal(U())}, f"{o._contain('url')} AS contained")
_over_addresses("sanitize_url", lambda: {"clean": paths.sanitize_url(U())}, f"{o._enc('url', URL_SPECIALS)} AS clean")
_over_addresses(
    "sanitize_name",
    lambda: {"name": paths.sanitize_name(U())},
    "array_to_string(list_filter(string_split(translate(url, '{}', '{}'), '.'), lambda x: x <> ''), '.') AS name".format(
        "".join(NAME_SPECIALS).replace("'", "''"), "." * len(NAME_SPECIALS)
    ),
)
_over_addresses(
    "encode_url",
    lambda: {"encoded": archive.encode_url(U())},
    "replace(replace(url_encode(url), '%3A', ':'), '%2F', '/') AS encoded",
)


@query(
    "url_domain",
    o.stmt(
        o.ADDRESSED,
        f"SELECT kind, id, {o.domain_of('h')} AS domain, {o.domain_of('h', False)} AS domain_apart "
        f"FROM (SELECT *, {o.host(o.bare('url'))} AS h FROM addresses)",
    ),
)
def url_domain(spark, sf):
    return d.addresses(spark, sf).select(
        "kind", "id", urls.url_domain(U()).alias("domain"), urls.url_domain(U(), False).alias("domain_apart")
    )


def _brief(kind: str, key: str) -> str:
    return f"CASE WHEN {kind} IN ('document', 'text') THEN md5({key}) ELSE {key} END"


_MERGED = f"(SELECT kind, id, url, url_key AS merged FROM {o.url_parts('addresses', 'url', also='kind, id, url')})"
_APART = f"(SELECT kind, id, url, merged, url_key AS apart FROM {o.url_parts(_MERGED, 'url', merge_www=False, also='kind, id, url, merged')})"


@query(
    "url_key",
    o.stmt(
        o.ADDRESSED,
        f"""SELECT kind, id, {_brief('kind', 'merged')} AS url_key, {_brief('kind', 'apart')} AS key_apart, {_brief('kind', 'url_key')} AS key_whole
        FROM {o.url_parts(_APART, 'url', embedded='keep', also='kind, id, merged, apart')}""",
    ),
)
def url_key(spark, sf):
    """Keys of all addresses in three ways; of those made of whole texts a digest."""
    ways = {"url_key": (True, "cut"), "key_apart": (False, "cut"), "key_whole": (True, "keep")}
    rows = urls.with_url_keys(d.addresses(spark, sf), ways, "url")
    long = F.col("kind").isin("document", "text")
    return rows.select("kind", "id", *[F.when(long, F.md5(k)).otherwise(F.col(k)).alias(k) for k in ways])


@query(
    "url_from_archive",
    o.stmt(
        o.ADDRESSED,
        """SELECT kind, id, CASE WHEN contains(url, 'id_/') THEN split_part(url, 'id_/', 2) END AS origin
        FROM (SELECT kind, id, url FROM addresses UNION ALL SELECT 'archive', scid, url_archive FROM captures)""",
    ),
)
def url_from_archive(spark, sf):
    return _with_archived(spark, sf).select("kind", "id", archive.url_from_archive(U()).alias("origin"))


def _with_archived(spark, sf):
    archived = d.captures(spark, sf).select(
        F.lit("archive").alias("kind"), F.col("scid").alias("id"), F.col("url_archive").alias("url")
    )
    return d.addresses(spark, sf).unionByName(archived)


@query(
    "archive_timestamp",
    o.stmt(
        o.ADDRESSED,
        """SELECT kind, id, CASE WHEN NOT contains(url, 'web/') THEN ''
          WHEN contains(url, 'id_') THEN split_part(split_part(split_part(url, 'web/', 2), '/', 1), 'id_', 1)
          ELSE split_part(split_part(url, 'web/', 2), '/', 1) END AS stamp
        FROM (SELECT kind, id, url FROM addresses UNION ALL SELECT 'archive', scid, url_archive FROM captures)""",
    ),
)
def archive_timestamp(spark, sf):
    return _with_archived(spark, sf).select("kind", "id", archive.archive_timestamp(U()).alias("stamp"))


@query(
    "archive_url",
    o.stmt(
        o.CAPTURED,
        "SELECT line_no, format('https://web.archive.org/web/{}id_/{}', timestamp, url_origin) AS url_archive FROM captures",
    ),
)
def archive_url(spark, sf):
    parsed = d.parsed(spark, sf).where("verdict = 'ok'")
    return parsed.select(
        "line_no", archive.archive_url(F.col("timestamp"), F.col("url_origin")).alias("url_archive")
    )


@query(
    "output_path",
    o.stmt(
        o.ADDRESSED,
        f"""SELECT kind, id,
          array_to_string(list_filter(string_split(k, '/'), lambda g: g <> ''), '/') AS plain,
          array_to_string(list_filter([split_part(k, '/', 1), '20240102030405'] || string_split(k, '/')[2:], lambda g: g <> ''), '/') AS timed
        FROM (SELECT kind, id, {o._contain('url_key')} AS k FROM {o.url_parts('addresses', 'url')})""",
    ),
)
def output_path(spark, sf):
    keyed = urls.with_url_parts(d.addresses(spark, sf), "url")
    key = F.col("url_key")
    return keyed.select(
        "kind",
        "id",
        paths.output_path(key).alias("plain"),
        paths.output_path(key, F.lit("20240102030405")).alias("timed"),
    )


@query(
    "path_too_long",
    o.stmt(o.ADDRESSED, f"SELECT kind, id, length(url_key) > 255 AS too_long FROM {o.url_parts('addresses', 'url')}"),
)
def path_too_long(spark, sf):
    keyed = urls.with_url_parts(d.addresses(spark, sf), "url")
    return keyed.select("kind", "id", paths.path_too_long(F.col("url_key")).alias("too_long"))


@query(
    "valid_link_path",
    o.stmt(
        o.ADDRESSED,
        "SELECT kind, id, url <> '' AND strlen(url) <= 4096 AND list_max(list_transform(string_split(url, '/'), lambda g: strlen(g))) <= 255 AS valid FROM addresses",
    ),
)
def valid_link_path(spark, sf):
    return d.addresses(spark, sf).select("kind", "id", paths.valid_link_path(U()).alias("valid"))


@query("is_html", o.stmt([o.BODIES], r"""SELECT kind, id, regexp_matches(body, '^\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|title|body|script)', 'is') AS html FROM bodies"""))
def is_html(spark, sf):
    return d.bodies(spark, sf).select("kind", "id", content.is_html(F.col("body")).alias("html"))


@query(
    "add_html_ext",
    o.stmt(
        [o.BODIES],
        f"""SELECT kind, id, CASE WHEN html AND NOT (contains(ltrim(base, '.'), '.')) THEN path || '.html' ELSE path END AS path
        FROM (SELECT *, split_part(path, '/', -1) AS base FROM (
          SELECT 'page' AS kind, page_id AS id, url_key AS path, true AS html FROM {o.url_parts('pages', 'url')}
          UNION ALL SELECT 'document', doc_id, lang || '/' || source || '/' || doc_id, false FROM documents))""",
    ),
)
def add_html_ext(spark, sf):
    pages = urls.with_url_parts(d.table(spark, sf, "pages"), "url").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url_key").alias("path"), F.col("html").alias("body")
    )
    texts = d.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("body"),
    )
    both = pages.unionByName(texts)
    return both.select("kind", "id", paths.add_html_ext(F.col("path"), content.is_html(F.col("body"))).alias("path"))


@query(
    "decode_payload",
    o.stmt([o.BODIES], "SELECT kind, id, md5(body) AS body_md5, kind = 'page' OR id % 2 = 1 AS decode_ok FROM bodies"),
)
def decode_payload(spark, sf):
    """Pages come gzipped, every other document says so but is plain; all read the same."""
    @F.arrow_udf(T.BinaryType())
    def pack(bodies: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(b.as_py()) for b in bodies], pa.binary())

    raw = d.bodies(spark, sf).withColumn("body", F.col("body").cast("binary"))
    pages = raw.where("kind = 'page'").withColumn("body", pack("body")).withColumn("encoding", F.lit("gzip"))
    texts = raw.where("kind = 'document'").withColumn("encoding", F.when(F.col("id") % 2 == 0, "gzip"))
    decoded = content.decode_payload(pages.unionByName(texts))
    return decoded.select("kind", "id", F.md5("body").alias("body_md5"), "decode_ok")


@query(
    "preset_response",
    o.stmt(o.CAPTURED, "SELECT line_no, statuscode, CASE statuscode WHEN '301' THEN '301' WHEN '404' THEN '404' END AS response FROM parsed"),
)
def preset_response(spark, sf):
    return d.parsed(spark, sf).select(
        "line_no", "statuscode", archive.preset_response(F.col("statuscode")).alias("response")
    )


@query(
    "status_phrase",
    o.stmt(
        [o.SAVE_LOG, o.phrases()],
        "SELECT event_id, CASE WHEN code0 = 0 THEN 'No Status' ELSE phrase END AS phrase FROM "
        "(SELECT event_id, CASE WHEN status = 429 THEN 0 ELSE status END AS code0 FROM save_log) LEFT JOIN phrases ON code = code0",
    ),
)
def status_phrase(spark, sf):
    code = F.when(F.col("status") != 429, F.col("status"))
    return d.save_log(spark, sf).select("event_id", archive.status_phrase(code).alias("phrase"))


@query(
    "progress_pct",
    """SELECT user_id, n_done, n_all, CASE WHEN n_all > 0 THEN CAST(CAST(round_even(100.0 * n_done / n_all, 0) AS INTEGER) AS VARCHAR) || '%' ELSE '0' END AS progress
    FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_done, count(*) FILTER (event_type <> 'view') AS n_all FROM events GROUP BY user_id)""",
)
def progress_pct(spark, sf):
    per = d.table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") != "error").alias("n_done"),
        F.count_if(F.col("event_type") != "view").alias("n_all"),
    )
    return per.withColumn("progress", report.progress_pct(F.col("n_done"), F.col("n_all")))


@query(
    "progress_text",
    "SELECT event_id, format('{:,}', event_id) || ' / ' || format('{:,}', event_id * 7919) AS progress FROM events",
)
def progress_text(spark, sf):
    e = F.col("event_id")
    return d.table(spark, sf, "events").select("event_id", report.progress_text(e, e * 7919).alias("progress"))


@query(
    "classify_save_response",
    o.stmt(
        [o.SAVE_LOG],
        """SELECT event_id, CASE WHEN status = 302 AND age < 1 THEN 'new' WHEN status = 302 THEN 'existing' WHEN status = 429 THEN 'rate_limited'
          WHEN status = 520 THEN 'job_failed' WHEN status = 404 THEN 'not_found' ELSE 'unhandled' END AS answer,
          CAST(CASE WHEN status = 302 AND age >= 1 THEN greatest(60 - age, 0) END AS VARCHAR) AS wait_minutes
        FROM (SELECT event_id, status, CAST(round_even((epoch(request_ts) - epoch(strptime(left(split_part(location, 'web/', 2), 14), '%Y%m%d%H%M%S'))) / 60.0, 0) AS BIGINT) AS age FROM save_log)""",
    ),
)
def classify_save_response(spark, sf):
    args = [F.col(c) for c in ("status", "location", "request_ts")]
    return d.save_log(spark, sf).select(
        "event_id",
        report.classify_save_response(*args).alias("answer"),
        report.save_wait_minutes(*args).cast("string").alias("wait_minutes"),
    )


# ways a server may state where a page has moved; {} stands for the page's address
LOCATIONS = ["{}", "//cdn.example.org/a/../b", "/top/./x/../y?z=1#f", "sub/../next/", "../up", "?only=query", "#part", ""]


@query(
    "resolve_url",
    o.stmt(
        o.CAPTURED,
        r"""SELECT scid, form, CASE
          WHEN form = 0 THEN url_origin
          WHEN form = 1 THEN 'https://cdn.example.org/a/../b'
          WHEN form = 2 THEN 'https://web.archive.org/top/y?z=1#f'
          WHEN form = 5 THEN split_part(split_part(url_archive, '#', 1), '?', 1) || '?only=query'
          WHEN form = 6 THEN split_part(url_archive, '#', 1) || '#part'
          WHEN form = 7 THEN url_archive
          ELSE 'https://web.archive.org/' || array_to_string(
            CASE form WHEN 3 THEN folders || ['next', ''] ELSE folders[:len(folders) - 1] || ['up'] END, '/') END AS resolved
        FROM (SELECT scid, url_archive, url_origin, unnest(range(8)) AS form, list_filter(string_split(dir, '/'), lambda g: g <> '') AS folders
          FROM (SELECT *, left(p, length(p) - length(split_part(p, '/', -1))) AS dir FROM (
            SELECT *, substr(split_part(split_part(url_archive, '#', 1), '?', 1), 24) AS p FROM captures)))""",
    ),
)
def resolve_url(spark, sf):
    forms = F.array(*[F.col("url_origin") if f == "{}" else F.lit(f) for f in LOCATIONS])
    each = d.captures(spark, sf).select("scid", "url_archive", F.posexplode(forms).alias("form", "location"))
    return each.select(
        "scid",
        F.col("form").cast("long").alias("form"),
        archive.resolve_url(F.col("url_archive"), F.col("location")).alias("resolved"),
    )
