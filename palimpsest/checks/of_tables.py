"""Queries over sources, filters, joins, windows, reports and jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from palimpsest.checks import derived as d
from palimpsest.checks import oracle as o
from palimpsest.checks.registry import query
from palimpsest.functions import content, urls
from palimpsest.operators import fetched, filters, overlay, report, versions
from palimpsest.plans.job import CaptureJob
from palimpsest.plans.ledger import Ledger
from palimpsest.session import cut_lineage, scratch_path
from palimpsest.sources import listing, results, tree
from palimpsest.sources.buckets import BucketTable

CAPTURE_COLUMNS = ["scid", "timestamp", "url_origin", "url_archive", "url_key", "statuscode", "response"]
CAPTURE_SQL = ", ".join(CAPTURE_COLUMNS)
WORKED_COLUMNS = [*CAPTURE_COLUMNS, "redirect_url", "redirect_timestamp", "file"]
WORKED_SQL = ", ".join(WORKED_COLUMNS)

# ---------------------------------------------------------------- listing


HEADER = '[["timestamp","digest","mimetype","statuscode","original"],'
# Files of the derived listing, at least, and lines of a file.
FILES = 4
LINES_PER_FILE = 250_000
_DIGITS = 6


def listing_files(spark, sf) -> list[str]:
    """The derived listing as folders of one text file, in arrival order, which is that of their names too.

    Each file has a header first, and the last closes with `]]`.
    """
    path = scratch_path(spark, "listing")
    lines = d.listing_lines(spark, sf)
    last = lines.agg(F.max("line_no")).scalar()
    files = max(FILES, -(-lines.count() // LINES_PER_FILE))
    closed = F.when(
        F.col("line_no") == last, F.concat(F.regexp_replace("line", r",\z", ""), F.lit("]"))
    ).otherwise(F.col("line"))
    first_round = lines.where(F.col("line_no") < d.LATER).agg(F.max("line_no")).scalar()
    early = F.floor(F.col("line_no") * (files - 1) / (first_round + 1))
    body = lines.select(
        F.when(F.col("line_no") < d.LATER, early).otherwise(files - 1).alias("file"), "line_no", closed.alias("value")
    )
    headers = spark.range(files).select(
        F.col("id").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.lit(HEADER).alias("value")
    )
    # names of one length, so that they sort like numbers
    named = headers.union(body).withColumn("file", F.lpad(F.col("file").cast("string"), _DIGITS, "0"))
    rows = named.repartition(files, "file").sortWithinPartitions("file", "line_no")
    rows.select("file", "value").write.partitionBy("file").text(path)
    return [f"{path}/file={k:0{_DIGITS}}" for k in range(files)]


@query("scan_cdx", o.stmt(o.LISTING, "SELECT line FROM lines"))
def scan_cdx(spark, sf):
    return listing.scan_listing(spark, listing_files(spark, sf)).select("line")


@query("scan_cdx_order", o.stmt(o.LISTING, "SELECT row_number() OVER (ORDER BY line_no) AS place, line FROM lines"))
def scan_cdx_order(spark, sf):
    """Every line with its place: files by name, lines as they stand in their file."""
    scanned = listing.scan_listing(spark, listing_files(spark, sf))
    stored = cut_lineage(scanned.withColumn("scid", F.col("line_no")), "scanned")
    return versions.enumerate_captures(stored, into="place").select("place", "line")


@query("job_filter_url_apart", o.stmt(o.CAPTURED, "SELECT scid, url_origin FROM captures WHERE domain = 'blog.tionsh.example.net'"))
def job_filter_url_apart(spark, sf):
    """One site in a job that tells www hosts apart: both of its hosts are asked for."""
    job = CaptureJob(url="http://blog.tionsh.example.net/", merge_www=False)
    keyed = urls.with_url_parts(d.parsed(spark, sf), "url_origin", False, keep=("domain", "url_key"))
    return job.captures(job.selected(keyed)).select("scid", "url_origin")


@query("count_cdx_rows", o.stmt(o.LISTING, "SELECT count(*) AS listing_rows FROM raw"))
def count_cdx_rows(spark, sf):
    return listing.count_rows(listing.scan_listing(spark, listing_files(spark, sf)))


@query(
    "parse_cdx",
    o.stmt(o.CAPTURED, "SELECT line_no, timestamp, digest, mimetype, statuscode, url_origin, verdict FROM parsed"),
)
def parse_cdx(spark, sf):
    return d.parsed(spark, sf).drop("line")


@query("quarantine", o.stmt(o.CAPTURED, "SELECT line_no, line, verdict FROM parsed WHERE verdict IN ('faulty', 'malformed')"))
def quarantine(spark, sf):
    return listing.quarantine(d.parsed(spark, sf))


@query("drop_faulty", o.stmt(o.CAPTURED, "SELECT line_no, url_origin FROM parsed WHERE verdict NOT IN ('faulty', 'malformed')"))
def drop_faulty(spark, sf):
    return listing.drop_faulty(d.parsed(spark, sf)).select("line_no", "url_origin")


@query("drop_mailto", o.stmt(o.CAPTURED, "SELECT line_no, url_origin FROM parsed WHERE url_origin NOT ILIKE 'mailto%'"))
def drop_mailto(spark, sf):
    return listing.drop_mailto(d.parsed(spark, sf)).select("line_no", "url_origin")


@query("land_captures", o.stmt(o.CAPTURED, f"SELECT domain, {CAPTURE_SQL} FROM captures"))
def land_captures(spark, sf):
    path = scratch_path(spark, "captures")
    listing.land_captures(d.captures(spark, sf), path)
    return spark.read.parquet(path).select("domain", *CAPTURE_COLUMNS)


# ---------------------------------------------------------------- results, tree, ledger


@query(
    "write_results",
    o.stmt(
        o.WORK,
        "SELECT timestamp, url_archive, url_origin, redirect_url, redirect_timestamp, response, file FROM worked WHERE response IS NOT NULL",
    ),
)
def write_results(spark, sf):
    return results.result_rows(d.worked(spark, sf))


@query(
    "scan_results",
    o.stmt(
        [*o.DISTINCTS, o.EARLIER],
        "SELECT timestamp, url_archive, url_origin, redirect_url, redirect_timestamp, response, file FROM earlier",
    ),
)
def scan_results(spark, sf):
    path = scratch_path(spark, "results")
    results.write_results(d.earlier_results(spark, sf), path)
    return results.scan_results(spark, path).drop("src_file", "csv_line")


@query(
    "write_snapshot_tree",
    o.stmt([*o.KEPT, o.NARROW_PAYLOADS], "SELECT domain, url_key AS rel_path, body_md5 FROM kept JOIN payloads USING (url_archive)"),
)
def write_snapshot_tree(spark, sf):
    path = scratch_path(spark, "tree")
    chosen = cut_lineage(d.kept(spark, sf), "kept")
    asked = cut_lineage(chosen.select("url_archive").distinct(), "asked")
    payloads = fetched.possibly_among(d.payloads(spark, sf), "url_archive", asked)
    kept = content.decode_payload(chosen.join(payloads, "url_archive"))
    tree.write_snapshot_tree(kept.withColumn("rel_path", F.col("url_key")), path)
    stored = spark.read.schema("domain string, rel_path string, body binary").parquet(path)
    return stored.select("domain", "rel_path", F.md5("body").alias("body_md5"))


@query(
    "stage_ledger",
    o.stmt(
        o.KEPT,
        """SELECT 'captures' AS stage, true AS done, count(*) AS rows, 2 AS asked, 1 AS built FROM captures
        UNION ALL SELECT 'versions', true, count(*), 2, 1 FROM kept""",
    ),
)
def stage_ledger(spark, sf):
    """Every stage is asked for twice and built once."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"), CaptureJob().job_id)
    built = {"captures": 0, "versions": 0}

    def stage(name, build):
        def counted():
            built[name] += 1
            return build()

        return ledger.run_stage(name, counted)

    for _ in range(2):
        captures = stage("captures", lambda: d.captures(spark, sf))
        stage("versions", lambda: versions.keep_versions(captures, "last"))
    times = F.create_map(*[F.lit(v) for pair in built.items() for v in pair])
    return ledger.entries().select(
        "stage", "done", "rows", F.lit(2).alias("asked"), F.element_at(times, F.col("stage")).alias("built")
    )


# ---------------------------------------------------------------- filters


def _filtered(name: str, sql_where: str, fn) -> None:
    @query(name, o.stmt(o.CAPTURED, f"SELECT {CAPTURE_SQL} FROM captures WHERE {sql_where}"))
    def run(spark, sf):
        return fn(d.captures(spark, sf)).select(*CAPTURE_COLUMNS)


_filtered(
    "filter_time",
    "timestamp >= '20240105' AND left(timestamp, 8) <= '20240120'",
    lambda df: filters.filter_time(df, "20240105", "20240120"),
)
_filtered("filter_statuscode", "statuscode IN ('200', '302')", lambda df: filters.filter_statuscode(df, ["200", "302"]))
_filtered(
    "filter_filetype",
    "ends_with(url_origin, '.html') OR ends_with(url_origin, '.css')",
    lambda df: filters.filter_filetype(df, ["HTML", "css"]),
)


@query(
    "filter_range",
    o.stmt(
        o.CAPTURED,
        f"""SELECT {CAPTURE_SQL} FROM (SELECT * REPLACE (CAST(left(timestamp, 4) AS INTEGER) - scid % 5 || substr(timestamp, 5) AS timestamp)
          FROM captures) WHERE CAST(left(timestamp, 4) AS INTEGER) >= 2023""",
    ),
)
def filter_range(spark, sf):
    """Captures dealt over five years, of which the cut leaves some."""
    year = F.left("timestamp", F.lit(4)).cast("int") - F.col("scid") % 5
    dealt = d.captures(spark, sf).withColumn("timestamp", F.concat(year.cast("string"), F.substr("timestamp", F.lit(5))))
    return filters.filter_range(dealt, 2, date(2025, 6, 1)).select(*CAPTURE_COLUMNS)


_SITE = "blog.tionsh.example.net"
_canon = f"domain || rtrim({o.path('split_part(url_origin, chr(58) || chr(47) || chr(47), 2)')}, '/')"
_filtered(
    "filter_url",
    f"{_canon} = '{_SITE}/es' OR starts_with({_canon}, '{_SITE}/es/')",
    lambda df: filters.filter_url(df, f"http://www.{_SITE}/es/"),
)
_filtered("unhandled", "response IS NULL", filters.unhandled)
_filtered("handled", "response IS NOT NULL", filters.handled)
_filtered("skip_statuscode", "response IN ('404', '301')", filters.skip_statuscode)


@query(
    "limit_captures",
    o.stmt(o.CAPTURED, "SELECT 'part-' || line_no % 3 AS src_file, line_no, line FROM parsed ORDER BY 1, line_no LIMIT 100"),
)
def limit_captures(spark, sf):
    """The first lines of a listing of three files, which begin in another order than they are named."""
    file = F.concat(F.lit("part-"), (F.col("line_no") % 3).cast("string"))
    return filters.limit_captures(d.parsed(spark, sf).withColumn("src_file", file), 100).select("src_file", "line_no", "line")


@query("succeeded", o.stmt(o.WORK, f"SELECT {WORKED_SQL} FROM worked WHERE file IS NOT NULL AND file <> ''"))
def succeeded(spark, sf):
    return filters.succeeded(d.worked(spark, sf)).select(*WORKED_COLUMNS)


@query("failed", o.stmt(o.WORK, f"SELECT {WORKED_SQL} FROM worked WHERE file IS NULL OR file = ''"))
def failed(spark, sf):
    return filters.failed(d.worked(spark, sf)).select(*WORKED_COLUMNS)


@query(
    "release_locked",
    o.stmt(o.CAPTURED, "SELECT scid, CASE WHEN statuscode = '302' THEN NULL ELSE response END AS response FROM captures"),
)
def release_locked(spark, sf):
    busy = F.when(F.col("statuscode") == "302", "LOCK").otherwise(F.col("response"))
    return filters.release_locked(d.captures(spark, sf).withColumn("response", busy)).select("scid", "response")


# ---------------------------------------------------------------- duplicates, versions, numbers


@query("dedup_first", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures"))
def dedup_first(spark, sf):
    return d.distinct_captures(spark, sf).select(*CAPTURE_COLUMNS)


@query("distinct_captures", o.stmt(o.CAPTURED, "SELECT count(DISTINCT (timestamp, url_origin)) AS captures, count(*) - count(DISTINCT (timestamp, url_origin)) AS duplicates FROM captures"))
def distinct_captures(spark, sf):
    per = d.captures(spark, sf).groupBy("timestamp", "url_origin").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("captures"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("keep_last", o.stmt(o.KEPT, f"SELECT {CAPTURE_SQL} FROM kept"))
def keep_last(spark, sf):
    return d.kept(spark, sf, "last").select(*CAPTURE_COLUMNS)


@query("keep_first", o.stmt([*o.DISTINCTS, o.kept_cte("first")], f"SELECT {CAPTURE_SQL} FROM kept"))
def keep_first(spark, sf):
    return d.kept(spark, sf, "first").select(*CAPTURE_COLUMNS)


@query("keep_all", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures"))
def keep_all(spark, sf):
    return d.kept(spark, sf, "all").select(*CAPTURE_COLUMNS)


@query(
    "keep_semi",
    o.stmt(
        o.KEPT,
        f"SELECT {CAPTURE_SQL} FROM distinct_captures WHERE scid NOT IN (SELECT scid FROM kept)",
    ),
)
def keep_semi(spark, sf):
    """Versions that lose against a later one: what the version filter removes."""
    distinct = cut_lineage(d.distinct_captures(spark, sf), "distinct")
    winners = versions.keep_last(distinct).select("scid")
    return distinct.join(winners, "scid", "left_anti").select(*CAPTURE_COLUMNS)


@query(
    "skip_first",
    o.stmt(
        o.DISTINCTS,
        f"""SELECT {CAPTURE_SQL} FROM distinct_captures WHERE response IS NULL
        QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY timestamp DESC, scid) = 1""",
    ),
)
def skip_first(spark, sf):
    return versions.keep_versions(d.captures(spark, sf), "last", skip_first=True).select(*CAPTURE_COLUMNS)


@query("enumerate_captures", o.stmt(o.DISTINCTS, "SELECT scid, url_archive, row_number() OVER (ORDER BY scid) AS counter FROM distinct_captures"))
def enumerate_captures(spark, sf):
    stored = cut_lineage(d.distinct_captures(spark, sf), "versions")
    return versions.enumerate_captures(stored).select("scid", "url_archive", "counter")


@query("order_by_scid", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures ORDER BY scid"))
def order_by_scid(spark, sf):
    return versions.order_by_scid(d.distinct_captures(spark, sf)).select(*CAPTURE_COLUMNS)


# ---------------------------------------------------------------- earlier runs


def _earlier_table(spark, sf):
    return d.distinct_captures(spark, sf).where(F.col("timestamp") < d.EARLIER_RUN)


@query("anti_existing", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures WHERE NOT timestamp < '{d.EARLIER_RUN}'"))
def anti_existing(spark, sf):
    new = d.distinct_captures(spark, sf)
    return overlay.anti_existing(new, _earlier_table(spark, sf)).select(*CAPTURE_COLUMNS)


@query("append_new", o.stmt(o.DISTINCTS, f"SELECT {CAPTURE_SQL} FROM distinct_captures"))
def append_new(spark, sf):
    new = d.distinct_captures(spark, sf)
    return overlay.append_new(new, _earlier_table(spark, sf)).select(*CAPTURE_COLUMNS)


@query("overlay_results", o.stmt(o.WORK, f"SELECT {WORKED_SQL} FROM worked"))
def overlay_results(spark, sf):
    return d.worked(spark, sf).select(*WORKED_COLUMNS)


@query("overlay_update", o.stmt(o.WORK, f"SELECT {WORKED_SQL} FROM worked"))
def overlay_update(spark, sf):
    """Results laid over a stored table in place, first those of half of the rows, then all."""
    empty = {c: F.lit(None).cast("string") for c in ("redirect_url", "redirect_timestamp", "file")}
    rows = d.distinct_captures(spark, sf).withColumns(empty).select(*WORKED_COLUMNS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = BucketTable(spark, scratch_path(spark, "captures"), rows.schema, ["timestamp", "url_origin"], buckets)
    table.prepare(0, rows)
    table.replay(0)
    # of the rows as they are stored, so that no capture is derived twice
    earlier = cut_lineage(d.results_of(table.read()), "earlier")
    overlay.overlay_update(table, earlier.where(F.col("csv_line") % 2 == 0), 1)
    overlay.overlay_update(table, earlier, 2)
    return table.read().select(*WORKED_COLUMNS)


@query(
    "overlay_counts",
    o.stmt(
        [*o.KEPT, o.EARLIER],
        """SELECT (SELECT count(*) FROM earlier) AS csv_rows,
        (SELECT count(*) FROM kept WHERE (timestamp, url_origin) IN (SELECT (timestamp, url_origin) FROM earlier)) AS matched_rows""",
    ),
)
def overlay_counts(spark, sf):
    return overlay.overlay_counts(d.kept(spark, sf), d.earlier_results(spark, sf))


# outcomes of open kept captures, without redirects
_PLAIN = f"""plain AS (
  SELECT w.*, p.status, p.location, p.body FROM worked w JOIN payloads p ON p.url_archive = w.url_archive WHERE w.response IS NULL)"""


@query(
    "apply_outcomes",
    o.stmt(
        [*o.WORK, o.PAYLOADS, _PLAIN],
        f"""SELECT w.* EXCLUDE (line_no, digest, mimetype, domain, response, file), coalesce(CAST(p.status AS VARCHAR), w.response) AS response,
          coalesce(CASE WHEN p.status = 200 THEN p.url_key END, w.file) AS file
        FROM worked w LEFT JOIN plain p USING (scid)""",
    ),
)
def apply_outcomes(spark, sf):
    everyone, distinct = d.derived_once(spark, sf)
    worked = cut_lineage(d.worked_of(distinct), "worked")
    joined = fetched.attach_payloads(worked, d.payloads_of(spark, sf, everyone, distinct).drop("body"))
    good = F.col("status") == 200
    outcomes = joined.select(
        "scid", F.col("status").cast("string").alias("response"), F.when(good, F.col("url_key")).alias("file")
    )
    return overlay.apply_outcomes(worked, outcomes).select(*WORKED_COLUMNS)


# ---------------------------------------------------------------- payloads, redirects, layout


@query(
    "attach_payloads",
    o.stmt(
        [*o.WORK, o.NARROW_PAYLOADS],
        """SELECT w.scid, w.url_archive, w.response, p.status IS NOT NULL AS fetched, CAST(p.status AS VARCHAR) AS status,
          p.location, p.body_md5
        FROM worked w LEFT JOIN payloads p ON p.url_archive = w.url_archive AND w.response IS NULL""",
    ),
)
def attach_payloads(spark, sf):
    everyone, distinct = d.derived_once(spark, sf)
    worked = cut_lineage(d.worked_of(distinct), "worked")
    joined = content.decode_payload(fetched.attach_payloads(worked, d.payloads_of(spark, sf, everyone, distinct)))
    return joined.select(
        "scid",
        "url_archive",
        "response",
        F.col("status").isNotNull().alias("fetched"),
        F.col("status").cast("string").alias("status"),
        "location",
        F.md5("body").alias("body_md5"),
    )


# A location is a whole archive address or rooted, `/web/<ts>id_/moved/../gone?to=<digest>`.
_ABSOLUTE = (
    "CASE WHEN starts_with({0}, '/') THEN 'https://web.archive.org' || replace({0}, '/moved/../', '/') ELSE {0} END"
)
_STAMP = "CASE WHEN contains({0}, 'web/') THEN left(split_part({0}, 'web/', 2), 14) ELSE '' END"
TRAILS = f"""walk AS (
  SELECT d.scid, d.url_archive AS redirect_url, 1 AS request, {_ABSOLUTE.format('p.location')} AS next,
    d.url_archive AS visited, p.status AS final_status
  FROM distinct_captures d JOIN payloads p USING (url_archive) WHERE p.status = 302
  UNION ALL
  SELECT w.scid, w.redirect_url, w.request + 1, {_ABSOLUTE.format('p.location')}, w.next, p.status
  FROM walk w LEFT JOIN (SELECT url_archive, status, location FROM payloads) p ON p.url_archive = w.next
  WHERE w.request < {fetched.REDIRECT_REQUESTS} AND w.next IS NOT NULL),
trails AS (
  SELECT scid, redirect_url, {_STAMP.format("arg_max(next, request) FILTER (next IS NOT NULL)")} AS redirect_timestamp,
    arg_max(visited, request) AS redirect_target, max(request) - 1 AS hops,
    last(final_status ORDER BY request) AS final_status
  FROM walk GROUP BY scid, redirect_url)"""


@query(
    "payload_index",
    o.stmt(
        [*o.DISTINCTS, o.NARROW_PAYLOADS],
        "SELECT url_archive, CAST(status AS VARCHAR) AS status, location, is_html FROM payloads",
    ),
)
def payload_index(spark, sf):
    index = fetched.payload_index(d.payloads(spark, sf))
    return index.withColumn("status", F.col("status").cast("string"))


@query(
    "resolve_redirects",
    o.stmt(
        [*o.DISTINCTS, o.PAYLOADS, TRAILS],
        """SELECT scid, redirect_url, redirect_timestamp, redirect_target, CAST(hops AS BIGINT) AS hops,
          CAST(final_status AS VARCHAR) AS final_status FROM trails""",
        recursive=True,
    ),
)
def resolve_redirects(spark, sf):
    index = d.payload_index(spark, sf)
    attached = d.distinct_captures(spark, sf).select("scid", "url_archive").join(index, "url_archive")
    trails = fetched.resolve_redirects(attached, index).drop("final_html")
    return trails.withColumn("hops", F.col("hops").cast("long")).withColumn(
        "final_status", F.col("final_status").cast("string")
    )


# Lines of 41 redirect to the next one; every fifth run of them leads back to its beginning.
_RUN, _ROUND = 41, 5
CHAINED = f"""chained AS MATERIALIZED (
  SELECT a.url_archive, CASE WHEN a.scid % {_RUN} = {_RUN - 1} AND a.scid // {_RUN} % {_ROUND} <> 0 THEN 200 ELSE 302 END AS status,
    CASE WHEN a.scid % {_RUN} = {_RUN - 1} AND a.scid // {_RUN} % {_ROUND} <> 0 THEN NULL ELSE b.url_archive END AS location
  FROM distinct_captures a LEFT JOIN (SELECT scid, url_archive FROM captures WHERE scid < {d.LATER}) b
    ON b.scid = CASE WHEN a.scid % {_RUN} = {_RUN - 1} THEN a.scid - {_RUN - 1} ELSE a.scid + 1 END)"""


def _chained(spark, sf):
    """An index whose redirects make long chains and loops."""
    found = d.distinct_captures(spark, sf).select("scid", "url_archive")
    ahead = d.captures(spark, sf).where(F.col("scid") < d.LATER).select(F.col("scid").alias("__to"), F.col("url_archive").alias("location"))
    last = F.col("scid") % _RUN == _RUN - 1
    ends = last & (F.floor(F.col("scid") / _RUN) % _ROUND != 0)
    led = found.withColumn("__to", F.when(last, F.col("scid") - (_RUN - 1)).otherwise(F.col("scid") + 1)).join(ahead, "__to", "left")
    return cut_lineage(
        led.select(
            "scid", "url_archive", F.when(ends, 200).otherwise(302).alias("status"), F.when(~ends, F.col("location")).alias("location")
        ),
        "chained",
    )


@query(
    "resolve_redirects_deep",
    o.stmt(
        [
            *o.DISTINCTS,
            CHAINED,
            """walk AS (
  SELECT url_archive AS start, [url_archive] AS seen, location AS next FROM chained WHERE status = 302 AND location IS NOT NULL
  UNION ALL
  SELECT w.start, list_append(w.seen, w.next), c.location
  FROM walk w LEFT JOIN (SELECT * FROM chained WHERE status = 302) c ON c.url_archive = w.next
  WHERE w.next IS NOT NULL AND NOT list_contains(w.seen, w.next))""",
            """ends AS (
  SELECT start, seen, next FROM walk WHERE next IS NULL OR list_contains(seen, next))""",
        ],
        """SELECT d.scid, e.start AS redirect_url, CASE WHEN next IS NULL THEN seen[-1] ELSE start END AS redirect_target,
          CASE WHEN next IS NULL THEN len(seen) - 1 END AS hops,
          CASE WHEN next IS NOT NULL THEN list_min(seen[list_position(seen, next):]) END AS loop, CAST(c.status AS VARCHAR) AS final_status
        FROM ends e JOIN distinct_captures d ON d.url_archive = e.start
        LEFT JOIN chained c ON c.url_archive = CASE WHEN next IS NULL THEN seen[-1] ELSE start END""",
        recursive=True,
    ),
)
def resolve_redirects_deep(spark, sf):
    """Redirects of forty hops and in circles, followed to their ends."""
    index = _chained(spark, sf)
    found = fetched.resolve_redirects_fully(index, index.drop("scid"))
    return found.withColumn("final_status", F.col("final_status").cast("string"))


def _files_sql(name: str = "files") -> str:
    """Keys of all pages and, as files, the folders they lie in."""
    return f"""{name} AS (
      SELECT page_id * 2 AS scid, url_key AS rel_path, true AS is_html FROM {o.url_parts('pages', 'url')}
      UNION ALL
      SELECT page_id * 2 + 1, left(url_key, length(url_key) - length(split_part(url_key, '/', -1)) - 1), page_id % 2 = 0
      FROM {o.url_parts('pages', 'url')})"""


def _files(spark, sf):
    keyed = urls.with_url_parts(d.table(spark, sf, "pages").select("page_id", "url"), "url")
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("scid"), F.col("url_key").alias("rel_path"), F.lit(True).alias("is_html")),
        F.struct(
            (F.col("page_id") * 2 + 1).alias("scid"),
            F.regexp_replace("url_key", r"/[^/]*\z", "").alias("rel_path"),
            (F.col("page_id") % 2 == 0).alias("is_html"),
        ),
    )
    return keyed.select(F.inline(both))


_FOLDERS = """folders AS (
  SELECT DISTINCT array_to_string(parts[:n], '/') AS rel_path FROM (
    SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(rel_path, '/') AS parts FROM files)))"""


@query("path_conflicts", o.stmt([_files_sql(), _FOLDERS], "SELECT rel_path FROM files INTERSECT SELECT rel_path FROM folders"))
def path_conflicts(spark, sf):
    return fetched.path_conflicts(_files(spark, sf))


@query(
    "settle_conflicts",
    o.stmt(
        [_files_sql(), _FOLDERS],
        """SELECT scid, is_html, CASE WHEN rel_path IN (SELECT rel_path FROM folders)
          THEN rel_path || '/' || CASE WHEN is_html THEN 'index.html' ELSE split_part(rel_path, '/', -1) END
          ELSE rel_path END AS rel_path FROM files""",
    ),
)
def settle_conflicts(spark, sf):
    return fetched.settle_conflicts(_files(spark, sf))


@query(
    "write_once",
    o.stmt(
        o.DISTINCTS,
        """SELECT scid, url_key AS rel_path, CASE WHEN row_number() OVER (PARTITION BY url_key ORDER BY scid) = 1 THEN 'SUCCESS' ELSE 'EXISTING' END AS outcome
        FROM distinct_captures""",
    ),
)
def write_once(spark, sf):
    files = d.distinct_captures(spark, sf).select("scid", F.col("url_key").alias("rel_path"))
    return fetched.write_once(files)


@query(
    "flag_long_paths",
    o.stmt(o.DISTINCTS, "SELECT scid, length('/srv/captures/' || url_key) > 60 AS too_long FROM distinct_captures"),
)
def flag_long_paths(spark, sf):
    files = d.distinct_captures(spark, sf).withColumn("rel_path", F.col("url_key"))
    return fetched.flag_long_paths(files, 60, "/srv/captures/").select("scid", "too_long")


# ---------------------------------------------------------------- outcomes and whole jobs


def outcome_ctes(base: str, mode: str) -> list[str]:
    """Outcomes of the open captures in ``base``, redirects followed; its files are taken."""
    taken = (
        "SELECT file AS rel_path FROM worked WHERE file IS NOT NULL"
        if base == "worked"
        else "SELECT url_key AS rel_path FROM captures WHERE false"
    )
    place = (
        "url_key"
        if mode != "all"
        else "split_part(url_key, '/', 1) || '/' || timestamp || '/' || array_to_string(string_split(url_key, '/')[2:], '/')"
    )
    return [
        f"""todo AS (
  SELECT b.scid, b.timestamp, b.url_origin, b.url_archive, b.url_key, p.status, t.redirect_url, t.redirect_timestamp, t.redirect_target,
    CASE WHEN t.scid IS NULL THEN p.status ELSE t.final_status END AS final_status
  FROM {base} b JOIN payloads p ON p.url_archive = b.url_archive LEFT JOIN trails t ON t.scid = b.scid
  WHERE b.response IS NULL)""",
        f"""good AS (
  SELECT scid, CASE WHEN contains(ltrim(split_part(place, '/', -1), '.'), '.') THEN place ELSE place || '.html' END AS rel_path
  FROM (SELECT scid, array_to_string(list_filter(string_split({place}, '/'), lambda g: g <> ''), '/') AS place
    FROM todo WHERE final_status = 200))""",
        f"""taken AS ({taken}),
folders AS (
  SELECT DISTINCT array_to_string(parts[:n], '/') AS rel_path FROM (
    SELECT parts, unnest(range(1, len(parts))) AS n FROM (
      SELECT string_split(rel_path, '/') AS parts FROM (SELECT rel_path FROM good UNION ALL SELECT rel_path FROM taken))))""",
        """settled AS (
  SELECT scid, CASE WHEN rel_path IN (SELECT rel_path FROM folders) THEN rel_path || '/index.html' ELSE rel_path END AS rel_path FROM good)""",
        """outcomes AS (
  SELECT t.*, s.rel_path AS file, CASE WHEN s.rel_path IS NULL THEN 'UNKNOWN'
    WHEN row_number() OVER (PARTITION BY s.rel_path ORDER BY t.scid) = 1 AND s.rel_path NOT IN (SELECT rel_path FROM taken)
    THEN 'SUCCESS' ELSE 'EXISTING' END AS outcome
  FROM todo t LEFT JOIN settled s ON s.scid = t.scid)""",
    ]


OUTCOME_COLUMNS = "scid, timestamp, url_origin, redirect_url, redirect_timestamp, CAST(status AS VARCHAR) AS response, CAST(final_status AS VARCHAR) AS final_status, outcome, file"


def _outcomes(spark, sf, mode="all"):
    job = CaptureJob(mode=mode)
    rows = cut_lineage(job.overlaid(d.kept(spark, sf, mode)), "kept")
    return job.outcomes(rows, d.payload_index(spark, sf))


@query(
    "outcome",
    o.stmt([*o.DISTINCTS, o.PAYLOADS, TRAILS, *outcome_ctes("distinct_captures", "all")], f"SELECT {OUTCOME_COLUMNS} FROM outcomes", recursive=True),
)
def outcome(spark, sf):
    """Every version with a file of its own: stored, moved, or not to be had."""
    return _outcomes(spark, sf).select(
        "scid",
        "timestamp",
        "url_origin",
        "redirect_url",
        "redirect_timestamp",
        "response",
        F.col("final_status").cast("string").alias("final_status"),
        "outcome",
        "file",
    )


@query(
    "outcome_line",
    o.stmt(
        [*o.DISTINCTS, o.PAYLOADS, TRAILS, *outcome_ctes("distinct_captures", "all")],
        """SELECT counter, counter || '/' || (SELECT count(*) FROM outcomes) || ' - ' || outcome || ' - ' || timestamp || ' - ' || url_origin AS line
        FROM (SELECT *, row_number() OVER (ORDER BY scid) AS counter FROM outcomes)""",
        recursive=True,
    ),
)
def outcome_line(spark, sf):
    rows = _outcomes(spark, sf).select("scid", "timestamp", "url_origin", "outcome")
    rows = cut_lineage(rows, "outcomes")
    return report.outcome_lines(versions.enumerate_captures(rows))


_FINISHED = """SELECT w.timestamp, w.url_origin, w.url_archive, w.url_key,
  coalesce(q.redirect_url, w.redirect_url) AS redirect_url, coalesce(q.redirect_timestamp, w.redirect_timestamp) AS redirect_timestamp,
  coalesce(CAST(q.status AS VARCHAR), w.response) AS response, coalesce(q.file, w.file) AS file
FROM worked w LEFT JOIN outcomes q ON q.scid = w.scid"""
FINISHED_COLUMNS = [
    "timestamp", "url_origin", "url_archive", "url_key", "redirect_url", "redirect_timestamp", "response", "file"
]


def finished_sql(mode: str) -> str:
    ctes = [*o.DISTINCTS, o.kept_cte(mode), o.EARLIER, o.worked_cte("kept"), o.PAYLOADS, TRAILS]
    return o.stmt([*ctes, *outcome_ctes("worked", mode)], _FINISHED, recursive=True)


def _finished(name: str, mode: str) -> None:
    @query(name, finished_sql(mode))
    def run(spark, sf):
        """A whole run: listing, versions, earlier results, payloads, redirects, files."""
        job = CaptureJob(mode=mode)
        kept = job.versions(job.captures(job.selected(d.parsed(spark, sf))))
        rows = cut_lineage(job.overlaid(kept, d.earlier_results(spark, sf)), "overlaid")
        done = job.outcomes(rows, d.payload_index(spark, sf))
        return overlay.apply_outcomes(rows, done).select(*FINISHED_COLUMNS)


_finished("capture_job", "last")
_finished("capture_job_first", "first")


@query("capture_run", finished_sql("last"))
def capture_run(spark, sf):
    """The same run from files to files: text in, stage tables, result file and tree out.

    A job takes one payload per address. The SQL joins those of all pages that share one: a capture then comes
    once per payload, and one that is stored once per payload and place.
    """
    earlier = scratch_path(spark, "results")
    ordered = d.earlier_results(spark, sf).orderBy("csv_line").drop("csv_line")
    results.write_results(ordered, earlier)
    payloads = cut_lineage(d.payloads(spark, sf, "address"), "payloads")
    tables = CaptureJob(mode="last").run(
        spark, listing_files(spark, sf), scratch_path(spark, "run"), payloads, earlier
    )
    digest = F.upper(F.md5("url")).alias("digest")
    shared = d.table(spark, sf, "pages").groupBy(digest).agg(F.count("*").cast("int").alias("n")).where("n > 1")
    done = tables.outcomes.select("scid", F.col("file").isNotNull().alias("stored"))
    times = F.when(F.col("n").isNull() | F.col("stored").isNull(), 1).when(F.col("stored"), F.col("n") * F.col("n"))
    rows = tables.final.join(done, "scid", "left").join(shared, "digest", "left")
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), times.otherwise(F.col("n")))))
    return rows.select(*FINISHED_COLUMNS)


RESUMED = ["timestamp", "url_origin", "url_archive", "url_key", "statuscode", "response"]


@query("capture_resume", o.stmt(o.KEPT, f"SELECT {', '.join(RESUMED)} FROM kept"))
def capture_resume(spark, sf):
    """A run over half of a listing's files, then one over all: the versions are those of a single run."""
    files, root = listing_files(spark, sf), scratch_path(spark, "run")
    CaptureJob().run(spark, files[: len(files) // 2], root)
    return CaptureJob().run(spark, files, root).versions.select(*RESUMED)


@query(
    "stored_files",
    o.stmt(
        [*o.DISTINCTS, o.kept_cte("last"), o.PAYLOADS, TRAILS, *outcome_ctes("kept", "last")],
        """SELECT split_part(o.file, '/', 1) AS domain, o.file AS rel_path, o.timestamp, md5(p.body) AS body_md5
        FROM outcomes o JOIN payloads p ON p.url_archive = coalesce(o.redirect_target, o.url_archive) WHERE o.outcome = 'SUCCESS'""",
        recursive=True,
    ),
)
def stored_files(spark, sf):
    done = cut_lineage(_outcomes(spark, sf, "last"), "outcomes")
    goals = cut_lineage(done.where("outcome = 'SUCCESS'").select("body_address").distinct(), "goals")
    bodies = cut_lineage(fetched.wanted_bodies(d.payloads(spark, sf), goals), "bodies")
    files = fetched.stored_files(done, bodies)
    return files.select("domain", "rel_path", "timestamp", F.md5("body").alias("body_md5"))


# ---------------------------------------------------------------- reports

_COUNTS = {
    "count_total": ("total", "count(*)"),
    "count_handled": ("handled", "count(response)"),
    "count_unhandled": ("unhandled", "count(*) - count(response)"),
    "count_success": ("success", "count(nullif(file, ''))"),
    "count_fail": ("fail", "count(*) - count(nullif(file, ''))"),
}


def _counted(name: str, column: str, sql: str) -> None:
    @query(name, o.stmt(o.WORK, f"SELECT {sql} AS {column} FROM worked"))
    def run(spark, sf):
        return report.counts(d.worked(spark, sf)).select(column)


for _name, (_column, _sql) in _COUNTS.items():
    _counted(_name, _column, _sql)


@query("counts", o.stmt(o.WORK, "SELECT " + ", ".join(f"{s} AS {c}" for c, s in _COUNTS.values()) + " FROM worked"))
def counts(spark, sf):
    return report.counts(d.worked(spark, sf))


@query(
    "job_status",
    o.stmt(
        o.WORK,
        """SELECT 'download' AS task, count(response) AS current, count(*) AS total,
        CAST(CAST(round_even(100.0 * count(response) / count(*), 0) AS INTEGER) AS VARCHAR) || '%' AS progress FROM worked""",
    ),
)
def job_status(spark, sf):
    return report.job_status(d.worked(spark, sf), "download")


@query("job_summary", o.stmt(o.WORK, "SELECT count(nullif(file, '')) AS downloaded, count(*) - count(nullif(file, '')) AS skipped FROM worked"))
def job_summary(spark, sf):
    return report.job_summary(d.worked(spark, sf))


def _funnel_sql(mode: str, skip_first: bool = False, rerun: bool = False) -> str:
    kept = "distinct_captures" if mode == "all" else "kept"
    ctes = o.DISTINCTS if mode == "all" else [*o.DISTINCTS, o.kept_cte(mode)]
    existing = "0"
    if rerun:
        ctes = [*ctes, o.EARLIER, o.worked_cte(kept)]
        existing = "(SELECT count(*) FROM worked WHERE response IS NOT NULL AND statuscode NOT IN ('301', '404'))"
    if skip_first:
        kept = "(SELECT * FROM distinct_captures WHERE response IS NULL QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY timestamp DESC, scid) = 1)"
    aside = "(SELECT count(response) FROM distinct_captures)" if skip_first else "0"
    return o.stmt(
        ctes,
        f"""SELECT *, kept - skip_statuscode + {aside} - skip_existing AS to_utilize FROM (
        SELECT (SELECT count(*) FROM raw) AS total,
          (SELECT count(*) FROM parsed WHERE verdict = 'faulty') AS faulty,
          (SELECT count(*) FROM parsed WHERE verdict = 'malformed') AS malformed,
          (SELECT count(*) FROM parsed WHERE verdict = 'mailto') AS mailto,
          (SELECT count(*) FROM captures) - (SELECT count(*) FROM distinct_captures) AS duplicates,
          (SELECT count(*) FROM distinct_captures) - (SELECT count(*) FROM {kept}) - {aside} AS versions,
          (SELECT count(*) FROM {kept}) AS kept,
          (SELECT count(response) FROM {kept}) + {aside} AS skip_statuscode, {existing} AS skip_existing)""",
    )


def _funnel(name: str, mode: str, skip_first: bool = False) -> None:
    @query(name, _funnel_sql(mode, skip_first))
    def run(spark, sf):
        lines = cut_lineage(urls.with_url_parts(d.parsed(spark, sf)), "lines")
        return report.capture_funnel(lines, mode, skip_first)

    @query(name.replace("funnel", "funnel_once"), _funnel_sql(mode, skip_first))
    def once(spark, sf):
        return report.capture_funnel_once(urls.with_url_parts(d.parsed(spark, sf)), mode, skip_first)


_funnel("capture_funnel", "last")
_funnel("capture_funnel_first", "first")
_funnel("capture_funnel_all", "all")
_funnel("capture_funnel_skip_first", "last", True)


def _funnel_rerun(name: str, mode: str) -> None:
    @query(name, _funnel_sql(mode, rerun=True))
    def run(spark, sf):
        """What is left to do in a run that follows another."""
        lines = cut_lineage(urls.with_url_parts(d.parsed(spark, sf)), "lines")
        job = CaptureJob(mode=mode)
        overlaid = job.overlaid(job.versions(job.captures(lines)), d.earlier_results(spark, sf))
        return report.capture_funnel_once(lines, mode, overlaid=overlaid)


_funnel_rerun("capture_funnel_rerun", "last")
_funnel_rerun("capture_funnel_rerun_all", "all")
