"""SQL counterparts of the queries, written on their own terms for a SQL engine.

Each statement starts from the test tables and shares nothing with the Spark code but the
rules. Regular expressions are avoided where the Spark side uses them, and the other way
round, so that the two are independent checks.
"""

from __future__ import annotations

from http import HTTPStatus

from palimpsest.checks.derived import CUT_EVERY, EARLIER_RUN, LATER, SHORT_EVERY, STEP
from palimpsest.schema import PATH_SPECIALS


def _enc(text: str, chars: list[str] = PATH_SPECIALS) -> str:
    for ch in chars:
        text = f"replace({text}, '{ch}', '%{ord(ch):02x}')"
    return text


def _contain(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, '/'), lambda g: "
        "CASE g WHEN '.' THEN '%2e' WHEN '..' THEN '%2e%2e' ELSE g END), '/')"
    )


def bare(url: str, embedded: str = "cut") -> str:
    rest = f"split_part({url}, '://', 2)" if embedded == "cut" else f"substr({url}, instr({url}, '://') + 3)"
    return f"(CASE WHEN contains({url}, '://') THEN {rest} ELSE {url} END)"


def host(b: str) -> str:
    return f"split_part(split_part(split_part({b}, '/', 1), '@', -1), ':', 1)"


def path(b: str) -> str:
    return f"substr({b}, length(split_part({b}, '/', 1)) + 1)"


def file_raw(b: str) -> str:
    return f"split_part({path(b)}, '/', -1)"


def subdir_raw(b: str) -> str:
    return f"trim(left({path(b)}, length({path(b)}) - length({file_raw(b)})), '/')"


def domain_of(h: str, merge_www: bool = True) -> str:
    low = f"rtrim(lower({h}), '.')"
    if not merge_www:
        return low
    return (
        f"(CASE WHEN starts_with({low}, 'www.') AND contains(substr({low}, 5), '.') "
        f"THEN substr({low}, 5) ELSE {low} END)"
    )


def url_parts(source: str, url: str, merge_www: bool = True, embedded: str = "cut", also: str = "*") -> str:
    """``source`` with bare, domain_raw, domain, subdir, filename_raw, filename, url_key."""
    return f"""(
      SELECT {also}, concat_ws('/', nullif(domain, ''), nullif(subdir, ''), filename) AS url_key FROM (
        SELECT *, CASE WHEN filename_raw = '' THEN 'index.html' ELSE filename_raw END AS filename FROM (
          SELECT *, {domain_of('domain_raw', merge_www)} AS domain,
            {_contain(_enc('subdir_plain'))} AS subdir,
            {_contain(f"replace({_enc('file_plain')}, '%20', ' ')")} AS filename_raw
          FROM (
            SELECT *, {host('bare')} AS domain_raw, {subdir_raw('bare')} AS subdir_plain, {file_raw('bare')} AS file_plain
            FROM (SELECT *, {bare(url, embedded)} AS bare FROM {source})))))"""


def _ported(u: str) -> str:
    for tld in ("com", "net", "org"):
        u = f"replace({u}, '.{tld}/', '.{tld}:80/')"
    return u


FETCHES = f"""fetches AS (
  SELECT (e.event_id * {STEP}) % (SELECT count(*) FROM events) AS line_no, p.page_id,
    CASE WHEN p.page_id % 4 = 0 THEN strftime(e.ts, '%Y%m%d') || '000000' ELSE strftime(e.ts, '%Y%m%d%H%M%S') END AS timestamp,
    upper(md5(p.url)) AS digest,
    CASE WHEN e.event_type = 'view' THEN 'warc/revisit' ELSE 'text/html' END AS mimetype,
    CASE e.event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '301' WHEN 'purchase' THEN '302' ELSE '200' END AS statuscode,
    CASE WHEN e.event_id % 97 = 0 THEN 'mailto:u' || e.user_id || '@example.com'
      WHEN (e.event_id // (SELECT count(*) FROM pages)) % 5 = 1 THEN replace(p.url, '://', '://www.')
      WHEN (e.event_id // (SELECT count(*) FROM pages)) % 5 = 2 THEN replace(p.url, 'example', 'EXAMPLE')
      WHEN (e.event_id // (SELECT count(*) FROM pages)) % 5 = 3 THEN {_ported('p.url')}
      WHEN (e.event_id // (SELECT count(*) FROM pages)) % 5 = 4 THEN replace(p.url, '.com/', '.com./')
      ELSE p.url END AS url_origin
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))"""

RAW = f"""raw AS (
  SELECT line_no, CASE WHEN line_no % {CUT_EVERY} = 5 THEN left(j, 40)
      WHEN line_no % {SHORT_EVERY} = 7 THEN '["' || timestamp || '","' || digest || '","' || mimetype || '"],' ELSE j END AS line FROM (
    SELECT CASE WHEN again THEN line_no + {LATER} ELSE line_no END AS line_no, timestamp, digest, mimetype,
      '["' || timestamp || '","' || digest || '","' || mimetype || '","' || CASE WHEN again THEN '404' ELSE statuscode END || '","' || url_origin || '"],' AS j
    FROM (SELECT *, unnest(CASE WHEN line_no % 10 = 3 THEN [false, true] ELSE [false] END) AS again FROM fetches)))"""

LINES = """lines AS (
  SELECT line_no, CASE WHEN ends_with(line, ',') THEN left(line, length(line) - 1) ELSE line END AS line FROM (
    SELECT line_no, CASE WHEN ends_with(trim(line), ']]') THEN left(trim(line), length(trim(line)) - 1) ELSE trim(line) END AS line FROM raw))"""

PARSED = """parsed AS (
  SELECT line_no, line, timestamp, digest, mimetype, statuscode, url_origin,
    CASE WHEN NOT good THEN 'faulty'
      WHEN n < 5 OR timestamp IS NULL OR url_origin IS NULL THEN 'malformed'
      WHEN starts_with(lower(url_origin), 'mailto') THEN 'mailto' ELSE 'ok' END AS verdict
  FROM (SELECT line_no, line, good, json_array_length(j) AS n, j ->> 0 AS timestamp, j ->> 1 AS digest,
      j ->> 2 AS mimetype, j ->> 3 AS statuscode, j ->> 4 AS url_origin
    FROM (SELECT line_no, line, json_valid(line) AS good, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM lines)))"""

CAPTURES = f"""captures AS MATERIALIZED (
  SELECT line_no, line_no AS scid, timestamp, digest, mimetype, statuscode, url_origin,
    'https://web.archive.org/web/' || timestamp || 'id_/' || url_origin AS url_archive,
    domain, url_key, CASE WHEN statuscode IN ('301', '404') THEN statuscode END AS response
  FROM {url_parts("(SELECT * FROM parsed WHERE verdict = 'ok')", 'url_origin')})"""

DISTINCT = """distinct_captures AS MATERIALIZED (
  SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY timestamp, url_origin ORDER BY scid) = 1)"""


def kept_cte(mode: str, name: str = "kept") -> str:
    order = {"last": "timestamp DESC", "first": "timestamp"}[mode]
    return (
        f"{name} AS (SELECT * FROM distinct_captures QUALIFY row_number() OVER "
        f"(PARTITION BY url_key ORDER BY {order}, scid) = 1)"
    )


PAYLOADS = f"""payloads AS (
  SELECT d.url_archive, CAST(d.statuscode AS INTEGER) AS status,
    CASE WHEN d.statuscode = '302' THEN coalesce(a.url_archive, '/web/' || d.timestamp || 'id_/moved/../gone?to=' || d.digest) END AS location,
    CAST(NULL AS VARCHAR) AS encoding, p.html AS body
  FROM distinct_captures d
  LEFT JOIN (SELECT scid - 1 AS before, url_archive FROM captures WHERE scid < {LATER}) a ON a.before = d.scid
  JOIN (SELECT upper(md5(url)) AS digest, html FROM pages) p ON p.digest = d.digest)"""

# The same without bodies: what queries need to know of a body is taken from the page before it meets captures.
NARROW_PAYLOADS = f"""page_digests AS MATERIALIZED (
  SELECT upper(md5(url)) AS digest, md5(html) AS body_md5, contains(left(lower(html), 15), '<!doctype html>') AS is_html FROM pages),
payloads AS (
  SELECT d.url_archive, CAST(d.statuscode AS INTEGER) AS status,
    CASE WHEN d.statuscode = '302' THEN coalesce(a.url_archive, '/web/' || d.timestamp || 'id_/moved/../gone?to=' || d.digest) END AS location,
    p.body_md5, p.is_html
  FROM distinct_captures d
  LEFT JOIN (SELECT scid - 1 AS before, url_archive FROM captures WHERE scid < {LATER}) a ON a.before = d.scid
  JOIN page_digests p ON p.digest = d.digest)"""

EARLIER = f"""earlier AS (
  SELECT scid * 2 + attempt AS csv_line, timestamp, url_archive, url_origin,
    CASE WHEN attempt = 1 THEN url_archive END AS redirect_url,
    CASE WHEN attempt = 1 THEN timestamp END AS redirect_timestamp,
    statuscode AS response,
    CASE WHEN statuscode = '200' OR attempt = 1 THEN 'earlier/' || url_key END AS file
  FROM (SELECT *, 0 AS attempt FROM distinct_captures UNION ALL SELECT *, 1 FROM distinct_captures WHERE statuscode = '302')
  WHERE timestamp < '{EARLIER_RUN}')"""


def worked_cte(base: str) -> str:
    """Earlier results over the captures in ``base``."""
    return f"""worked AS (
  SELECT k.* EXCLUDE (url_archive, response),
    CASE WHEN e.csv_line IS NOT NULL THEN e.url_archive ELSE k.url_archive END AS url_archive,
    e.redirect_url, e.redirect_timestamp,
    CASE WHEN e.csv_line IS NOT NULL THEN e.response ELSE k.response END AS response, e.file
  FROM {base} k LEFT JOIN (
    SELECT * FROM earlier QUALIFY row_number() OVER (PARTITION BY timestamp, url_origin ORDER BY csv_line DESC) = 1) e
  USING (timestamp, url_origin))"""


SAVE_LOG = """save_log AS (
  SELECT event_id, url, status,
    CASE WHEN status = 302 THEN 'https://web.archive.org/web/' || strftime(request_ts - to_seconds(user_id * 37 % 5400), '%Y%m%d%H%M%S') || 'id_/' || url END AS location,
    request_ts
  FROM (SELECT event_id, user_id, 'https://example.com/' || event_id AS url, date_trunc('second', ts) AS request_ts,
    CASE WHEN event_type IN ('click', 'view') THEN 302 WHEN event_type = 'purchase' THEN 429
      WHEN event_type = 'signup' THEN 520 WHEN user_id % 2 = 0 THEN 404 ELSE 500 END AS status FROM events))"""

ADDRESSES = """addresses AS (
  SELECT 'listing' AS kind, scid AS id, url_origin AS url FROM captures
  UNION ALL SELECT 'document', doc_id, 'HTTP://user:pw@WWW.' || lang || '.Example.com.:8080/a//b/../' || source || '/./' || replace(text, ' ', '/') || '?q=http://other.com/x%20y~z' FROM documents
  UNION ALL SELECT 'text', doc_id, text FROM documents
  UNION ALL SELECT 'page', page_id, url FROM pages)"""

BODIES = """bodies AS (
  SELECT 'page' AS kind, page_id AS id, html AS body FROM pages
  UNION ALL SELECT 'document', doc_id, text FROM documents)"""

LISTING = [FETCHES, RAW, LINES]
CAPTURED = [*LISTING, PARSED, CAPTURES]
DISTINCTS = [*CAPTURED, DISTINCT]
KEPT = [*DISTINCTS, kept_cte("last")]
WORK = [*DISTINCTS, EARLIER, worked_cte("distinct_captures")]
ADDRESSED = [*CAPTURED, ADDRESSES]


def stmt(ctes: list[str], select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + select


def phrases() -> str:
    rows = ", ".join("({}, '{}')".format(s.value, s.phrase.replace("'", "''")) for s in HTTPStatus)
    return f"phrases AS (SELECT * FROM (VALUES {rows}) t(code, phrase))"
