"""Queries over the links of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.checks import derived as d
from palimpsest.checks import oracle as o
from palimpsest.checks.registry import query
from palimpsest.operators import links

# Links are marked where they stand, kind by kind, with characters that no page holds, and the text
# is cut at the marks.
_NAMES = "|".join(links.LINK_ATTRIBUTES)
_KINDS = [
    rf"""((?:^|[^\w:.\-])(?:{_NAMES})\s*=\s*")([^"]*)(")""",
    rf"""((?:^|[^\w:.\-])(?:{_NAMES})\s*=\s*'')([^'']*)('')""",
    rf"""((?:^|[^\w:.\-])(?:{_NAMES})\s*=\s*)([^\s"''<>`]+)()""",
    rf"""((?:^|[^\w\-]){links.STYLE_FUNCTION}\(\s*")([^"]*)("\s*\))""",
    rf"""((?:^|[^\w\-]){links.STYLE_FUNCTION}\(\s*'')([^'']*)(''\s*\))""",
    rf"""((?:^|[^\w\-]){links.STYLE_FUNCTION}\(\s*)([^\s"''()]+)(\s*\))""",
]
_MARKED = "html"
for _kind in _KINDS:
    _MARKED = rf"regexp_replace({_MARKED}, '(?i){_kind}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
_FOUND = f"""list_filter(list_transform(string_split({_MARKED}, chr(1))[2:], lambda x: split_part(x, chr(2), 1)), lambda x: x <> '')"""

# the pages, with links of every spelling behind their text
_MORE = (
    "<img src=/i/{0}.png alt=x><img data-src=''late/{0}.png''><video poster = ''//cdn.org/p.jpg''></video>"
    "<a href=\"/\">home</a><a href=\"\">none</a><b style=\"a:url(/s/{0}.css) url( ''../t.css'' )\">/i/{0}.png</b>"
)
_MORE_SQL = "'" + _MORE.replace("{0}", "' || page_id || '") + "'"
ALL_KINDS = f"""(SELECT page_id, url, html || {_MORE_SQL} AS html FROM pages)"""


def _pages(spark, sf):
    text = _MORE.replace("''", "'").split("{0}")
    more = F.concat(*[x for piece in text for x in (F.lit(piece), F.col("page_id").cast("string"))][:-1])
    return d.table(spark, sf, "pages").select("page_id", "url", F.concat("html", more).alias("html"))


PAGES = f"""placed AS (
  SELECT page_id, url, html, url_key, domain_raw AS domain, CASE WHEN depth <= 1 THEN './' ELSE repeat('../', depth) END AS steps,
    list_distinct({_FOUND}) AS found
  FROM (SELECT *, len(string_split(url_key, '/')) - 2 AS depth FROM {o.url_parts(ALL_KINDS, 'url')}))"""
EACH = f"""each AS (
  SELECT *, {o.host(o.bare('link'))} AS link_host,
    link <> '' AND (starts_with(link, '//') OR ({o.host(o.bare('link'))} <> domain AND contains(link, '://'))) AS external
  FROM (SELECT page_id, domain, steps, unnest(found) AS link FROM placed))"""


def _normalized(link: str, also: str) -> str:
    """Rows of ``each`` with ``normal``, the path of a link below its site."""
    rooted = f"'/' || split_part({link}, '../', -1)"
    return f"""(SELECT *, subdir || '/' || filename_raw AS normal FROM {o.url_parts(
        f"(SELECT *, CASE WHEN starts_with({rooted}, '//') THEN '/' || split_part({rooted}, '//', 2) ELSE {rooted} END AS rooted FROM each)",
        "rooted", also=also)})"""


_ALSO = "page_id, link, link_host, external, domain_page, steps, subdir, filename_raw"
NORMAL = f"normal AS (SELECT * FROM {_normalized('link', _ALSO)})"
EACH_NAMED = EACH.replace("each AS (\n  SELECT *,", "each AS (\n  SELECT * EXCLUDE (domain), domain AS domain_page,")

LOCAL = """localized AS (
  SELECT page_id, link, domain_page, external, CASE WHEN external OR NOT valid THEN link
    WHEN starts_with(r3, '../') THEN steps || ltrim(split_part(r3, '../', -1), '/') ELSE r3 END AS local
  FROM (SELECT *, CASE WHEN link_host = domain_page AND domain_page <> '' THEN steps || ltrim(split_part(r2, domain_page, 2), '/') ELSE r2 END AS r3
  FROM (SELECT *, CASE WHEN starts_with(r1, './/') THEN steps || ltrim(r1, './') ELSE r1 END AS r2
  FROM (SELECT *, CASE WHEN starts_with(link, '/') THEN steps || ltrim(link, '/') ELSE link END AS r1,
    strlen(domain_page || '/' || normal) <= 4096 AND list_max(list_transform(string_split(domain_page || '/' || normal, '/'), lambda g: strlen(g))) <= 255 AS valid
  FROM normal))))"""

LINKED = [PAGES, EACH_NAMED]
LOCALIZED = [*LINKED, NORMAL, LOCAL]


@query("extract_links", o.stmt([PAGES], "SELECT page_id, unnest(found) AS link FROM placed"))
def extract_links(spark, sf):
    return links.extract_links(_pages(spark, sf))


@query(
    "link_set",
    o.stmt([PAGES], f"SELECT page_id, array_to_string(list_sort(list_distinct(found || [url])), ' ') AS links FROM placed"),
)
def link_set(spark, sf):
    found = links.link_sets(links.page_links(F.col("html")), F.array("url"))
    return _pages(spark, sf).select("page_id", F.array_join(F.array_sort(found), " ").alias("links"))


@query("steps_to_root", o.stmt([PAGES], "SELECT page_id, domain, steps FROM placed"))
def steps_to_root(spark, sf):
    return links.with_page_place(_pages(spark, sf)).select("page_id", "domain", "steps")


# links as pages hold them, plus each page's own address and other spellings of a link
SPELLINGS_SQL = """placed AS (
  SELECT * EXCLUDE (found), list_distinct(found || [url, 'https://elsewhere.example.org/x?y=1', '//' || domain || '/cdn.js',
    './/' || page_id || '/a.css', '../../' || page_id || '/up.png', 'sub/../deep/' || page_id, 'plain.html', '/%20x/' || page_id || '?q=' || url]) AS found
  FROM pages_placed)"""
SPELLED = [PAGES.replace("placed AS (", "pages_placed AS (", 1), SPELLINGS_SQL, EACH_NAMED, NORMAL, LOCAL]


def _spelled(spark, sf):
    """``(page_id, domain, steps, link)`` with every spelling of a link."""
    placed = links.with_page_place(_pages(spark, sf))
    page = F.col("page_id").cast("string")
    more = F.array(
        F.col("url"),
        F.lit("https://elsewhere.example.org/x?y=1"),
        F.concat(F.lit("//"), "domain", F.lit("/cdn.js")),
        F.concat(F.lit(".//"), page, F.lit("/a.css")),
        F.concat(F.lit("../../"), page, F.lit("/up.png")),
        F.concat(F.lit("sub/../deep/"), page),
        F.lit("plain.html"),
        F.concat(F.lit("/%20x/"), page, F.lit("?q="), "url"),
    )
    found = links.link_sets(links.page_links(F.col("html")), more)
    return placed.select("page_id", "domain", "steps", F.explode(found).alias("link"))


@query(
    "classify_link",
    o.stmt(SPELLED, "SELECT page_id, link, CASE WHEN external THEN 'external' ELSE 'internal' END AS kind FROM localized"),
)
def classify_link(spark, sf):
    kind = links.classify_link(F.col("link"), F.col("domain"))
    return _spelled(spark, sf).select("page_id", "link", kind.alias("kind"))


@query("normalize_link", o.stmt(SPELLED, "SELECT page_id, link, normal FROM normal"))
def normalize_link(spark, sf):
    return _spelled(spark, sf).select("page_id", "link", links.normalize_link(F.col("link")).alias("normal"))


@query("localize_link", o.stmt(SPELLED, "SELECT page_id, link, local FROM localized"))
def localize_link(spark, sf):
    local = links.localize_link(F.col("link"), F.col("domain"), F.col("steps"))
    return _spelled(spark, sf).select("page_id", "link", local.alias("local"))


@query(
    "rewrite_html",
    o.stmt(
        LOCALIZED,
        f"""SELECT p.page_id, md5(string_agg(CASE WHEN i = 1 THEN piece
              ELSE coalesce(local, split_part(piece, chr(2), 1)) || split_part(piece, chr(2), 2) END, '' ORDER BY i)) AS html_md5
            FROM (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
                  FROM (SELECT page_id, string_split({_MARKED}, chr(1)) AS pieces FROM placed)) p
            LEFT JOIN localized l ON l.page_id = p.page_id AND i > 1 AND l.link = split_part(piece, chr(2), 1)
            GROUP BY p.page_id""",
    ),
)
def rewrite_html(spark, sf):
    return links.rewrite_html(_pages(spark, sf)).select("page_id", F.md5("html").alias("html_md5"))


@query(
    "resolve_links",
    o.stmt(
        [*o.KEPT, PAGES, EACH_NAMED],
        f"""SELECT l.page_id, l.link, k.url_key IS NOT NULL AS stored, k.url_archive FROM
          {o.url_parts("(SELECT page_id, link, CASE WHEN contains(link, '://') THEN link ELSE 'http://' || domain_page || link END AS target FROM (SELECT page_id, link, domain_page FROM each UNION SELECT page_id, url, domain FROM placed))", "target")} l
          LEFT JOIN kept k ON k.url_key = l.url_key""",
    ),
)
def resolve_links(spark, sf):
    placed = links.with_page_place(_pages(spark, sf))
    found = links.link_sets(links.page_links(F.col("html")), F.array("url"))
    each = placed.select("page_id", "domain", F.explode(found).alias("link"))
    absolute = F.when(F.col("link").contains("://"), F.col("link")).otherwise(
        F.concat(F.lit("http://"), F.col("domain"), F.col("link"))
    )
    rows = links.resolve_links(each.select("page_id", "link", absolute.alias("target")), d.kept(spark, sf))
    return rows.select("page_id", "link", F.col("scid").isNotNull().alias("stored"), "url_archive")
