"""Queries over authored rows, for what the test tables do not hold: markup, fetched files, report answers, model answers.

The rows are the same on both sides; the SQL computes from them by its own expressions and its own copies of the fixed values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import audit, blocks, links, pages, performance
from tidemark.plans.catalogue import QUERIES, SQL, _strip, query, table
from tidemark.sources import delimited, sinks
from tidemark.sources import web as W

__all__ = ["QUERIES", "SQL"]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


class Rows:
    """Authored rows as a DataFrame and as a table of SQL."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        names = ", ".join(x.split()[0] for x in schema.split(", "))
        self.sql = f"{name}({names}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"

    def __call__(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


# Markup

_PRODUCT = '{"@type":"Product","name":"x","offers":{"@type":"Offer","price":1},"2":{"@type":"Late"},"1":{"@type":["Early",7]}}'
HTML = Rows(
    "html_pages",
    "url string, status int, x_robots_tag string, content_type string, html string",
    [
        (
            "https://a.com/p?x=1#top", 200, "", "text/html; charset=utf-8",
            '<html lang="en"><head><title>Red &amp; blue shoes | Shop</title><meta name="description" content="Shoes &amp; more"><meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="/i.png">'
            '<meta name="twitter:card" content="summary"><link rel="shortcut icon" href="/f.ico"><link rel="canonical" href="/p"><meta name="Viewport" content="width=device-width"><script>var a = "<p>no</p>";</script>'
            f'<script type="application/ld+json">{_PRODUCT}</script></head><body><h1>One</h1><h3>Skip <b>it</b></h3><img alt src="/a.png" width="3" height="4"><img data-src="b.png" loading=lazy><img><a href="/q">Q &amp; a</a><a name="n">none</a>'
            '<a href="https://b.org/z" rel="NoFollow sponsored">out</a><a href="mailto:x@y.z">mail</a><p itemscope itemtype="https://schema.org/Product#v">x</p><p typeof="Person  Agent">y</p><p typeof="Person">z</p><noscript>hidden</noscript></body></html>',
        ),
        ("https://a.com/service/x/", 404, "NoIndex", "", '<title></title><h2>no first</h2><script type="application/ld+json">{"@type":"Organization","name":"Acme &amp; co"}</script><script type="application/ld+json">{broken</script>' + "word " * 12),
        ("https://a.com/blog", 200, "", "text/html", "<html LANG='de'><title>A title that is longer than sixty-five characters, which is too long for a snippet</title><h1>a</h1><h1>b</h1><h2>c</h2><meta name=description content='" + "d" * 120 + "'><meta name=robots content=\"noindex, follow\"><link rel=\"x canonical\" href=\"https://a.com/other\"><body>" + "<p>text &lt;b&gt; more</p>" * 100),
        ("https://a.com/file.pdf", 200, "", "application/pdf", ""),
        ("https://a.com/empty", 200, "", "", None),
    ],
)


def _facts(spark: SparkSession) -> DataFrame:
    return pages.page_facts(HTML(spark))


def _attr(tag: str, name: str) -> str:
    quoted, bare = rf"{name}\s*=\s*[\x22'']([^\x22'']*)[\x22'']", rf"{name}\s*=\s*([^\s>]+)"
    return f"CASE WHEN regexp_matches({tag}, '{quoted}', 'i') THEN regexp_extract({tag}, '{quoted}', 1, 'i') ELSE regexp_extract({tag}, '{bare}', 1, 'i') END"


_H = "coalesce(html, '')"
_ORIGIN, _OWN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)", "regexp_replace(url, '#.*$', '')"


def _meta(key: str, value: str) -> str:
    return f"coalesce(list_transform(list_filter(regexp_extract_all({_H}, '<meta\\b[^>]*>', 0, 'i'), lambda t: lower({_attr('t', key)}) = '{value}'), lambda t: {_attr('t', 'content')})[1], '')"


def _rel(rel: str) -> str:
    return f"coalesce(list_transform(list_filter(regexp_extract_all({_H}, '<link\\b[^>]*>', 0, 'i'), lambda t: list_contains(regexp_split_to_array(lower({_attr('t', 'rel')}), '\\s+'), '{rel}')), lambda t: {_attr('t', 'href')})[1], '')"


def _resolved(x: str) -> str:
    """References as they stand in the authored rows: full, from the root, beside the page, or none."""
    return f"CASE WHEN {x} = '' THEN {_OWN} WHEN regexp_matches({x}, '^[a-z]+:') THEN {x} WHEN {x}[1] = '/' THEN {_ORIGIN} || {x} ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || {x} END"


_STRIPPED = _H
for _tag in ("script", "style", "noscript"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '<{_tag}.*?</{_tag}>', ' ', 'gis')"
_VISIBLE = _strip(_STRIPPED)
_N_WORDS = f"CASE WHEN {_VISIBLE} = '' THEN 0 ELSE len(string_split({_VISIBLE}, ' ')) END::INTEGER"
_PAGE_TITLE = _strip(rf"regexp_extract({_H}, '<title\b[^>]*>(.*?)</title>', 1, 'is')")
_HTML_LANG = _attr(rf"regexp_extract({_H}, '<html\b[^>]*>', 0, 'i')", "lang")
_REFUSED = "status BETWEEN 200 AND 299 AND content_type <> '' AND NOT regexp_matches(content_type, '(text/html|application/xhtml\\+xml)', 'i')"


@query(f"""WITH {HTML.sql} SELECT url AS requested_url, url AS final_url, {_PAGE_TITLE} AS title, {_meta("name", "description")} AS description, {_meta("name", "robots")} AS robots, x_robots_tag, {_meta("name", "viewport")} AS viewport,
{_resolved("(" + _rel("canonical") + ")")} AS canonical, {_resolved("coalesce(nullif(" + _rel("icon") + ", ''), '/favicon.ico')")} AS favicon, {_HTML_LANG} AS lang, status, status BETWEEN 200 AND 299 AS ok, content_type,
CASE WHEN {_REFUSED} THEN 'The URL returned ' || content_type || ', not an HTML webpage.' END AS error, {_N_WORDS} AS word_count, left({_VISIBLE}, 12000) AS text_excerpt FROM html_pages""")
def e_html_facts(spark, sf_dir):
    return _facts(spark).select("requested_url", "final_url", "title", "description", "robots", "x_robots_tag", "viewport", "canonical", "favicon", "lang", "status", "ok", "content_type", "error", "word_count", "text_excerpt")


@query(f"""WITH {HTML.sql} SELECT url, {_meta("property", "og:title")} AS og_title, {_meta("property", "og:description")} AS og_description, {_resolved("(" + _meta("property", "og:image") + ")")} AS og_image, {_resolved("(" + _meta("property", "og:url") + ")")} AS og_url,
{_meta("name", "twitter:card")} AS card, {_resolved("(" + _meta("name", "twitter:image") + ")")} AS twitter_image FROM html_pages""")
def e_social(spark, sf_dir):
    return _facts(spark).select(F.col("final_url").alias("url"), F.col("og.title").alias("og_title"), F.col("og.description").alias("og_description"), F.col("og.image").alias("og_image"), F.col("og.url").alias("og_url"), F.col("twitter.card").alias("card"), F.col("twitter.image").alias("twitter_image"))


# RE2 has no backreference, so headings are matched level by level and put in order of their place.
_HEADINGS = " UNION ALL ".join(f"SELECT url, {n} AS level, unnest(regexp_extract_all({_H}, '<h{n}\\b[^>]*>(.*?)</h{n}>', 1, 'is')) AS body, unnest(regexp_extract_all({_H}, '<h{n}\\b[^>]*>.*?</h{n}>', 0, 'is')) AS whole, html FROM html_pages" for n in range(1, 7))
_HEADED = f"heads AS ({_HEADINGS}), placed AS (SELECT url, level, {_strip('body')} AS text, row_number() OVER (PARTITION BY url ORDER BY instr(html, whole))::INTEGER AS n FROM heads)"


@query(f"WITH {HTML.sql}, {_HEADED} SELECT * FROM placed")
def e_headings(spark, sf_dir):
    return _facts(spark).select(F.col("final_url").alias("url"), F.posexplode("headings").alias("n", "x")).select("url", "x.level", "x.text", (F.col("n") + 1).alias("n"))


_SKIPS = f"{_HEADED}, steps AS (SELECT *, lag(level) OVER (PARTITION BY url ORDER BY n) AS before FROM placed), skips AS (SELECT url, arg_min(before, n) AS from_level, arg_min(level, n) AS to_level FROM steps WHERE level - before > 1 GROUP BY url)"


@query(f"WITH {HTML.sql}, {_SKIPS} SELECT url, from_level, to_level FROM skips")
def w_heading_skip(spark, sf_dir):
    skip = audit.heading_skip(F.col("headings"))
    return _facts(spark).select(F.col("final_url").alias("url"), skip["from_level"].alias("from_level"), skip["to_level"].alias("to_level")).where("from_level is not null")


_SRC = f"coalesce(nullif({_attr('tag', 'src')}, ''), nullif({_attr('tag', 'data-src')}, ''), nullif({_attr('tag', 'data-lazy-src')}, ''), '')"
_SIZES = {n: f"nullif(TRY_CAST({_attr('tag', n)} AS DOUBLE), 0)" for n in ("width", "height")}
_IMAGES = f"tags AS (SELECT url, unnest(regexp_extract_all({_H}, '<img\\b[^>]*>', 0, 'i')) AS tag FROM html_pages), found AS (SELECT url, {_SRC} AS ref, {_attr('tag', 'alt')} AS alt, regexp_matches(tag, '\\salt(?:\\s*=|\\s|>)', 'i') AS has_alt, {_SIZES['width']} AS width, {_SIZES['height']} AS height, {_attr('tag', 'loading')} AS loading, tag FROM tags), images AS (SELECT url, {_resolved('ref')} AS src, alt, has_alt, width, height, loading, tag FROM found)"


@query(f"WITH {HTML.sql}, {_IMAGES} SELECT * FROM images")
def e_images(spark, sf_dir):
    return _facts(spark).select(F.col("final_url").alias("url"), F.explode("images").alias("i")).select("url", "i.*")


@query(f"WITH {HTML.sql}, {_IMAGES} SELECT src AS image_url, url AS source_url, left(tag, 500) AS evidence FROM images WHERE NOT has_alt")
def j_missing_alt(spark, sf_dir):
    return audit.missing_alt(_facts(spark))


@query(f"WITH {HTML.sql}, {_IMAGES} SELECT count(DISTINCT url)::BIGINT AS pages, (SELECT count(*) FROM images)::BIGINT AS images FROM images WHERE NOT has_alt")
def a_image_totals(spark, sf_dir):
    p = _facts(spark)
    return audit.pages_missing_alt(audit.missing_alt(p)).crossJoin(audit.image_total(audit.inventory(p)))


_ANCHORS = f"whole AS (SELECT url, unnest(regexp_extract_all({_H}, '<a\\b[^>]*>.*?</a>', 0, 'is')) AS tag FROM html_pages), refs AS (SELECT url, {_attr('tag', 'href')} AS ref, {_strip('tag')} AS anchor, {_attr('tag', 'rel')} AS rel FROM whole), anchors AS (SELECT url, {_resolved('ref')} AS target, anchor, rel FROM refs WHERE regexp_matches({_resolved('ref')}, '^https?:'))"


@query(f"WITH {HTML.sql}, {_ANCHORS} SELECT url, target, anchor, rel, NOT regexp_matches(lower(rel), 'nofollow|sponsored|ugc') AS follow FROM anchors")
def e_anchors(spark, sf_dir):
    rows = _facts(spark).select(F.col("final_url").alias("url"), F.explode("links").alias("x"))
    return rows.select("url", F.col("x.url").alias("target"), "x.anchor", "x.rel", links.follow(F.col("x.rel")).alias("follow"))


@query(f"WITH {HTML.sql} SELECT url, regexp_extract_all({_H}, 'itemtype\\s*=\\s*[\\x22'']https?://schema\\.org/([^\\x22'']+)[\\x22'']', 1, 'i') AS microdata, list_filter(flatten(list_transform(regexp_extract_all({_H}, 'typeof\\s*=\\s*[\\x22'']([^\\x22'']+)[\\x22'']', 1, 'i'), lambda v: regexp_split_to_array(v, '\\s+'))), lambda x: x <> '') AS rdfa FROM html_pages")
def e_markup_types(spark, sf_dir):
    h = F.coalesce("html", F.lit(""))
    return HTML(spark).select("url", T.microdata_types(h).alias("microdata"), T.rdfa_types(h).alias("rdfa"))


_LD = f"raws AS (SELECT url, unnest(regexp_extract_all({_H}, '<script\\b[^>]*type\\s*=\\s*[\\x22'']application/ld\\+json[\\x22''][^>]*>(.*?)</script>', 1, 'is')) AS raw FROM html_pages)"


@query(f"WITH {HTML.sql}, {_LD} SELECT url, raw, json_valid(raw) AS valid FROM raws")
def n_blocks(spark, sf_dir):
    return _facts(spark).select(F.col("final_url").alias("url"), F.explode("blocks").alias("b")).select("url", "b.raw", "b.valid")


_JSON = Rows("blocks", "page_url string, block int, raw string", [("p1", 0, _PRODUCT), ("p1", 1, '[{"@type":["Article","BlogPosting"],"author":{"@type":"Person"}},{"none":{"@graph":[{"@type":"Deep"}]}}]'), ("p2", 0, "{broken"), ("p3", 0, '{"@type":""}')])
# json_tree visits a parent before what is in it; types of an object come from its own key
_TYPED = """nodes AS (SELECT page_url, block, t.type AS kind, t.value AS value FROM blocks, json_tree(CASE WHEN json_valid(raw) THEN raw::JSON ELSE '{}'::JSON END) t),
kinds AS (SELECT page_url, block, json_extract(value, '$."@type"') AS said FROM nodes WHERE kind = 'OBJECT'),
each AS (SELECT page_url, block, unnest(CASE WHEN json_type(said) = 'ARRAY' THEN json_extract(said, '$[*]') ELSE [said] END) AS one FROM kinds WHERE said IS NOT NULL AND said <> '""')"""


@query(f"WITH {_JSON.sql}, {_TYPED} SELECT page_url, block, json_extract_string(one, '$') AS type FROM each")
def n_jsonld_types(spark, sf_dir):
    return blocks.walk_types(_JSON(spark)).select("page_url", "block", "type")


@query(f"WITH {HTML.sql} SELECT url, {_PAGE_TITLE} AS title, CASE url WHEN 'https://a.com/service/x/' THEN 'Acme & co' ELSE coalesce(nullif(trim(regexp_extract({_PAGE_TITLE}, '^([^|–—-]*)', 1)), ''), 'Website') END AS site_name FROM html_pages")
def e_site_name(spark, sf_dir):
    return _facts(spark).select(F.col("final_url").alias("url"), "title", "site_name")


_RULES = f"""p AS (SELECT *, {_PAGE_TITLE} AS title, {_meta("name", "description")} AS description, {_meta("name", "robots")} AS robots, {_meta("name", "viewport")} AS viewport, {_HTML_LANG} AS lang, {_N_WORDS} AS words,
  {_resolved("(" + _rel("canonical") + ")")} AS canonical, len(list_filter(list_transform(regexp_extract_all({_H}, '<h1\\b[^>]*>(.*?)</h1>', 1, 'is'), lambda x: {_strip('x')}), lambda x: x <> '')) AS n_h1,
  {_meta("property", "og:title")} AS og_title, {_meta("property", "og:description")} AS og_description, {_REFUSED} AS refused FROM html_pages), q AS (SELECT * FROM p WHERE NOT refused), {_SKIPS}, {_IMAGES}, {_LD},
ld AS (SELECT url, count_if(json_valid(raw)) AS good, count_if(NOT json_valid(raw)) AS bad FROM raws GROUP BY url), im AS (SELECT url, count_if(NOT has_alt) AS no_alt, count_if(width IS NULL OR height IS NULL) AS no_size FROM images GROUP BY url),
findings AS (SELECT url, 'Technical SEO' AS category, 'critical' AS severity, 'crawl-error' AS code FROM p WHERE refused
  UNION ALL SELECT url, 'Technical SEO', 'critical', 'http-status' FROM q WHERE NOT status BETWEEN 200 AND 299
  UNION ALL SELECT url, 'Technical SEO', 'critical', 'viewport' FROM q WHERE viewport = ''
  UNION ALL SELECT url, 'Indexability', 'warning', 'noindex' FROM q WHERE regexp_matches(robots || ' ' || x_robots_tag, 'noindex', 'i')
  UNION ALL SELECT url, 'Indexability', 'info', 'canonical-other' FROM q WHERE canonical <> {_OWN}
  UNION ALL SELECT url, 'Technical SEO', 'warning', 'lang' FROM q WHERE lang = ''
  UNION ALL SELECT url, 'Structured Data', 'warning', 'schema-missing' FROM q LEFT JOIN ld USING (url) WHERE coalesce(good, 0) = 0
  UNION ALL SELECT url, 'Structured Data', 'critical', 'schema-invalid' FROM q JOIN ld USING (url) WHERE bad > 0
  UNION ALL SELECT url, 'On-page SEO', 'critical', 'title-missing' FROM q WHERE title = ''
  UNION ALL SELECT url, 'On-page SEO', 'warning', 'title-length' FROM q WHERE title <> '' AND NOT length(title) BETWEEN 30 AND 65
  UNION ALL SELECT url, 'On-page SEO', 'critical', 'description-missing' FROM q WHERE description = ''
  UNION ALL SELECT url, 'On-page SEO', 'warning', 'description-length' FROM q WHERE description <> '' AND NOT length(description) BETWEEN 90 AND 170
  UNION ALL SELECT url, 'On-page SEO', CASE WHEN n_h1 = 0 THEN 'critical' ELSE 'warning' END, 'h1' FROM q WHERE n_h1 <> 1
  UNION ALL SELECT url, 'On-page SEO', 'warning', 'heading-skip' FROM q JOIN skips USING (url)
  UNION ALL SELECT url, 'Content', 'warning', 'thin-content' FROM q WHERE words < 180
  UNION ALL SELECT url, 'Social & Sharing', 'warning', 'og-incomplete' FROM q WHERE og_title = '' OR og_description = ''
  UNION ALL SELECT url, 'Images & Accessibility', 'warning', 'alt-missing' FROM q JOIN im USING (url) WHERE no_alt > 0
  UNION ALL SELECT url, 'Images & Accessibility', 'info', 'image-dimensions' FROM q JOIN im USING (url) WHERE no_size > 0)"""


@query(f"WITH {HTML.sql}, {_RULES} SELECT * FROM findings")
def k_audit_rules(spark, sf_dir):
    return audit.findings(_facts(spark)).select("url", "category", "severity", "code")


@query(f"WITH {HTML.sql}, {_RULES} SELECT url, code FROM findings WHERE severity = 'info'")
def p_severity(spark, sf_dir):
    return audit.of_severity(audit.findings(_facts(spark)), "info").select("url", "code")


@query(f"WITH {HTML.sql}, {_RULES} SELECT url, code FROM findings ORDER BY severity, url, code LIMIT 16")
def l_load_more(spark, sf_dir):
    return audit.load_more(audit.findings(_facts(spark)), [F.asc("severity"), F.asc("url"), F.asc("code")]).select("url", "code")


@query(f"WITH {HTML.sql}, {_RULES} SELECT url, code, severity FROM findings WHERE severity IN ('critical', 'warning') ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, url, code LIMIT 8")
def l_top_findings(spark, sf_dir):
    return audit.top_findings(audit.findings(_facts(spark))).select("url", "code", "severity")


@query(f"WITH {HTML.sql}, {_RULES}, h AS (SELECT category, greatest(0, 100 - 18 * count_if(severity = 'critical') - 7 * count_if(severity = 'warning')) AS health FROM findings GROUP BY category) SELECT axis, coalesce((SELECT nullif(arg_min(health, category), 0) FROM h WHERE regexp_matches(lower(category), pattern)), 41)::BIGINT AS value FROM (VALUES ('Technical', 'technical'), ('Images', 'image'), ('Content', 'content|page'), ('Speed', 'speed')) a(axis, pattern)")
def k_radar(spark, sf_dir):
    health = audit.category_health(audit.findings(_facts(spark)))
    return audit.radar_axes(health, [("Technical", "technical"), ("Images", "image"), ("Content", "content|page"), ("Speed", "speed")], F.lit(41).cast("long")).select("axis", "value")


# Text, URLs, labels

_TEXTS = Rows("texts", "id int, said string", [(0, None), (1, ""), (2, "a [link](http://x.y/z) &#65;&#x2F; &amp;lt; <b>bold</b> 'q' \"d\" & more"), (3, "  many   blanks &nbsp; and &#128512; signs "), (4, "é" * 30)])


_PLAIN = r"trim(regexp_replace(regexp_replace(coalesce(said, ''), '<[^>]*>', ' ', 'g'), '[\s\x{A0}]+', ' ', 'g'))"


@query(f"""WITH {_TEXTS.sql} SELECT id, {_PLAIN} AS plain, trim(regexp_replace(regexp_replace(said, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g')) AS unlinked,
replace(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, CASE WHEN length(said) > 20 THEN left(said, 19) || '…' ELSE said END AS short, CASE id WHEN 2 THEN 'a [link](http://x.y/z) A/ < <b>bold</b> ''q'' "d" & more' WHEN 3 THEN '  many   blanks   and 😀 signs ' ELSE said END AS decoded FROM texts""")
def e_text_helpers(spark, sf_dir):
    c = F.col("said")
    return _TEXTS(spark).select("id", T.strip_tags(F.coalesce(c, F.lit(""))).alias("plain"), T.strip_markdown_links(c).alias("unlinked"), T.escape_html(c).alias("escaped"), T.ellipsis(c, 20).alias("short"), T.decode_more(c).alias("decoded"))


@query("SELECT doc_id, left(text, 12000) AS excerpt, left(text, 7000) AS keyword_excerpt FROM documents")
def e_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.excerpt(F.col("text"), T.KEYWORD_EXCERPT).alias("keyword_excerpt"))


_NUMBERS = Rows("numbers", "id int, n double, band string", [(0, None, None), (1, 0.0, "5K+"), (2, 999.4, "20–40%"), (3, 1000.0, "1 - 2"), (4, 2048.0, "10—30"), (5, 123456.789, "x"), (6, 5242880.0, "1.5–2.5"), (7, 0.4321, "")])


@query(f"""WITH {_NUMBERS.sql}, z AS (SELECT id, coalesce(n, 0) AS n, band FROM numbers) SELECT id, CASE WHEN n < 1024 THEN floor(n + 0.5)::BIGINT || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS bytes, CASE WHEN n >= 1000 THEN printf('%.2f s', n / 1000) ELSE floor(n + 0.5)::BIGINT || ' ms' END AS ms,
format('{{:,}}', round(n)::BIGINT) AS grouped, CASE id WHEN 2 THEN '99,940%' WHEN 3 THEN '100,000%' WHEN 4 THEN '204,800%' WHEN 5 THEN '12,345,678.9%' WHEN 6 THEN '524,288,000%' WHEN 7 THEN '43.2%' ELSE '0%' END AS percent,
coalesce((TRY_CAST(regexp_extract(band, '(\\d+(?:\\.\\d+)?)\\s*[–—-]\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(band, '(\\d+(?:\\.\\d+)?)\\s*[–—-]\\s*(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE)) / 2, 0)::DOUBLE AS midpoint FROM z""")
def m_labels(spark, sf_dir):
    n = F.col("n")
    return _NUMBERS(spark).select("id", N.bytes_label(n).alias("bytes"), N.ms_label(n).alias("ms"), N.grouped_label(n).alias("grouped"), N.percent_label(n).alias("percent"), N.band_midpoint(F.col("band")).alias("midpoint"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 90 THEN 'good' WHEN value >= 50 THEN 'needs-improvement' ELSE 'poor' END AS bucket, CASE WHEN value >= 80 THEN 'strong' WHEN value >= 50 THEN 'needs work' ELSE 'priority' END AS tile,
floor(value / 1000 * 100 + 0.5)::BIGINT AS category, CASE WHEN value / 100 < 0.5 THEN 'poor' ELSE 'needs-improvement' END AS status, CASE WHEN value > 50 THEN 'up' WHEN value < 50 THEN 'down' ELSE 'flat' END AS direction, CASE WHEN value < 50 THEN 'up' WHEN value > 50 THEN 'down' ELSE 'flat' END AS inverse,
CASE WHEN value / 10 < 1 THEN '<1 year' ELSE floor(value / 10)::BIGINT || ' years' END AS age, coalesce(least(100, value / 10 * 20), 35) AS fallback, greatest(value, event_id / 1000, 1) AS impact FROM events""")
def k_labels(spark, sf_dir):
    v = F.col("value")
    made = {
        "bucket": N.score_bucket(v), "tile": N.score_tile(v), "category": N.category_score(v / 1000), "status": N.diagnostic_status(v / 100), "direction": N.direction(v - 50), "inverse": N.direction(v - 50, inverse=True),
        "age": N.age_label(v / 10), "fallback": links.authority_fallback(v / 10), "impact": performance.impact(v, F.col("event_id").cast("double")),
    }
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in made.items()])


_ERRORS = Rows("errors", "id int, message string", [(0, None), (1, "429 rate limit"), (2, "Service overloaded"), (3, "API key not valid (403)"), (4, "model x not found"), (5, "fetch failed"), (6, "odd"), (7, "UNAVAILABLE quota")])


@query(f"""WITH {_ERRORS.sql} SELECT id, CASE WHEN regexp_matches(coalesce(message, ''), 'RESOURCE_EXHAUSTED|quota|rate limit|billing details|429', 'i') THEN 'quota' WHEN regexp_matches(coalesce(message, ''), 'UNAVAILABLE|overloaded|temporarily unavailable|503', 'i') THEN 'temporary'
WHEN regexp_matches(coalesce(message, ''), 'API key|PERMISSION_DENIED|UNAUTHENTICATED|permission|401|403', 'i') THEN 'credentials' WHEN regexp_matches(coalesce(message, ''), 'model .*not found|NOT_FOUND|no longer available|404', 'i') THEN 'model' WHEN regexp_matches(coalesce(message, ''), 'timed out|AbortError|network|fetch failed', 'i') THEN 'network' ELSE 'other' END AS kind FROM errors""")
def k_error_kind(spark, sf_dir):
    return _ERRORS(spark).select("id", links.error_kind(F.col("message")).alias("kind"))


@query("SELECT c, l, CASE WHEN c = 0 THEN 'Insufficient evidence' WHEN l >= 20 THEN 'High' WHEN l >= 5 THEN 'Medium' ELSE 'Low' END AS confidence FROM (VALUES (0, 0), (3, 0), (9, 5), (30, 20)) t(c, l)")
def k_confidence(spark, sf_dir):
    return spark.createDataFrame([(0, 0), (3, 0), (9, 5), (30, 20)], "c int, l int").withColumn("confidence", links.confidence(F.col("c"), F.col("l")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 100 IN (404, 410) OR l_quantity::INTEGER * 20 >= 500 THEN 'broken' WHEN l_returnflag = 'R' OR l_quantity::INTEGER * 20 IN (401, 403, 429) THEN 'unverified' END AS state FROM lineitem")
def p_link_state(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "R", "Blocked").when(F.col("l_returnflag") == "A", "Error")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", audit.link_state(F.col("l_quantity").cast("int") * 20, label).alias("state"))


_URLS = Rows(
    "urls",
    "id int, url string",
    [(0, "https://x.shop.com/a#b"), (1, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fblog.one.org%2Fp%3Fq%3D1%23z&rut=1"), (2, "https://r.search.yahoo.com/RU=https%3A%2F%2Ftwo.net%2F/RK=2"), (3, "https://www.bing.com/search"), (4, "ftp://three.io/"), (5, "https://www.own.com/x"), (6, "https://sub.own.com/"), (7, "")],
)


@query(f"""WITH {_URLS.sql}, f AS (SELECT id, CASE WHEN url LIKE '//%' THEN 'https:' || url ELSE url END AS url FROM urls), u AS (SELECT id, CASE WHEN url LIKE '%uddg=%' THEN url_decode(regexp_extract(url, '[?&]uddg=([^&#]*)', 1)) WHEN url LIKE '%yahoo.com/%/RU=%' OR url LIKE '%yahoo.com/RU=%' THEN url_decode(regexp_extract(url, '/RU=([^/]+)', 1)) ELSE url END AS url FROM f),
h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM u), r AS (SELECT *, array_to_string(list_slice(string_split(regexp_replace(host, '^www\\.', ''), '.'), -2, -1), '.') AS root FROM h)
SELECT id, url AS target, CASE WHEN regexp_matches(url, '^https?:') AND host <> '' AND root NOT IN ('duckduckgo.com', 'bing.com', 'microsoft.com', 'yahoo.com', 'google.com', 'googleusercontent.com', 'own.com') THEN regexp_replace(url, '#.*$', '') END AS candidate FROM r""")
def r_candidates(spark, sf_dir):
    u = F.col("url")
    return _URLS(spark).select("id", U.unwrap(u).alias("target"), U.candidate(u, F.lit("own.com")).alias("candidate"))


_NAMES = Rows("names", "id int, name string, one string, two string", [(0, "sc-domain:Example.com", " links  to\nEXAMPLE.com ", "other"), (1, "https://www.shop.example.org/x?y", None, "shop.example.org reviews"), (2, "plain.net/path", "plain.net" + " x" * 100, '"plain.net" -site:plain.net')])
_NAMED = "h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '^sc-domain:', ''), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS host FROM names)"


def _valid(c: str) -> str:
    return f"CASE WHEN length(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))) <= 180 AND contains(lower(coalesce({c}, '')), host) THEN trim(regexp_replace({c}, '\\s+', ' ', 'g')) ELSE '' END"


@query(f"""WITH {_NAMES.sql}, {_NAMED}, v AS (SELECT id, host, {_valid("one")} AS one, {_valid("two")} AS two, '"' || host || '" -site:' || host AS a, '"https://' || host || '" OR "http://' || host || '" -site:' || host AS b FROM h)
SELECT id, host, one, two, [a, b] AS own, list_filter([a, b, CASE WHEN one NOT IN (a, b) THEN one ELSE '' END, CASE WHEN two NOT IN (a, b, one) THEN two ELSE '' END], lambda x: x <> '') AS plan FROM v""")
def r_search_queries(spark, sf_dir):
    rows = _NAMES(spark).withColumn("host", U.host_from(F.col("name")))
    h = F.col("host")
    return rows.select("id", "host", U.valid_query(F.col("one"), h).alias("one"), U.valid_query(F.col("two"), h).alias("two"), U.search_queries(h).alias("own"), U.query_plan(h, F.array("one", "two")).alias("plan"))


_ADDRESSES = Rows("addresses", "id int, url string", [(0, "http://127.0.0.1/x"), (1, "10.1.2.3"), (2, "http://172.31.0.1"), (3, "http://172.32.0.1/"), (4, "https://192.168.1.1"), (5, "http://100.64.0.1"), (6, "http://8.8.8.8/a#b"), (7, "http://localhost/"), (8, "https://printer.local"), (9, "https://user@host.com/"), (10, "ftp://host.com"), (11, "Host.com/P"), (12, "http://169.254.1.1"), (13, "http://198.18.0.1"), (14, "http://224.0.0.1"), (15, "http://192.0.0.9")])


@query(f"""WITH {_ADDRESSES.sql}, f AS (SELECT id, CASE WHEN regexp_matches(url, '^[a-z]+://', 'i') THEN url ELSE 'https://' || url END AS url FROM addresses), h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1, 'i')) AS host FROM f),
o AS (SELECT *, regexp_matches(host, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') AS numeric, list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS INTEGER)) AS p FROM h),
x AS (SELECT id, url, host, numeric AND (p[1] IN (0, 10, 127) OR (p[1] = 100 AND p[2] BETWEEN 64 AND 127) OR (p[1] = 169 AND p[2] = 254) OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) OR (p[1] = 192 AND p[2] = 0 AND p[3] = 0) OR (p[1] = 198 AND p[2] IN (18, 19)) OR p[1] >= 224) AS private FROM o)
SELECT id, CASE WHEN regexp_matches(url, '^https?://', 'i') AND NOT contains(host, '@') AND host <> 'localhost' AND NOT host LIKE '%.local' AND NOT coalesce(private, false) THEN regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-zA-Z]+://)[^/]*', '\\1' || host), '^([a-z]+://[^/]*)$', '\\1/') END AS safe FROM x""")
def p_public_urls(spark, sf_dir):
    return _ADDRESSES(spark).select("id", U.public_url(F.col("url")).alias("safe"))


# Links

_FETCHED = [
    ("https://one.org/a", 200, None, '<a href="https://x.net/">no</a><a href="https://www.own.com/p" rel="NOFOLLOW">' + "long " * 60 + '</a><a href="https://own.com/q">second</a>'),
    ("https://one.org/b", 500, None, '<a href="https://own.com/q">live?</a>'),
    ("https://two.net/", 200, None, '<a href="/x">none</a>'),
    ("https://sub.own.com/", 200, None, '<a href="https://own.com/">own</a>'),
    ("https://gone.io/", None, "fetch failed", None),
]
_LINK_PAGES = Rows("fetched", "url string, status int, error string, html string", _FETCHED)
_EVIDENCE = f"""tags AS (SELECT url, status, error, unnest(coalesce(nullif(list_filter(regexp_extract_all(coalesce(html, ''), '<a\\b[^>]*>.*?</a>', 0, 'is'), lambda t: regexp_matches(t, 'href="https://([a-z]+\\.)?own\\.com/')), []), [''])) AS tag, generate_subscripts(coalesce(nullif(list_filter(regexp_extract_all(coalesce(html, ''), '<a\\b[^>]*>.*?</a>', 0, 'is'), lambda t: regexp_matches(t, 'href="https://([a-z]+\\.)?own\\.com/')), []), ['']), 1) AS n FROM fetched),
e AS (SELECT url AS source_url, regexp_extract(url, '([a-z]+\\.[a-z]+)/', 1) AS root, status, error, tag, {_attr('tag', 'href')} AS target, lower({_attr('tag', 'rel')}) AS rel, left({_strip('tag')}, 180) AS anchor FROM tags WHERE n = 1),
evidence AS (SELECT source_url, CASE WHEN error IS NULL THEN root END AS source_domain, nullif(target, '') AS target_url, anchor, rel, tag <> '' AND NOT regexp_matches(rel, 'nofollow|sponsored|ugc') AS follow, tag <> '' AND status BETWEEN 200 AND 299 AS live, tag = '' AND error IS NULL AS no_link_found, status AS http_status, error FROM e WHERE error IS NOT NULL OR root <> 'own.com')"""


def _evidence(spark: SparkSession) -> DataFrame:
    return links.verify(pages.page_facts(_LINK_PAGES(spark)), "own.com")


@query(f"WITH {_LINK_PAGES.sql}, {_EVIDENCE} SELECT * REPLACE (coalesce(live, false) AS live) FROM evidence")
def j_verify_links(spark, sf_dir):
    return _evidence(spark)


@query(f"""WITH {_LINK_PAGES.sql}, {_EVIDENCE}, united AS (SELECT source_url, target_url, anchor, coalesce(live, false) AS live, http_status, rel FROM evidence UNION ALL SELECT source_url, target_url, anchor, true, 299, 'later' FROM evidence WHERE target_url IS NOT NULL)
SELECT source_url, target_url, anchor, live, http_status, rel FROM (SELECT *, row_number() OVER (PARTITION BY source_url, target_url, anchor ORDER BY live DESC, http_status NULLS LAST, rel) AS n FROM united) WHERE n = 1""")
def u_merge_batches(spark, sf_dir):
    rows = _evidence(spark).select("source_url", "target_url", "anchor", "live", "http_status", "rel")
    later = rows.where("target_url is not null").withColumns({"live": F.lit(True), "http_status": F.lit(299), "rel": F.lit("later")})
    return links.merge_batches(rows, later)


@query(r"""SELECT target, count(*)::BIGINT AS links FROM (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS target FROM (SELECT url, unnest(regexp_extract_all(html, '<a\b[^>]*>', 0, 'i')) AS a FROM pages)) GROUP BY target ORDER BY links DESC, target LIMIT 20""")
def a_target_links(spark, sf_dir):
    rows = pages.page_facts(table(spark, sf_dir, "pages")).select(F.explode("links").alias("x")).select(F.col("x.url").alias("target"))
    return links.grouped(rows, "target", 20)


_ACCOUNT_ROWS = [("acc", [("2", "Two", [("WEB_DATA_STREAM", "https://www.own.com"), ("APP", "x"), ("WEB_DATA_STREAM", "https://www.own.com")]), ("1", "One", [("WEB_DATA_STREAM", "https://else.org")])]), ("none", [("3", "Three", [])])]


@query("SELECT * FROM (VALUES ('1', 'One', 'acc', ['https://else.org'], false), ('2', 'Two', 'acc', ['https://www.own.com'], true), ('3', 'Three', 'none', []::VARCHAR[], false)) t(id, name, account, urls, recommended)")
def j_properties(spark, sf_dir):
    rows = spark.createDataFrame(_ACCOUNT_ROWS, "account string, properties array<struct<id:string,name:string,streams:array<struct<type:string,uri:string>>>>")
    return links.match_properties(links.properties(rows), F.lit("blog.own.com"))


# Crawl inputs

_ROBOTS = Rows("robots", "origin string, body string", [("https://a.com", "User-agent: *\nSitemap: https://a.com/1.xml \nsitemap:https://a.com/2.xml\n# Sitemap: no\n"), ("https://b.com", "Disallow: /")])


@query(f"WITH {_ROBOTS.sql}, l AS (SELECT origin, unnest(list_filter(string_split(body, chr(10)), lambda x: lower(x) LIKE 'sitemap:%')) AS line, generate_subscripts(list_filter(string_split(body, chr(10)), lambda x: lower(x) LIKE 'sitemap:%'), 1) AS n FROM robots) SELECT origin, trim(substr(line, 9)) AS url, (1 - n)::INTEGER AS ord FROM l")
def s_robots(spark, sf_dir):
    return W.robots_sitemaps(_ROBOTS(spark))


_FILES = Rows(
    "files",
    "url string, body string",
    [("https://a.com/s0.xml", "<sitemapindex><loc>https://a.com/s1.xml</loc><loc>https://a.com/s2.xml</loc><loc>https://a.com/s0.xml</loc></sitemapindex>"), ("https://a.com/s1.xml", "<urlset><loc> https://a.com/x?a=1&amp;b=2 </loc><loc>https://a.com/y</loc></urlset>"), ("https://a.com/s2.xml", "<urlset><loc>https://a.com/y</loc><loc>https://b.com/z</loc><loc>https://a.com/z</loc></urlset>")],
)
_SEEDS = Rows("seeds", "url string, ord int", [("https://a.com/s0.xml", 0), ("https://a.com/s2.xml", 1)])
_WALK = """index AS (SELECT s.url AS seed, s.ord, f.body FROM seeds s JOIN files f USING (url)), leaves AS (SELECT DISTINCT x AS url FROM (SELECT seed AS x FROM index WHERE body NOT LIKE '<sitemapindex%' UNION ALL SELECT unnest(regexp_extract_all(body, '<loc>(.*?)</loc>', 1)) FROM index WHERE body LIKE '<sitemapindex%')),
listed AS (SELECT DISTINCT replace(trim(unnest(regexp_extract_all(body, '<loc>(.*?)</loc>', 1))), '&amp;', '&') AS url FROM leaves JOIN files USING (url) WHERE body LIKE '<urlset%')"""


@query(f"WITH {_SEEDS.sql}, {_FILES.sql}, {_WALK} SELECT url FROM listed WHERE url LIKE 'https://a.com/%'")
def s_sitemap_all(spark, sf_dir):
    return W.sitemap_urls(_SEEDS(spark), _FILES(spark)).select("url")


@query("SELECT * FROM (VALUES ('https://a.com/y'), ('https://a.com/z')) t(url)")
def s_sitemap_capped(spark, sf_dir):
    return W.sitemap_urls(_SEEDS(spark).where("ord = 1"), _FILES(spark), max_seeds=10, max_files=30).select("url")


@query("WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS ord FROM pages GROUP BY 1) SELECT 'https://start.com/' AS url UNION ALL (SELECT url FROM p ORDER BY lpad(ord::VARCHAR, 10, '0'), url LIMIT 24)")
def s_discover(spark, sf_dir):
    start = spark.createDataFrame([("https://start.com/#a",)], "url string")
    listed = table(spark, sf_dir, "pages").select("url", F.lpad(F.col("page_id").cast("string"), 10, "0").alias("ord"))
    return W.discover(start, listed, listed.limit(0), 25).select("url")


_SERP = Rows("serp", "engine string, target string, body string", [("duckduckgo", "www.own.com", '<a rel="x" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fone.org%2Fp&amp;rut=1">a</a><a class="result__a big" href="https://own.com/">b</a><a class="result__a" href="https://one.org/p">again</a>'), ("bing", "www.own.com", '<li class="b_algo"><h2><a href="https://two.net/x#y">t</a></h2></li><li class="b_ad"><a href="https://ad.com/">ad</a></li>')])


@query("SELECT * FROM (VALUES ('duckduckgo', 'www.own.com', 'https://one.org/p', 0), ('bing', 'www.own.com', 'https://two.net/x', 0)) t(engine, target, url, ord)")
def s_search_results(spark, sf_dir):
    return W.search_results(_SERP(spark))


def _event(action: str, day: str) -> str:
    return json.dumps({"events": [{"eventAction": "last changed", "eventDate": "2024-01-01T00:00:00Z"}, {"eventAction": action, "eventDate": day}]})


_REGISTRY = Rows("registry", "domain string, body string", [("old.com", _event("registration", "2001-06-01T00:00:00Z")), ("new.com", _event("registered", "2024-05-01T00:00:00Z")), ("future.com", _event("registration", "2030-01-01T00:00:00Z")), ("odd.com", "{}"), ("bad.com", "x")])


@query(f"""WITH {_REGISTRY.sql}, d AS (SELECT domain, json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END, '$.events[1].eventDate') AS registered FROM registry), y AS (SELECT *, greatest(0, (epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(TRY_CAST(replace(replace(registered, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 31557600) AS years FROM d)
SELECT domain, registered, CASE WHEN registered IS NULL THEN NULL WHEN years < 1 THEN '<1 year' ELSE floor(years)::BIGINT || ' years' END AS label FROM y""")
def s_domain_age(spark, sf_dir):
    return W.domain_age(_REGISTRY(spark), "2025-01-01T00:00:00Z").select("domain", "registered", "label")


_CDX = Rows("cdx", "domain string, line string, ord int", [("a.com", json.dumps({"url": f"https://a.com/{k}", "timestamp": f"2024010{k}", "status": "200", "mime": "text/html"}), k) for k in range(5)] + [("a.com", "not json", 5), ("b.com", json.dumps({"url": "https://b.com/", "timestamp": "1", "status": "404", "mime": None}), 0)])


@query(f"WITH {_CDX.sql}, j AS (SELECT domain, ord, CASE WHEN json_valid(line) THEN line END AS l FROM cdx), r AS (SELECT domain, l->>'$.url' AS url, l->>'$.timestamp' AS timestamp, l->>'$.status' AS status, l->>'$.mime' AS mime, ord, row_number() OVER (PARTITION BY domain ORDER BY ord) AS n FROM j WHERE l IS NOT NULL) SELECT * EXCLUDE (n) FROM r WHERE n <= 3")
def s_archive(spark, sf_dir):
    return W.archive_rows(_CDX(spark), 3)


@query("SELECT n_name AS domain, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 10.0::DOUBLE END AS page_rank, CASE WHEN n_nationkey % 2 <> 0 THEN 'not ranked' END AS reason FROM nation")
def s_domain_ranks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return W.domain_ranks(n.select(F.col("n_name").alias("domain")), n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("domain"), (F.col("n_nationkey") / 10).alias("page_rank")))


@query("""SELECT '{' || chr(10) || '  "r_regionkey" : ' || r_regionkey || ',' || chr(10) || '  "r_name" : "' || r_name || '"' || chr(10) || '}' AS json FROM region""")
def s_json_text(spark, sf_dir):
    return sinks.json_text(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("""SELECT c_name AS "Name", upper(c_mktsegment) AS "Segment" FROM customer""")
def p_project(spark, sf_dir):
    return sinks.project(table(spark, sf_dir, "customer"), [("Name", "c_name"), ("Segment", F.upper("c_mktsegment"))])


@query("SELECT r_name AS name, r_regionkey AS region, NULL::INTEGER AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
def u_union_by_name(spark, sf_dir):
    return sinks.united(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")))


_CSV = Rows("csvs", "filename string, body string", [("a.csv", "Source URL,Target URL\nhttps://one.org/x,https://own.com/\nhttps://two.org/,https://own.com/b\n"), ("b.csv", "Site,Links\nthree.net,4\nfour.net,5\n"), ("c.txt", "nothing here\n")])


@query("SELECT * FROM (VALUES ('a.csv', 2, 0, 2, 0, 'source-pages'), ('b.csv', 0, 2, 0, 0, 'referring-domains'), ('c.txt', 0, 0, 0, 1, 'unrecognised')) t(filename, source, domain, target, ignored, file_kind)")
def d_file_kinds(spark, sf_dir):
    got = delimited.kinds(delimited.classify(_CSV(spark)))
    return got.select("filename", *[F.col(c).cast("int").alias(c) for c in ("source", "domain", "target", "ignored")], "file_kind")


@query("SELECT event_type AS filename, kind, value, ord FROM (SELECT event_type, 'source' AS kind, user_id::VARCHAR AS value, event_id AS ord, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 7")
def d_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("filename"), F.lit("source").alias("kind"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("ord"))
    return delimited.capped(rows, {"source": 7})
