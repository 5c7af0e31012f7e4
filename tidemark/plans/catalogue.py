"""The registered queries of the library's own operators, with the SQL that gives the same rows.

Where the test tables stand for web data by analogy (events for impressions and clicks, account balances for measurements),
the query says so.  Where they have no such markup at all, small literal tables are used in both."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import audit, links, normalise, pages, performance, periods
from tidemark.sources import delimited, sinks
from tidemark.sources import web as W
from tidemark.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, dealt to all cores only if a scan has fewer splits than there are, as with single files of one row group."""
    rows = table(spark, sf_dir, "pages")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_facts(web_pages(spark, sf_dir))


# SQL that several queries share.  RE2 knows no backreference, so script, style and noscript are removed one by one.
_S = r"[\s\x{A0}]"
_DROP = "html"
for _tag in ("script", "style", "noscript"):
    _DROP = f"regexp_replace({_DROP}, '<{_tag}.*?</{_tag}>', ' ', 'gis')"


def _strip(x: str, body: bool = True) -> str:
    x = x if not body else x
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, said in (("nbsp", " "), ("amp", "&"), ("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">")):
        x = f"regexp_replace({x}, '&{name};', '{said}', 'gi')"
    return f"regexp_replace(regexp_replace({x}, '{_S}+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"


_TEXT = _strip(_DROP)
_TITLE = _strip(r"regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'is')")
_H1 = f"list_filter(list_transform(regexp_extract_all(html, '<h1\\b[^>]*>(.*?)</h1>', 1, 'is'), lambda x: {_strip('x')}), lambda x: x <> '')"
_LANG = r"regexp_extract(regexp_extract(html, '<html\b[^>]*>', 0, 'i'), 'lang\s*=\s*[\x22'']([^\x22'']*)', 1, 'i')"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))"
_ROOT = f"array_to_string(list_slice(string_split(regexp_replace({_HOST}, '^www\\.', ''), '.'), -2, -1), '.')"
_NORM = r"regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?]+)(\?.*)?$', '\1/\2')"
_FACTS = f"""facts AS (SELECT page_id, url, {_TITLE} AS title, {_H1} AS h1, {_LANG} AS lang, CASE WHEN {_TEXT} = '' THEN 0 ELSE len(string_split({_TEXT}, ' ')) END AS words,
  len(regexp_extract_all(html, '<a\\b[^>]*>.*?</a>', 0, 'is')) AS n_links FROM pages)"""
_FINDINGS = f"""{_FACTS}, findings AS (
  SELECT url, 'Technical SEO' AS category, 'critical' AS severity, 'viewport' AS code FROM facts
  UNION ALL SELECT url, 'Technical SEO', 'warning', 'lang' FROM facts WHERE lang = ''
  UNION ALL SELECT url, 'Structured Data', 'warning', 'schema-missing' FROM facts
  UNION ALL SELECT url, 'On-page SEO', 'critical', 'title-missing' FROM facts WHERE title = ''
  UNION ALL SELECT url, 'On-page SEO', 'warning', 'title-length' FROM facts WHERE title <> '' AND NOT length(title) BETWEEN 30 AND 65
  UNION ALL SELECT url, 'On-page SEO', 'critical', 'description-missing' FROM facts
  UNION ALL SELECT url, 'On-page SEO', CASE WHEN len(h1) = 0 THEN 'critical' ELSE 'warning' END, 'h1' FROM facts WHERE len(h1) <> 1
  UNION ALL SELECT url, 'Content', 'warning', 'thin-content' FROM facts WHERE words < 180
  UNION ALL SELECT url, 'Social & Sharing', 'warning', 'og-incomplete' FROM facts)"""
_COMMERCIAL, _SUPPORT = "(service|product|category|shop|pricing|contact|location|booking|quote)", "(blog|guide|resource|faq|about|privacy|terms)"
_PRIORITY = f"CASE WHEN regexp_matches(url, '{_COMMERCIAL}', 'i') OR n_links >= 10 OR words >= 900 THEN 'High' WHEN regexp_matches(url, '{_SUPPORT}', 'i') OR words >= 350 THEN 'Medium' ELSE 'Low' END"


@query(f"WITH {_FACTS} SELECT page_id, url, title, lang, words::INTEGER AS word_count, len(h1)::INTEGER AS n_h1, n_links::INTEGER AS n_links FROM facts")
def e_page_facts(spark, sf_dir):
    return facts(spark, sf_dir).select("page_id", "url", "title", "lang", "word_count", F.size("h1").alias("n_h1"), F.size("links").alias("n_links"))


@query(rf"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS link_url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\b[^>]*>', 0, 'i')) AS a FROM pages)""")
def e_links_explode(spark, sf_dir):
    return facts(spark, sf_dir).select("page_id", F.explode("links").alias("x")).select("page_id", F.col("x.url").alias("link_url"))


@query(rf"""SELECT {_HOST} AS host, count(*)::BIGINT AS links FROM (SELECT url, unnest(regexp_extract_all(html, '<a\b[^>]*>', 0, 'i')) AS a FROM pages) GROUP BY 1""")
def e_link_counts(spark, sf_dir):
    rows = facts(spark, sf_dir).select("final_url", F.explode("links").alias("x")).where(U.same_origin(F.col("x.url"), F.col("final_url")))
    return rows.groupBy(U.host(F.col("final_url")).alias("host")).agg(F.count("*").alias("links"))


@query("SELECT doc_id, words::INTEGER AS words, words < 180 AS thin FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> '')) AS words FROM documents)")
def e_text_words(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"[ \t\n]+", -1), lambda x: x != ""))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), (words < 180).alias("thin"))


@query(f"SELECT page_id, {_HOST} AS host, {_ROOT} AS root FROM pages")
def r_root_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.root_domain(U.host(F.col("url"))).alias("root"))


@query(f"SELECT page_id, {_NORM} AS url FROM pages")
def r_normalise_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url")).alias("url"))


@query(f"SELECT {_ROOT} AS root, count(*)::BIGINT AS pages, count(DISTINCT {_HOST})::BIGINT AS hosts FROM pages GROUP BY 1")
def r_host_rollup(spark, sf_dir):
    h = U.host(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(U.root_domain(h).alias("root")).agg(F.count("*").alias("pages"), F.count_distinct(h).alias("hosts"))


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def k_audit_findings(spark, sf_dir):
    return audit.findings(facts(spark, sf_dir)).select("url", "category", "severity", "code")


@query(f"WITH {_FINDINGS} SELECT code, severity, count(*)::BIGINT AS findings FROM findings GROUP BY ALL")
def k_findings_by_code(spark, sf_dir):
    return audit.severity_counts(audit.findings(facts(spark, sf_dir)), "code", "severity").select("code", "severity", "findings")


@query(f"""WITH {_FINDINGS} SELECT category, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'warning')::BIGINT AS warnings,
  greatest(0, 100 - 18 * count_if(severity = 'critical') - 7 * count_if(severity = 'warning'))::BIGINT AS health FROM findings GROUP BY category""")
def k_category_health(spark, sf_dir):
    return audit.category_health(audit.findings(facts(spark, sf_dir)))


@query(f"""WITH {_FINDINGS}, c AS (SELECT count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'warning')::BIGINT AS warnings, (SELECT count(*) FROM pages)::BIGINT AS pages FROM findings)
SELECT pages, critical, warnings, greatest(0, floor(100 - (8 * critical + 2.2::DOUBLE * warnings) / greatest(1, pages) * 10 + 0.5))::BIGINT AS health FROM c""")
def k_site_health(spark, sf_dir):
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"))
    return audit.site_health(audit.findings(facts(spark, sf_dir)), n)


@query(f"""WITH {_FINDINGS}, c AS (SELECT url, count(*) AS issues, count_if(severity = 'critical') AS critical, count_if(severity = 'warning') AS warnings FROM findings GROUP BY url)
SELECT f.url, title, words::INTEGER AS word_count, n_links::INTEGER AS internal_links, issues::BIGINT AS issues, critical::BIGINT AS critical, warnings::BIGINT AS warnings, {_PRIORITY.replace("url,", "f.url,")} AS priority FROM facts f JOIN c ON c.url = f.url""")
def k_page_inventory(spark, sf_dir):
    # a row without URL finds no counts, as in the SQL's join
    return audit.inventory(facts(spark, sf_dir)).where("url is not null").select("url", "title", "word_count", "internal_links", "issues", "critical", "warnings", "priority")


@query(f"""WITH {_FACTS}, p AS (SELECT {_PRIORITY} AS priority FROM facts), l(ord, priority) AS (VALUES (0, 'High'), (1, 'Medium'), (2, 'Low'))
SELECT ord, l.priority, count(p.priority)::BIGINT AS pages FROM l LEFT JOIN p ON p.priority = l.priority GROUP BY ALL""")
def k_priority_levels(spark, sf_dir):
    rows = facts(spark, sf_dir).select(audit.priority(F.col("final_url"), F.size("links"), F.col("word_count")).alias("priority"))
    return audit.priority_levels(rows)


@query("SELECT user_id, event_id, event_type, first_at FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def u_dedupe_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return links.last_of_each(rows.withColumn("at", F.col("event_id")), "user_id", "at").select("user_id", "event_id", "event_type", "first_at")


@query("""SELECT source_url, target_url, anchor, live, http_status, rel FROM (SELECT *, row_number() OVER (PARTITION BY source_url, target_url, anchor ORDER BY live DESC, http_status, rel) AS n
FROM (SELECT user_id::VARCHAR AS source_url, event_type AS target_url, '' AS anchor, value > 100 AS live, (event_id % 500)::INTEGER AS http_status, props AS rel FROM events)) WHERE n = 1""")
def u_dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_url"), F.col("event_type").alias("target_url"), F.lit("").alias("anchor"), (F.col("value") > 100).alias("live"), (F.col("event_id") % 500).cast("int").alias("http_status"), F.col("props").alias("rel"))
    return links.dedupe(rows)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def l_page_window(spark, sf_dir):
    return periods.paged(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], page=3, size=50)


_CUR, _PREV = periods.Range(date(2024, 1, 16), date(2024, 1, 30)), periods.Range(date(2024, 1, 16), date(2024, 1, 30)).previous()
_IN = {"cur": "ts >= DATE '2024-01-16' AND ts < DATE '2024-01-31'", "prev": "ts >= DATE '2024-01-01' AND ts < DATE '2024-01-16'"}


def _change(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} <> 0 THEN 100.0 ELSE 0.0 END ELSE ({a} - {b}) / abs({b}) * 100 END"


def _events(spark, sf_dir) -> DataFrame:
    """Events as facts: a view is an impression, a click a click."""
    rows = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", (F.col("event_type") == "view").cast("double").alias("impressions"), (F.col("event_type") == "click").cast("double").alias("clicks"))
    return periods.tagged(rows, "ts", _CUR, _PREV)


_SUMS = ", ".join(f"coalesce(sum(CASE WHEN event_type = '{e}' AND {_IN[p]} THEN 1.0::DOUBLE ELSE 0 END), 0)::DOUBLE AS {q}_{m}" for m, e in (("impressions", "view"), ("clicks", "click")) for p, q in (("cur", "current"), ("prev", "previous")))
_CHANGES = ", ".join(f"round({_change(f'current_{m}', f'previous_{m}')}, 6)::DOUBLE AS change_{m}" for m in ("impressions", "clicks"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("change_") else F.col(c) for c in df.columns])


@query(f"WITH s AS (SELECT {_SUMS} FROM events) SELECT *, {_CHANGES} FROM s")
def t_period_totals(spark, sf_dir):
    return _rounded(periods.totals(_events(spark, sf_dir), ["impressions", "clicks"]))


@query(f"SELECT ts::DATE AS day, sum((event_type = 'view')::INT)::DOUBLE AS impressions, sum((event_type = 'click')::INT)::DOUBLE AS clicks FROM events WHERE {_IN['cur']} GROUP BY 1")
def t_daily_trend(spark, sf_dir):
    return periods.daily(_events(spark, sf_dir), "ts", ["impressions", "clicks"], "current")


@query(f"""WITH d AS (SELECT ts::DATE AS day, sum((event_type = 'view')::INT)::DOUBLE AS v, {_IN['cur']} AS c FROM events WHERE ({_IN['cur']}) OR ({_IN['prev']}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY day)::INTEGER AS n FROM d)
SELECT a.n, a.day AS current_day, a.v AS current_impressions, b.day AS previous_day, b.v AS previous_impressions FROM r a LEFT JOIN r b ON b.n = a.n AND NOT b.c WHERE a.c""")
def t_trend_aligned(spark, sf_dir):
    return periods.aligned(_events(spark, sf_dir), "ts", ["impressions"], _CUR, _PREV)


@query(f"WITH s AS (SELECT user_id AS key, {_SUMS}, count_if({_IN['cur']}) AS n FROM events GROUP BY user_id) SELECT * EXCLUDE (n), {_CHANGES} FROM s WHERE n > 0")
def t_dimension_change(spark, sf_dir):
    return _rounded(periods.by_dimension(_events(spark, sf_dir), "user_id", ["impressions", "clicks"]))


@query(f"""WITH s AS (SELECT c_mktsegment AS key, sum(CASE WHEN year(o_orderdate) = 1997 THEN 1.0::DOUBLE ELSE 0 END)::DOUBLE AS current_orders, sum(CASE WHEN year(o_orderdate) = 1996 THEN 1.0::DOUBLE ELSE 0 END)::DOUBLE AS previous_orders
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1)
SELECT key, current_orders, previous_orders, round({_change('current_orders', 'previous_orders')}, 6)::DOUBLE AS change_orders FROM s WHERE current_orders > 0""")
def t_segment_change(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.lit(1.0).alias("orders"))
    rows = periods.tagged(rows, "o_orderdate", periods.Range(date(1997, 1, 1), date(1997, 12, 31)), periods.Range(date(1996, 1, 1), date(1996, 12, 31)))
    rows = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return _rounded(periods.by_dimension(rows, "c_mktsegment", ["orders"]))


@query("""WITH s AS (SELECT user_id AS key, sum((event_type = 'view')::INT)::DOUBLE * 20 AS impressions, sum((event_type = 'click')::INT)::DOUBLE AS clicks, (user_id % 30)::DOUBLE AS position FROM events GROUP BY user_id),
r AS (SELECT key, impressions, position, CASE WHEN impressions = 0 THEN 0 ELSE clicks / impressions END AS ctr FROM s)
SELECT * FROM (SELECT 'low_ctr' AS list, key, impressions, position, round(ctr, 6) AS ctr FROM r WHERE impressions >= 50 AND ctr < 0.02 ORDER BY impressions DESC, key LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'near_top' AS list, key, impressions, position, round(ctr, 6) AS ctr FROM r WHERE position BETWEEN 4 AND 10 ORDER BY impressions DESC, key LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'second_page' AS list, key, impressions, position, round(ctr, 6) AS ctr FROM r WHERE position > 10 AND position <= 20 ORDER BY impressions DESC, key LIMIT 10)""")
def t_opportunities(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg((F.sum((F.col("event_type") == "view").cast("double")) * 20).alias("impressions"), F.sum((F.col("event_type") == "click").cast("double")).alias("clicks"))
    rows = s.select("key", "impressions", (F.col("key") % 30).cast("double").alias("position"), N.ratio(F.col("clicks"), F.col("impressions")).alias("ctr"))
    lists = [x.select(F.lit(name).alias("list"), "key", "impressions", "position", F.round("ctr", 6).alias("ctr")) for name, x in periods.opportunities(rows).items()]
    return sinks.united(*lists)


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j_left_zero_fill(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return periods.zero_filled(table(spark, sf_dir, "customer").select("c_custkey"), n, ["orders"], "c_custkey")


@query("SELECT count(*)::BIGINT AS urls_with_impressions FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j_semi_impressions(spark, sf_dir):
    perf = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") > 200000).cast("int").alias("impressions"))
    return periods.with_impressions(table(spark, sf_dir, "customer").select("c_custkey"), perf, "c_custkey")


@query(f"SELECT page_id AS id, {_ROOT} = 'example.org' AS recommended FROM pages")
def j_root_match(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array("url").alias("urls"))
    return links.match_properties(rows, F.lit("shop.example.org")).select("id", "recommended")


@query(f"SELECT {_HOST} AS source_domain, count(*)::BIGINT AS links FROM pages GROUP BY 1 ORDER BY links DESC, 1 LIMIT 12")
def a_domain_links(spark, sf_dir):
    return links.grouped(table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("source_domain")), "source_domain", 12)


_LINKS = f"l AS (SELECT {_HOST} AS source_domain, page_id % 3 <> 0 AS live, page_id % 4 <> 0 AS follow FROM pages), g AS (SELECT source_domain, count(*) AS n, count_if(live) AS l, count_if(live AND follow) AS f FROM l GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS candidates, sum(l)::BIGINT AS live, count_if(l > 0)::BIGINT AS domains, sum(f)::BIGINT AS follow, max(l)::BIGINT AS largest FROM g)"


def _link_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("source_domain"), (F.col("page_id") % 3 != 0).alias("live"), (F.col("page_id") % 4 != 0).alias("follow"), F.lit(False).alias("no_link_found"))


@query(f"WITH {_LINKS} SELECT candidates, live, domains, follow, live - follow AS nofollow, candidates - live AS unverified, round(follow / live, 6) AS follow_ratio, round(largest / live, 6) AS concentration FROM s")
def a_concentration(spark, sf_dir):
    s = links.summary(_link_rows(spark, sf_dir))
    return s.select(*[F.round(c, 6).alias(c) if c in ("follow_ratio", "concentration") else F.col(c) for c in s.columns])


@query(f"""WITH {_LINKS} SELECT live, domains, greatest(0, least(100, floor(8 * domains + least(22, 2 * live) + 16 * (follow / live) + 4 * 2.5 - greatest(0, 28 * (largest / live - 0.45)) + 0.5)))::BIGINT AS authority,
CASE WHEN candidates = 0 THEN 'Insufficient evidence' WHEN live >= 20 THEN 'High' WHEN live >= 5 THEN 'Medium' ELSE 'Low' END AS confidence FROM s""")
def k_link_authority(spark, sf_dir):
    return links.authority(links.summary(_link_rows(spark, sf_dir)), 2.5).select("live", "domains", "authority", "confidence")


_METRIC = "CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'purchase' THEN 'CLS' WHEN 'signup' THEN 'TTFB' ELSE 'SI' END"


@query(f"""WITH m AS (SELECT {_METRIC} AS metric, value * 10 AS value FROM events), l(metric, good, fair) AS (VALUES ('LCP', 2500.0, 4000.0), ('INP', 200.0, 500.0), ('CLS', 0.1, 0.25), ('TTFB', 800.0, 1800.0))
SELECT m.metric, CASE WHEN good IS NULL OR value IS NULL THEN 'unknown' WHEN value <= good THEN 'good' WHEN value <= fair THEN 'needs-improvement' ELSE 'poor' END AS bucket, count(*)::BIGINT AS n FROM m LEFT JOIN l USING (metric) GROUP BY ALL""")
def k_metric_buckets(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.expr(_METRIC).alias("metric"), (F.col("value") * 10).alias("value"))
    return m.groupBy("metric", N.metric_bucket(F.col("metric"), F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


_DIAGNOSTICS = [("u1", "m", 0, "unused-javascript", 300.0, 90000.0), ("u1", "m", 1, "render-blocking-resources", 390.0, 0.0), ("u1", "m", 2, "bootup-time", 100.0, 0.0), ("u2", "m", 0, "layout-shifts", 0.0, 0.0), ("u2", "m", 1, "unused-javascript", 0.0, 5000.0)]
_DIAGNOSTICS_SQL = "d(url, strategy, ord, id, savings_ms, savings_bytes) AS (VALUES " + ", ".join(f"('{u}', '{s}', {o}, '{i}', {m}::DOUBLE, {b}::DOUBLE)" for u, s, o, i, m, b in _DIAGNOSTICS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY url, strategy ORDER BY savings_ms + savings_bytes / 1000 DESC, ord)::INTEGER AS rank FROM d)"


def _diagnostics(spark) -> DataFrame:
    return performance.ranked(spark.createDataFrame(_DIAGNOSTICS, "url string, strategy string, ord int, id string, savings_ms double, savings_bytes double"))


@query(f"WITH {_DIAGNOSTICS_SQL} SELECT url, id, rank FROM r")
def l_ranked_diagnostics(spark, sf_dir):
    return _diagnostics(spark).select("url", "id", "rank")


def _causes_sql(causes: dict[str, list[str]]) -> str:
    return "c(metric, id, preference) AS (VALUES " + ", ".join(f"('{m}', '{i}', {k})" for m, ids in causes.items() for k, i in enumerate(ids)) + ")"


_CAUSES = {"LCP": ["largest-contentful-paint-element", "server-response-time", "render-blocking-resources", "uses-optimized-images", "uses-responsive-images"], "CLS": ["layout-shifts"], "INP": ["long-tasks", "bootup-time", "mainthread-work-breakdown", "unused-javascript"]}
_RANKED_CAUSES = {"LCP": ["largest-contentful-paint-element", "server-response-time", "render-blocking-resources"], "CLS": ["layout-shifts"], "INP": ["long-tasks", "unused-javascript", "bootup-time", "mainthread-work-breakdown"]}


@query(f"WITH {_DIAGNOSTICS_SQL}, {_causes_sql(_CAUSES)} SELECT url, metric, arg_min(id, preference) AS cause FROM r JOIN c USING (id) GROUP BY ALL")
def j_primary_cause(spark, sf_dir):
    return performance.primary_cause(_diagnostics(spark)).select("url", "metric", "cause")


@query(f"WITH {_DIAGNOSTICS_SQL}, {_causes_sql(_RANKED_CAUSES)} SELECT url, metric, arg_min(id, rank) AS cause FROM r JOIN c USING (id) GROUP BY ALL")
def j_ranked_cause(spark, sf_dir):
    return performance.primary_cause(_diagnostics(spark), by_rank=True).select("url", "metric", "cause")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def n_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k"))


@query("""SELECT * FROM (VALUES ('a.csv', 'source', 'https://blog.one.com/x'), ('a.csv', 'target', 'https://shop.com/'), ('a.csv', 'source', 'https://four.io/'), ('b.txt', 'source', 'https://www.two.org/'), ('b.txt', 'source', 'https://three.net/p,q'),
('b.txt', 'target', 'https://m.shop.com/z'), ('b.txt', 'ignored', ''), ('c.csv', 'domain', 'five.co.uk'), ('c.csv', 'target', 'https://other.shop.com/')) t(filename, kind, value)""")
def d_import_classify(spark, sf_dir):
    files = [
        ("a.csv", "\ufeffSource URL;Target URL;Last crawled\r\nblog.one.com/x;shop.com#f;3\r\n\r\nn/a;-;four.io\r\n", "https://www.shop.com/"),
        ("b.txt", 'www.two.org\n"https://three.net/p,q"\nm.shop.com/z\nnothing here\n', "https://www.shop.com/"),
        ("c.csv", "Site,Links\nblog.five.co.uk,1\nother.shop.com,2.5\n", "https://www.shop.com/"),
    ]
    got = delimited.classify(spark.createDataFrame(files, "filename string, body string, target_url string"))
    return got.select("filename", "kind", "value")


@query("""SELECT * FROM (VALUES ('s1', 'a', 'COMMERCIAL', '1K–5K', 'High', 100), ('s1', 'b', '?', 'Unknown', 'Medium', 50), ('s2', 's2', 'Mixed', 'Unknown', 'Medium', 50), ('s3', 's3', 'Local', 'Unknown', 'Medium', 71)) t(seed, keyword, intent, demand_range, competition, opportunity)""")
def g_keyword_normalise(spark, sf_dir):
    said = '```json\n{"keywords":[{"keyword":" a ","intent":"COMMERCIAL","demandRange":"1K - 5K","competition":"high","opportunity":"140"},{"keyword":"b","intent":"?","demandRange":"1k-5k"},{"keyword":""}]}\n```'
    none = '{"primaryIntent":"Local","opportunityScore":70.5,"keywords":[]}'
    return normalise.keywords(normalise.parse(spark.createDataFrame([("s1", said), ("s2", "no answer"), ("s3", none)], "seed string, text string"), "keywords"))


@query(f"""WITH {_FINDINGS}, c AS (SELECT count_if(severity = 'critical') AS critical, count_if(severity = 'warning') AS warnings FROM findings),
a AS (SELECT greatest(0, least(100, floor(100 - (45 * critical + 20 * warnings) / greatest(1, critical + warnings) + 0.5)))::DOUBLE AS audit FROM c)
SELECT audit, floor(0.25 * 80 + 0.35 * audit + 0.2 * 60 + 0.2 * 55 + 0.5)::BIGINT AS overall FROM a""")
def k_growth_index(spark, sf_dir):
    c = audit.severity_counts(audit.findings(facts(spark, sf_dir)))
    score = c.select(audit.growth_audit_score(F.col("critical"), F.col("warnings"), F.col("passed")).cast("double").alias("audit"))
    return score.withColumn("overall", audit.growth_overall(F.lit(80), F.col("audit"), F.lit(60), F.lit(55)))


@query("SELECT o_orderpriority, n::BIGINT AS n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def w_share_of_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return periods.share_of_total(rows, "n").withColumn("share", F.round("share", 9))


@query("SELECT * FROM (VALUES ('https://a.com/p?x=1&y=2', '0000000000/0000000000/0000000000'), ('https://a.com/q', '0000000000/0000000000/0000000001')) t(url, ord)")
def s_sitemap_urls(spark, sf_dir):
    seeds = spark.createDataFrame([("https://a.com/i.xml", 0)], "url string, ord int")
    files = spark.createDataFrame([("https://a.com/i.xml", "<sitemapindex><loc>https://a.com/1.xml</loc></sitemapindex>"), ("https://a.com/1.xml", "<urlset><loc> https://a.com/p?x=1&amp;y=2 </loc><loc>https://a.com/q</loc><loc>https://b.com/</loc></urlset>")], "url string, body string")
    return W.sitemap_urls(seeds, files)


@query("""SELECT '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || c_mktsegment || '"' AS line FROM customer""")
def s_csv_lines(spark, sf_dir):
    return sinks.csv_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT client, ts, n, ts AS began, 1 AS count FROM e WHERE n = 1
  UNION ALL SELECT e.client, e.ts, e.n, CASE WHEN e.ts >= w.began + INTERVAL 600 SECOND THEN e.ts ELSE w.began END, CASE WHEN e.ts >= w.began + INTERVAL 600 SECOND THEN 1 ELSE w.count + 1 END FROM w JOIN e ON e.client = w.client AND e.n = w.n + 1)
SELECT client, 'contact' AS action, ts::VARCHAR AS ts, count <= 5 AS allowed, greatest(0, 5 - count)::INTEGER AS remaining FROM w""")
def f_limiter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.lit("contact").alias("action"), "ts")
    return limiter.limit(rows).withColumn("ts", F.col("ts").cast("string"))
