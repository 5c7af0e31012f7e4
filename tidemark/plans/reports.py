"""Queries over authored report, measurement and model answers."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.operators import audit, normalise, performance, periods, structured
from tidemark.plans.authored import _JSON, _TYPED, QUERIES, SQL, Rows
from tidemark.plans import derived
from tidemark.plans.catalogue import query, table

__all__ = ["QUERIES", "SQL", "derived"]

# Periods


@query("""SELECT * FROM (VALUES ('days', DATE '2024-01-16', DATE '2024-01-30'), ('previous', DATE '2024-01-16' - 15, DATE '2024-01-16' - 1), ('compared', DATE '2023-12-01', DATE '2024-01-15'), ('late', DATE '2024-01-01', DATE '2024-01-15'), ('odd', DATE '2024-01-01', DATE '2024-01-10'),
('last 7', DATE '2024-03-15' - 6, DATE '2024-03-15'), ('last 28', DATE '2024-03-15' - 27, DATE '2024-03-15'), ('other', DATE '2024-03-15' - 27, DATE '2024-03-15'), ('month', date_trunc('month', DATE '2024-03-15') - INTERVAL 1 MONTH, date_trunc('month', DATE '2024-03-15') - INTERVAL 1 DAY)) t(name, first_day, last_day)""")
def t_ranges(spark, sf_dir):
    current, day = periods.Range.parse("2024-01-16", "2024-01-30"), date(2024, 3, 15)
    made = {
        "days": current, "previous": current.previous(), "compared": periods.compare_range(current, "2023-12-01"), "late": periods.compare_range(current, "2024-02-01"), "odd": periods.compare_range(current, "x", "2024-01-10"),
        "last 7": periods.preset(7, day), "last 28": periods.preset(28, day), "other": periods.preset(29, day), "month": periods.preset("previous-month", day),
    }
    return spark.createDataFrame([(n, r.start, r.end) for n, r in made.items()], "name string, first_day date, last_day date").select("name", F.col("first_day").cast("timestamp_ntz").alias("first_day"), F.col("last_day").cast("timestamp_ntz").alias("last_day"))


@query("SELECT * FROM (VALUES ('search', 'device', 'device'), ('search', 'x', 'query'), ('analytics', 'city', 'city'), ('analytics', 'x', 'channel')) t(source, asked, dimension)")
def t_dimensions(spark, sf_dir):
    asked = [("search", "device"), ("search", "x"), ("analytics", "city"), ("analytics", "x")]
    return spark.createDataFrame([(s, a, periods.dimension(s, a)) for s, a in asked], "source string, asked string, dimension string")


@query("SELECT event_id, CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE value - p END AS change FROM (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE event_id / 100.0::DOUBLE END AS p FROM events)")
def t_position_change(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    previous = F.when(F.col("event_id") % 3 == 1, 0.0).when(F.col("event_id") % 3 == 2, F.col("event_id") / 100)
    return e.select("event_id", periods.position_change(F.col("value"), previous).alias("change"))


@query("SELECT user_id, n FROM (SELECT user_id, count_if(event_type = 'purchase')::BIGINT AS n FROM events GROUP BY 1) WHERE n > 0 ORDER BY n DESC, user_id LIMIT 6")
def p_top_distribution(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return periods.top_distribution(rows, "n", [F.desc("n"), F.asc("user_id")])


@query("SELECT c_custkey, greatest(1, ceil(c_custkey / 25))::BIGINT AS pages, greatest(1, least(c_nationkey, greatest(1, ceil(c_custkey / 25))))::BIGINT AS page, least(50000, c_custkey + c_nationkey + CASE WHEN c_nationkey >= 20 THEN 20 ELSE 0 END)::BIGINT AS estimate FROM customer")
def l_page_counts(spark, sf_dir):
    n = periods.page_count(F.col("c_custkey"), 25)
    page = periods.clamp_page(F.col("c_nationkey").cast("long"), n).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("pages"), page.alias("page"), periods.total_estimate(F.col("c_custkey"), F.col("c_nationkey"), 20).cast("long").alias("estimate"))


@query("SELECT user_id, n, (min(n) OVER ())::BIGINT AS min_n, (max(n) OVER ())::BIGINT AS max_n FROM (SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1)")
def a_scaled(spark, sf_dir):
    return periods.scaled(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n")


@query("SELECT event_id, (coalesce(CASE WHEN event_type <> 'click' THEN value END, 0) + coalesce(event_id % 100, 0)) / 2 AS mean FROM events")
def a_mean_performance(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", audit.mean_performance(F.when(F.col("event_type") != "click", F.col("value")), F.col("event_id") % 100).alias("mean"))


@query("""SELECT c_custkey AS url, CASE WHEN asked AND c_custkey % 2 = 0 THEN 'PASS' END AS verdict, CASE WHEN asked THEN c_custkey % 2 = 0 END AS available, CASE WHEN asked AND c_custkey % 2 <> 0 THEN 'not inspected' END AS message
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 25 AS asked FROM customer)""")
def j_inspected(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), "c_acctbal")
    seen = c.where("url % 2 = 0").select("url", F.lit("PASS").alias("verdict"), F.lit(None).cast("string").alias("message"))
    return periods.inspected(c, seen, [F.desc("c_acctbal"), F.asc("url")]).select("url", "verdict", "available", "message")


def _search(rows: list[tuple]) -> str:
    return json.dumps({"rows": [{"keys": [k], "clicks": c, "impressions": i, "ctr": r, "position": p} for k, c, i, r, p in rows]})


_GSC = Rows("gsc", "period string, body string", [("current", _search([("a", 5, 100, 0.05, 3.5), ("b", "7", "x", None, 12), ("c", 1, 400, 0.0025, 8)])), ("previous", _search([("a", 4, 50, 0.08, 5.5), ("d", 2, 3, 0.5, 1)])), ("broken", "{"), ("none", "{}")])
_GSC_ROWS = "g AS (SELECT period, unnest(json_extract(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.rows[*]')) AS x FROM gsc), r AS (SELECT period, x->>'$.keys[0]' AS key, " + ", ".join(f"coalesce(TRY_CAST(x->>'$.{m}' AS DOUBLE), 0) AS {m}" for m in ("clicks", "impressions", "ctr", "position")) + " FROM g)"


@query(f"WITH {_GSC.sql}, {_GSC_ROWS} SELECT * FROM r")
def s_search_rows(spark, sf_dir):
    return periods.search_rows(_GSC(spark)).drop("ord")


@query(f"""WITH {_GSC.sql}, {_GSC_ROWS} SELECT a.key, a.clicks, coalesce(b.clicks, 0) AS previous_clicks, round(CASE WHEN coalesce(b.clicks, 0) = 0 THEN CASE WHEN a.clicks <> 0 THEN 100 ELSE 0 END ELSE (a.clicks - b.clicks) / abs(b.clicks) * 100 END, 6) AS change_clicks, round(a.ctr, 6) AS ctr,
a.position, round(CASE WHEN coalesce(b.position, 0) = 0 THEN 0 ELSE a.position - b.position END, 6) AS change_position FROM r a LEFT JOIN r b ON b.key = a.key AND b.period = 'previous' WHERE a.period = 'current'""")
def t_search_change(spark, sf_dir):
    rows = periods.search_rows(_GSC(spark)).withColumns({"is_current": F.col("period") == "current", "is_previous": F.col("period") == "previous"})
    made = periods.by_dimension(rows, "key", ["clicks", "ctr", "position"], zero_fill=True)
    change = periods.position_change(F.col("current_position"), F.col("previous_position"))
    return made.select("key", F.col("current_clicks").alias("clicks"), "previous_clicks", F.round("change_clicks", 6).alias("change_clicks"), F.round("current_ctr", 6).alias("ctr"), F.col("current_position").alias("position"), F.round(change, 6).alias("change_position"))


_GA = Rows("ga", "period string, body string", [("current", json.dumps({"rows": [{"dimensionValues": [{"value": k}], "metricValues": [{"value": v} for v in vs]} for k, vs in (("Direct", ["10", "3", "12", "9", "0.75", "40", "2", "600.5"]), ("", ["1", "x"]))]})), ("broken", "")])
_GA_NAMES = ["activeUsers", "newUsers", "sessions", "engagedSessions", "engagementRate", "views", "keyEvents", "engagementSeconds"]


@query(f"WITH {_GA.sql}, g AS (SELECT period, unnest(json_extract(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END, '$.rows[*]')) AS x FROM ga) SELECT period, x->>'$.dimensionValues[0].value' AS key, " + ", ".join(f"""coalesce(TRY_CAST(x->>'$.metricValues[{k}].value' AS DOUBLE), 0) AS "{n}\"""" for k, n in enumerate(_GA_NAMES)) + " FROM g")
def s_analytics_rows(spark, sf_dir):
    return periods.analytics_rows(_GA(spark)).drop("ord")


# Performance


def _audit(score, ms=None, size=None, value=None, mode="numeric", items=None, title="t", description="see [docs](http://x.y) now") -> dict:
    return {"title": title, "description": description, "score": score, "scoreDisplayMode": mode, "numericValue": value, "displayValue": "v", "details": {"overallSavingsMs": ms, "overallSavingsBytes": size, "items": items or []}}


_LAB_BODY = json.dumps(
    {
        "lighthouseResult": {
            "categories": {"performance": {"score": 0.905}, "seo": {"score": 0.49}, "accessibility": {"score": None}},
            "audits": {
                "largest-contentful-paint": _audit(0.5, value=2600.0), "cumulative-layout-shift": _audit(1, value=0.05), "total-blocking-time": _audit(0.1, value=700.0), "server-response-time": _audit(0.2, ms=390.0, value=500.0),
                "unused-javascript": _audit(0.3, ms=300.0, size=90000.0, items=[{"url": "https://a.com/x.js", "totalBytes": 5000.0, "wastedBytes": 100.0}, {"node": {}}, {"url": "https://a.com/y.js", "wastedBytes": 70.0}]),
                "long-tasks": _audit(None, items=[{"url": "https://a.com/z.js"}]), "bootup-time": _audit(1, ms=50.0), "layout-shifts": _audit(0, mode="notApplicable"), "render-blocking-resources": _audit(0.6, ms=390.0),
            },
        }
    }
)
_LAB = Rows("lab", "url string, strategy string, body string", [("u1", "mobile", _LAB_BODY), ("u2", "desktop", "{broken")])
_METRICS = [("LCP", "largest-contentful-paint", 2500, 4000), ("CLS", "cumulative-layout-shift", 0.1, 0.25), ("FCP", "first-contentful-paint", 1800, 3000), ("TBT", "total-blocking-time", 200, 600), ("TTFB", "server-response-time", 800, 1800)]
_BUCKET = "CASE WHEN value IS NULL THEN 'unknown' WHEN value <= good THEN 'good' WHEN value <= fair THEN 'needs-improvement' ELSE 'poor' END"
_VALID = "CASE WHEN json_valid(body) THEN body ELSE '{}' END"


@query(f"""WITH {_LAB.sql}, c AS (SELECT url, unnest(json_keys({_VALID}, '$.lighthouseResult.categories')) AS category, body FROM lab), s AS (SELECT url, category, TRY_CAST(json_extract_string(body, '$.lighthouseResult.categories.' || category || '.score') AS DOUBLE) AS share FROM c)
SELECT url, category, floor(share * 100 + 0.5)::BIGINT AS score, CASE WHEN share IS NULL THEN 'unknown' WHEN floor(share * 100 + 0.5) >= 90 THEN 'good' WHEN floor(share * 100 + 0.5) >= 50 THEN 'needs-improvement' ELSE 'poor' END AS bucket FROM s""")
def k_lab_categories(spark, sf_dir):
    return performance.category_scores(performance.lab(_LAB(spark))).select("url", "category", "score", "bucket")


@query(f"""WITH {_LAB.sql}, m(metric, audit, good, fair) AS (VALUES {", ".join(f"('{m}', '{a}', {g}, {f})" for m, a, g, f in _METRICS)}), v AS (SELECT url, metric, good, fair, CASE WHEN json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.lighthouseResult.audits."' || audit || '".numericValue') AS DOUBLE) END AS value FROM lab, m)
SELECT url, metric, value, {_BUCKET} AS bucket FROM v WHERE url = 'u1'""")
def k_lab_metrics(spark, sf_dir):
    return performance.lab_metrics(performance.lab(_LAB(spark)).where("lab is not null")).drop("strategy")


def _field(**p75) -> str:
    return json.dumps({"record": {"metrics": {k: {"percentiles": {"p75": v}} for k, v in p75.items()}}})


_CRUX = Rows("crux", "url string, body string", [("good", _field(largest_contentful_paint=2500, interaction_to_next_paint=200, cumulative_layout_shift="0.10")), ("poor", _field(largest_contentful_paint=4001, interaction_to_next_paint=100, cumulative_layout_shift="0")), ("part", _field(first_contentful_paint=1900)), ("none", "{}")])
_FIELDS = [("LCP", "largest_contentful_paint", 2500, 4000), ("INP", "interaction_to_next_paint", 200, 500), ("CLS", "cumulative_layout_shift", 0.1, 0.25), ("FCP", "first_contentful_paint", 1800, 3000), ("TTFB", "experimental_time_to_first_byte", 800, 1800)]
_FIELD_SQL = f"""m(metric, name, good, fair) AS (VALUES {", ".join(f"('{m}', '{a}', {g}, {f})" for m, a, g, f in _FIELDS)}), v AS (SELECT url, metric, good, fair, TRY_CAST(json_extract_string(body, '$.record.metrics.' || name || '.percentiles.p75') AS DOUBLE) AS value FROM crux, m),
b AS (SELECT url, metric, value, {_BUCKET} AS bucket FROM v)"""


@query(f"WITH {_CRUX.sql}, {_FIELD_SQL} SELECT * FROM b")
def s_field_metrics(spark, sf_dir):
    return performance.field_metrics(_CRUX(spark))


@query(f"WITH {_CRUX.sql}, {_FIELD_SQL} SELECT url, CASE WHEN count(value) > 0 THEN coalesce(bool_and(bucket = 'good') FILTER (WHERE metric IN ('LCP', 'INP', 'CLS')), false) END AS passed FROM b GROUP BY url")
def a_vitals_passed(spark, sf_dir):
    return performance.vitals_passed(performance.field_metrics(_CRUX(spark)))


_AUDITS = [
    "largest-contentful-paint-element", "layout-shifts", "unused-css-rules", "unused-javascript", "render-blocking-resources", "long-tasks",
    "bootup-time", "mainthread-work-breakdown", "server-response-time", "offscreen-images", "uses-optimized-images", "uses-responsive-images",
]
_DIAGNOSED = f"""a(ord, id) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(_AUDITS))}), x AS (SELECT url, ord, id, json_extract(body, '$.lighthouseResult.audits."' || id || '"') AS a FROM lab, a WHERE json_valid(body)),
y AS (SELECT url, ord, id, a, TRY_CAST(a->>'$.score' AS DOUBLE) AS score, coalesce(TRY_CAST(a->>'$.details.overallSavingsMs' AS DOUBLE), 0) AS ms, coalesce(TRY_CAST(a->>'$.details.overallSavingsBytes' AS DOUBLE), 0) AS bytes FROM x WHERE a IS NOT NULL),
d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ms + bytes / 1000 DESC, ord)::INTEGER AS rank FROM y WHERE (score IS NULL OR score <> 1) AND a->>'$.scoreDisplayMode' <> 'notApplicable')"""


@query(f"WITH {_LAB.sql}, {_DIAGNOSED} SELECT url, id, rank, CASE WHEN score < 0.5 THEN 'poor' ELSE 'needs-improvement' END AS status, trim(regexp_replace(regexp_replace(a->>'$.description', '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '\\s+', ' ', 'g')) AS description, greatest(ms, bytes / 1000, 1) AS impact, greatest(8, least(100, greatest(ms, bytes / 1000, 1) / max(greatest(ms, bytes / 1000, 1)) OVER (PARTITION BY url) * 100)) AS width FROM d")
def p_diagnostics(spark, sf_dir):
    rows = performance.diagnostics(performance.lab(_LAB(spark))).withColumn("impact", performance.impact(F.col("savings_ms"), F.col("savings_bytes")))
    return performance.impact_width(rows, "impact").select("url", "id", "rank", "status", "description", "impact", "width")


@query(f"WITH {_LAB.sql}, {_DIAGNOSED} SELECT id, CASE id WHEN 'unused-javascript' THEN 'Remove unused bundles' WHEN 'server-response-time' THEN 'Improve hosting, cach' WHEN 'long-tasks' THEN 'Break long JavaScript' WHEN 'render-blocking-resources' THEN 'Inline critical CSS, ' END AS fix FROM d")
def k_fixes(spark, sf_dir):
    return performance.diagnostics(performance.lab(_LAB(spark))).select("id", F.substring("fix", 1, 21).alias("fix"))


@query(f"WITH {_LAB.sql}, {_DIAGNOSED}, i AS (SELECT url, id, unnest(json_extract(a, '$.details.items[*]')) AS i FROM d) SELECT url, id, coalesce(nullif(i->>'$.url', ''), nullif(i->>'$.source.url', ''), nullif(i->>'$.node.snippet', ''), '') AS resource, coalesce(TRY_CAST(i->>'$.totalBytes' AS DOUBLE), 0) AS bytes FROM i WHERE resource <> ''")
def n_resources(spark, sf_dir):
    return performance.resources(performance.diagnostics(performance.lab(_LAB(spark)))).drop("strategy")


# Structured data

_EXPECTED = [("Product", ["name", "image", "offers"]), ("Offer", ["price", "priceCurrency", "availability"]), ("Article", ["headline", "author", "datePublished", "image"]), ("BlogPosting", ["headline", "author", "datePublished"]), ("Person", ["name"]), ("WebSite", ["name", "url"])]
_OBJECTS = Rows("objects", "page_url string, type string, body string", [("p1", "Product", '{"name":"x","offers":{"price":1}}'), ("p2", "WebSite", '{"name":"n","url":""}'), ("p3", "Odd", "{}"), ("p4", "Person", '{"name":null}'), ("p5", "Article", '{"headline":"h","author":["a"],"datePublished":"2024","image":"i"}')])
_GAPS = f"k(type, fields) AS (VALUES {', '.join(f'({t!r}, {f!r})' for t, f in _EXPECTED)}), g AS (SELECT page_url, type, list_filter(coalesce(fields, []), lambda f: coalesce(json_extract_string(body, '$.' || f), '') = '') AS missing FROM objects LEFT JOIN k USING (type))"


@query(f"WITH {_OBJECTS.sql}, {_GAPS} SELECT page_url, type, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) > 0 THEN 'warn' ELSE 'pass' END AS status FROM g")
def n_field_gaps(spark, sf_dir):
    rows = structured.field_gaps(_OBJECTS(spark))
    return rows.select("page_url", "type", F.array_join("missing", ",").alias("missing"), structured.finding_status(F.lit(True), F.col("missing")).alias("status"))


_CHECKED = Rows("checked", "url string, valid_blocks int, invalid_blocks int, one string, two string", [("u1", 2, 0, "Product", "Offer"), ("u2", 0, 1, None, None), ("u3", 1, 1, "Offer", None), ("u4", 0, 0, None, None)])


def _checked(spark) -> DataFrame:
    return _CHECKED(spark).withColumn("types", F.array_compact(F.array("one", "two"))).drop("one", "two")


@query(f"WITH {_CHECKED.sql} SELECT count(*)::BIGINT AS pages, count(one)::BIGINT AS with_types, (count(*) - count(one))::BIGINT AS without_types, sum(valid_blocks)::BIGINT AS valid_blocks, sum(invalid_blocks)::BIGINT AS invalid_blocks, (SELECT list_sort(list_distinct(list_filter(list(one) || list(two), lambda x: x IS NOT NULL))) FROM checked) AS types FROM checked")
def a_schema_summary(spark, sf_dir):
    return structured.summary(_checked(spark))


@query(f"WITH {_CHECKED.sql} SELECT url, CASE WHEN invalid_blocks > 0 THEN 'invalid' WHEN one IS NOT NULL THEN 'found' ELSE 'missing' END AS status, CASE url WHEN 'u2' THEN 'Store' ELSE 'Hotel' END AS recommended FROM checked")
def j_recommendations(spark, sf_dir):
    recs = spark.createDataFrame([("u2", "Event", 1), ("u9", "Hotel", 0), ("u2", "Store", 2)], "url string, type string, ord int")
    rows = structured.recommendations(_checked(spark), recs)
    return rows.select("url", structured.page_status(F.col("invalid_blocks"), F.size("types")).alias("status"), "recommended")


_TEMPLATED = Rows("templated", "type string, fields string", [("WebPage", "{}"), ("Service", "{}"), ("Product", '{"brand":"B","price":"9"}'), ("Article", '{"authorName":"Jo","authorType":"Person"}'), ("Hotel", '{"telephone":"1"}'), ("BreadcrumbList", '{"name":"ignored"}'), ("WebSite", '{"searchTarget":"https://a.com/?q="}')])
_TEMPLATES = {
    "WebPage": {},
    "Service": {"serviceType": "Head", "areaServed": "", "provider": {"@type": "Organization", "name": "Site", "url": "https://a.com"}},
    "Product": {"image": "https://a.com/i.png", "sku": "", "brand": {"@type": "Brand", "name": "B"}, "offers": {"@type": "Offer", "priceCurrency": "", "price": "9", "availability": "https://schema.org/InStock", "url": "https://a.com/x"}},
    "Article": {"headline": "Head", "author": {"@type": "Person", "name": "Jo"}, "datePublished": "", "dateModified": "", "image": "https://a.com/i.png"},
    "Hotel": {"name": "Site", "logo": "https://a.com/i.png", "email": "", "telephone": "1", "address": {"@type": "PostalAddress", "streetAddress": "", "addressLocality": "", "addressRegion": "", "postalCode": "", "addressCountry": ""}},
    "WebSite": {"potentialAction": {"@type": "SearchAction", "target": "https://a.com/?q={search_term_string}", "query-input": "required name=search_term_string"}},
}


def _template(kind: str) -> str:
    if kind == "BreadcrumbList":
        items = [{"@type": "ListItem", "position": 1, "name": "Home", "item": "https://a.com"}, {"@type": "ListItem", "position": 2, "name": "Head", "item": "https://a.com/x"}]
        return json.dumps({"@context": "https://schema.org", "@type": kind, "itemListElement": items}, separators=(",", ":"))
    base = {"@context": "https://schema.org", "@type": kind, "name": "Head", "url": "https://a.com/x", "description": "D"}
    return json.dumps(base | _TEMPLATES[kind], separators=(",", ":"))


@query("SELECT type, said::JSON::VARCHAR AS template FROM (VALUES " + ", ".join(f"('{t}', '{_template(t)}')" for t, _ in _TEMPLATED.rows) + ") t(type, said)")
def n_template(spark, sf_dir):
    lit = F.lit
    made = structured.template(F.col("type"), lit("Head"), lit("https://a.com/x"), lit("D"), lit("Site"), lit("https://a.com/i.png"), fields=F.from_json("fields", "map<string,string>"), pretty=False)
    return _TEMPLATED(spark).select("type", made.alias("template"))


@query(f"WITH {_JSON.sql}, {_TYPED} SELECT page_url, count(*)::BIGINT AS objects FROM kinds WHERE said IS NOT NULL AND said <> '\"\"' GROUP BY page_url")
def n_typed_objects(spark, sf_dir):
    from tidemark.operators import blocks

    return blocks.walk_types(_JSON(spark)).select("page_url", "block", "path").distinct().groupBy("page_url").agg(F.count("*").alias("objects"))


# Model answers

_ANSWERS = Rows(
    "answers",
    "id int, text string",
    [
        (0, 'Here: {"searchReadinessScore": 81.5, "visibilityLevel": " Strong ", "confidence": "MEDIUM", "authoritySignal": "", "signalScores": {"indexability": "120", "authority": "x"}, "strengths": [{"status": "pass", "title": " t "}, {"status": "odd", "detail": "d"}, {"status": "warn"}]} bye'),
        (1, '{"monthlyRange": "1K–5K", "trafficMaturity": "Growing", "channelMix": [{"channel": "Search", "range": "60%"}, {"range": "1%"}], "visibilityProfile": {"contentReach": -4, "searchPresence": 70}, "aiVisibility": {"level": "Some"}, "signals": [{"title": "s", "status": "info"}]}'),
        (2, "no answer"),
        (3, '{"critical": [{"status": "fail", "title": "c"}, {"status": "fail", "title": "c2"}], "quickWins": [{"title": "q", "status": "pass"}], "plan": [{"phase": "1", "tasks": ["a", " ", "b"]}, {"outcome": "only"}]}'),
        (4, '{"businessSummary": "B", "contentPriorities": [{"title": "C1", "priority": "High"}, {"title": "C2", "action": "do it"}], "conversionPriorities": [{"title": "V", "priority": "Low"}], "roadmap": [{"period": "p1", "objective": "", "tasks": []}, {"period": "p2", "objective": "own", "tasks": ["t"]}]}'),
        (5, '{"priorityRecommendations": [{"type": "Product", "reason": "sells"}, {"type": "X"}], "preferredType": "Event"}'),
    ],
)


def _answers(spark, report: str, *ids: int) -> DataFrame:
    return normalise.parse(_ANSWERS(spark).where(F.col("id").isin(*ids)), report)


_SAID = "j AS (SELECT id, CASE WHEN json_valid(regexp_extract(text, '(\\{.*\\})', 1, 's')) THEN regexp_extract(text, '(\\{.*\\})', 1, 's')::JSON ELSE '{}'::JSON END AS a FROM answers)"


def _int(path: str, fallback: int) -> str:
    n = f"TRY_CAST(a->>'{path}' AS DOUBLE)"  # least() and greatest() leave out nulls
    return f"CASE WHEN {n} IS NULL THEN {fallback} ELSE greatest(0, least(100, floor({n} + 0.5))) END::INTEGER"


def _said(path: str, fallback: str = "") -> str:
    return f"coalesce(trim(a->>'{path}'), '{fallback}')"


def _stated(path: str, states: str) -> str:
    made = f"list_transform(coalesce(json_extract(a, '{path}[*]'), []), lambda x: {{'status': CASE WHEN x->>'$.status' IN ({states}) THEN x->>'$.status' ELSE 'info' END, 'title': coalesce(trim(x->>'$.title'), ''), 'detail': coalesce(trim(x->>'$.detail'), '')}})"
    return f"array_to_string(list_transform(list_filter({made}, lambda x: x.title <> '' OR x.detail <> ''), lambda x: x.status || ':' || x.title || ':' || x.detail), ';')"


_THREE = "'pass', 'warn', 'info'"
_CONFIDENCE = "CASE WHEN lower(a->>'$.confidence') = 'medium' THEN 'Medium' ELSE 'Low' END"


def _shown(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["status"], x["title"], x["detail"])), ";")


@query(f"""WITH {_ANSWERS.sql}, {_SAID} SELECT id, {_int("$.searchReadinessScore", 50)} AS score, {_said("$.visibilityLevel", "Developing")} AS level, {_CONFIDENCE} AS confidence, {_said("$.indexabilitySignal", "Not enough evidence")} AS indexability, {_said("$.authoritySignal", "Unverified")} AS authority,
{_stated("$.strengths", _THREE)} AS strengths, {_int("$.signalScores.indexability", 50)} AS s_indexability, {_int("$.signalScores.authority", 64)} AS s_authority, {_int("$.signalScores.aiAnswerReadiness", 35)} AS s_ai FROM j WHERE id IN (0, 2)""")
def g_visibility(spark, sf_dir):
    rows = normalise.visibility(_answers(spark, "visibility", 0, 2), F.lit(3.2))
    s = F.col("signal_scores")
    return rows.select("id", F.col("search_readiness_score").alias("score"), F.col("visibility_level").alias("level"), "confidence", F.col("indexability_signal").alias("indexability"), F.col("authority_signal").alias("authority"), _shown("strengths").alias("strengths"), s["indexability"].alias("s_indexability"), s["authority"].alias("s_authority"), s["aiAnswerReadiness"].alias("s_ai"))


@query(f"""WITH {_ANSWERS.sql}, {_SAID} SELECT id, CASE WHEN {_said("$.monthlyRange")} IN ('Unknown', '0–100', '100–500', '500–1K', '1K–5K', '5K+') THEN {_said("$.monthlyRange")} ELSE 'Unknown' END AS monthly_range, {_said("$.trafficMaturity", "Not enough evidence")} AS traffic_maturity,
len(list_filter(coalesce(json_extract(a, '$.channelMix[*]'), []), lambda x: coalesce(x->>'$.channel', '') <> ''))::INTEGER AS channels, {_int("$.visibilityProfile.contentReach", 35)} AS reach, {_int("$.visibilityProfile.searchPresence", 35)} AS presence, {_int("$.visibilityProfile.aiAnswerReadiness", 25)} AS ai, {_said("$.aiVisibility.level", "Limited")} AS ai_level, {_stated("$.signals", _THREE)} AS signals FROM j WHERE id IN (1, 2)""")
def g_traffic(spark, sf_dir):
    rows, p = normalise.traffic(_answers(spark, "traffic", 1, 2)), F.col("visibility_profile")
    return rows.select("id", "monthly_range", "traffic_maturity", F.size("channel_mix").alias("channels"), p["contentReach"].alias("reach"), p["searchPresence"].alias("presence"), p["aiAnswerReadiness"].alias("ai"), F.col("ai_visibility.level").alias("ai_level"), _shown("signals").alias("signals"))


@query(f"""WITH {_ANSWERS.sql}, {_SAID} SELECT id, {_stated("$.critical", "'fail', 'warn', 'pass', 'info'")} AS critical, {_stated("$.quickWins", "'fail', 'warn', 'pass', 'info'")} AS quick_wins, len(list_filter(coalesce(json_extract(a, '$.plan[*]'), []), lambda p: coalesce(p->>'$.phase', '') <> '' OR coalesce(p->>'$.focus', '') <> '' OR len(coalesce(json_extract(p, '$.tasks[*]'), [])) > 0))::INTEGER AS phases FROM j WHERE id IN (2, 3)""")
def g_summary(spark, sf_dir):
    return normalise.summary(_answers(spark, "summary", 2, 3)).select("id", _shown("critical").alias("critical"), _shown("quick_wins").alias("quick_wins"), F.size("plan").alias("phases"))


@query("SELECT 2::BIGINT AS fail, 0::BIGINT AS warn, 1::BIGINT AS pass, 0::BIGINT AS info")
def a_status_histogram(spark, sf_dir):
    rows = normalise.summary(_answers(spark, "summary", 3))
    return normalise.status_histogram(rows.select(F.explode(F.concat("critical", "quick_wins")).alias("x")).select("x.status"))


_PHASE_ROWS = [
    (4, 1, "First 30 days", "Fix the highest-risk foundations", "V"), (4, 2, "p2", "own", "t"), (4, 3, "Days 61–90", "Build authority, conversion and repeatable measurement", "C1,do it"),
    (2, 1, "First 30 days", "Fix the highest-risk foundations", ""), (2, 2, "Days 31–60", "Expand qualified visibility and content coverage", ""), (2, 3, "Days 61–90", "Build authority, conversion and repeatable measurement", ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(map(repr, _PHASE_ROWS)) + ") t(id, phase, period, objective, tasks)")
def k_three_phases(spark, sf_dir):
    rows = normalise.three_phases(normalise.roadmap(_answers(spark, "roadmap", 2, 4)))
    return rows.select("id", F.posexplode("phases").alias("phase", "p")).select("id", (F.col("phase") + 1).alias("phase"), "p.period", "p.objective", F.array_join("p.tasks", ",").alias("tasks"))


@query(f"""WITH {_ANSWERS.sql}, {_SAID}, i AS (SELECT id, {_said("$.businessSummary")} AS business, unnest(json_extract(a, '$.contentPriorities[*]')) AS x FROM j WHERE id = 4) SELECT id, business, x->>'$.title' AS title, coalesce(x->>'$.priority', 'Medium') AS priority, coalesce(x->>'$.action', '') AS action FROM i""")
def g_roadmap(spark, sf_dir):
    rows = normalise.roadmap(_answers(spark, "roadmap", 4))
    return rows.select("id", F.col("businessSummary").alias("business"), F.explode("contentPriorities").alias("x")).select("id", "business", "x.title", "x.priority", "x.action")


@query("SELECT * FROM (VALUES (2, 'WebPage', 'WebPage is a safe general type for a standard page.'), (5, 'Product', 'sells')) t(id, type, reason)")
def g_schema(spark, sf_dir):
    return normalise.schema_recommendations(_answers(spark, "schema", 2, 5)).select("id", "type", "reason")


@query("SELECT o_orderstatus AS workstream, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END)::BIGINT AS load, count(*)::BIGINT AS items FROM orders GROUP BY 1")
def a_workload(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "High").when(F.col("o_orderpriority") == "2-HIGH", "Medium").otherwise("Low")
    return normalise.workload(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("workstream"), kind.alias("priority")))


@query(f"""WITH k(id, text) AS (VALUES (0, '{{"primaryIntent":" Local ","opportunityScore":"101","demandSignal":"high","confidence":"x","entities":["a"," ",null,"b"],"contentOutline":[]}}'), (1, 'none')), {_SAID.replace("FROM answers", "FROM k")}
SELECT id, {_said("$.primaryIntent", "Mixed")} AS primary_intent, {_int("$.opportunityScore", 50)} AS opportunity_score, CASE lower(a->>'$.demandSignal') WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS demand_signal, 'Low' AS confidence, CASE id WHEN 0 THEN 'a,b' ELSE '' END AS entities FROM j""")
def g_keyword_report(spark, sf_dir):
    said = [(0, '{"primaryIntent":" Local ","opportunityScore":"101","demandSignal":"high","confidence":"x","entities":["a"," ",null,"b"],"contentOutline":[]}'), (1, "none")]
    rows = normalise.keyword_report(normalise.parse(spark.createDataFrame(said, "id int, text string"), "keywords"))
    return rows.select("id", "primary_intent", "opportunity_score", "demand_signal", "confidence", F.array_join("entities", ",").alias("entities"))
