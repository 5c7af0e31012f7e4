import json
from datetime import date, datetime

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import audit, links, normalise, pages, performance, periods, structured
from tidemark.plans.catalogue import QUERIES, SQL
from tidemark.sources import delimited, sinks, web
from tidemark.streaming import limiter

HTML = """<html lang="en"><head><title>Short</title><meta name="description" content="d"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@type":"WebSite","name":"N"}</script><script type="application/ld+json">{bad</script></head>
<body><h1>One</h1><h2>Two</h2><h4>Four</h4><img src="/i.png"><img src="/j.png" alt="" width="5" height="6"><a href="/in">in</a><a rel="nofollow" href="https://o.org/">out</a></body></html>"""


def page(spark):
    return pages.page_facts(spark.createDataFrame([("https://a.com/p", HTML)], "url string, html string"))


def test_page_facts(spark):
    p = page(spark).first()
    assert (p["title"], p["lang"], p["canonical"], p["site_name"]) == ("Short", "en", "https://a.com/c", "N")
    assert [x["url"] for x in p["links"]] == ["https://a.com/in", "https://o.org/"]
    assert [(i["has_alt"], i["width"]) for i in p["images"]] == [(False, None), (True, 5.0)]
    assert p["schema_types"] == ["WebSite"] and [b["valid"] for b in p["blocks"]] == [True, False]


def test_findings(spark):
    got = {r["code"] for r in audit.findings(page(spark)).collect()}
    assert got == {"viewport", "canonical-other", "schema-invalid", "title-length", "description-length", "heading-skip", "thin-content", "og-incomplete", "alt-missing", "image-dimensions"}
    failed = page(spark).withColumn("error", F.lit("timeout"))
    assert [r["code"] for r in audit.findings(failed).collect()] == ["crawl-error"]


def test_null_html_is_empty(spark):
    p = pages.page_facts(spark.createDataFrame([("https://a.com/", None)], "url string, html string")).first()
    assert p["word_count"] == 0 and p["links"] == []


def test_scores(spark):
    rows = spark.createDataFrame([("A", "critical")] * 2 + [("A", "warning")] * 5, "category string, severity string")
    assert audit.site_health(rows, spark.createDataFrame([(4,)], "pages long")).first()["health"] == 33
    one = spark.range(1).select(audit.growth_audit_score(F.lit(2), F.lit(5), F.lit(0)).alias("a"), audit.growth_overall(F.lit(80), F.lit(73), F.lit(60), F.lit(55)).alias("o")).first()
    assert (one["a"], one["o"]) == (73, 69)


def test_ranges():
    r = periods.Range(date(2024, 1, 16), date(2024, 1, 30))
    assert r.previous() == periods.Range(date(2024, 1, 1), date(2024, 1, 15)) and r.days == r.previous().days
    assert periods.preset("previous-month", date(2024, 3, 5)) == periods.Range(date(2024, 2, 1), date(2024, 2, 29))


def test_authority(spark):
    schema = "source_domain string, live boolean, follow boolean, no_link_found boolean"
    three = spark.createDataFrame([("a", True, True, False), ("a", True, True, None), ("b", True, False, False)], schema)
    assert links.authority(links.summary(three)).first()["authority"] == 27
    assert links.authority(links.summary(three.limit(0))).first()["authority"] == 0


def test_verify_takes_the_first_link(spark):
    rows = links.verify(page(spark), "o.org").collect()
    assert [(r["target_url"], r["follow"], r["live"]) for r in rows] == [("https://o.org/", False, True)]


def test_last_wins_first_position(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], "k string, v int, ord int")
    got = links.last_of_each(rows, "k", "ord").orderBy("first_at").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", 3), ("b", 2)]


def test_diagnostics(spark):
    body = '{"lighthouseResult":{"categories":{"performance":{"score":0.905}},"audits":{"layout-shifts":{"score":1},"long-tasks":{"score":0.2,"details":{"overallSavingsMs":50}},"bootup-time":{"score":null,"details":{"overallSavingsBytes":90000}}}}}'
    parsed = performance.lab(spark.createDataFrame([("u", "m", body), ("v", "m", "oops")], "url string, strategy string, body string"))
    assert [(r["id"], r["status"], r["rank"]) for r in performance.diagnostics(parsed).orderBy("rank").collect()] == [("bootup-time", "needs-improvement", 1), ("long-tasks", "poor", 2)]
    assert performance.category_scores(parsed).first()["bucket"] == "good"


def test_delimited_quotes_and_line_ends(spark):
    rows = spark.createDataFrame([('a,"b ""c""\nd",e\r\n\r\n"x;y",2\n',)], "body string").select(delimited.records(F.col("body"), delimited.delimiter(F.col("body"))).alias("r")).first()["r"]
    assert rows == [["a", 'b "c"\nd', "e"], ["x;y", "2"]]


def test_csv_lines(spark):
    rows = spark.createDataFrame([("a\"b", [1, 2], None)], "x string, y array<int>, z string")
    assert sinks.csv_lines(rows).first()["line"] == '"a""b","[1,2]",""'


def test_robots(spark):
    rows = spark.createDataFrame([("o", "User-agent: *\nSitemap: https://a/1.xml\nsitemap:https://a/2.xml\n")], "origin string, body string")
    assert [r["url"] for r in web.robots_sitemaps(rows).orderBy("ord").collect()] == ["https://a/2.xml", "https://a/1.xml"]


def test_limiter_window_starts_with_the_first_event(spark):
    times = [datetime(2024, 1, 1, 0, 0, s) for s in range(7)] + [datetime(2024, 1, 1, 0, 10, 0)]
    rows = spark.createDataFrame([("c", "contact", t) for t in times], "client string, action string, ts timestamp")
    assert [r["allowed"] for r in limiter.limit(rows).orderBy("ts").collect()] == [True] * 5 + [False] * 2 + [True]


def test_limiter_stream_agrees(spark, tmp_path):
    times = [datetime(2024, 1, 1, 0, 0, s) for s in range(7)]
    rows = spark.createDataFrame([("c", "contact", t) for t in times], "client string, action string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["ts"], r["allowed"]) for r in spark.table("limited").collect()) == sorted((r["ts"], r["allowed"]) for r in limiter.limit(rows).collect())


def test_answers(spark):
    said = lambda report, text: normalise.parse(spark.createDataFrame([("s", text), ("t", None)], "seed string, text string"), report)
    v = {r["seed"]: r for r in normalise.visibility(said("visibility", '{"searchReadinessScore":200,"confidence":"MEDIUM","gaps":[{"status":"Warn","title":"x"},{"status":"pass"}],"signalScores":{"authority":7.5}}'), F.lit(3.2)).collect()}
    assert (v["s"]["search_readiness_score"], v["s"]["confidence"], v["s"]["gaps"][0]["status"], len(v["s"]["gaps"]), v["s"]["signal_scores"]["authority"]) == (100, "Medium", "info", 1, 8)
    assert (v["t"]["search_readiness_score"], v["t"]["local_signal"], v["t"]["signal_scores"]["authority"]) == (50, "Not assessed", 64)
    t = normalise.traffic(said("traffic", '{"monthlyRange":" 1K–5K ","channelMix":[{"channel":"a","range":"1%"},{}]}')).orderBy("seed").first()
    assert (t["monthly_range"], len(t["channel_mix"]), t["ai_visibility"]["level"]) == ("1K–5K", 1, "Limited")
    r = normalise.three_phases(normalise.roadmap(said("roadmap", '{"technicalPriorities":[{"title":"T"}],"conversionPriorities":[{"title":"C","action":"A"}],"roadmap":[{"period":"p"},{"objective":"o"}]}'))).orderBy("seed").first()
    assert [p["period"] for p in r["phases"]] == ["First 30 days", "", "Days 61–90"] and r["phases"][0]["tasks"] == ["T", "A"]
    s = normalise.summary(said("summary", '{"plan":[{"phase":"1","tasks":["x",""]},{}],"critical":[{"status":"fail","detail":"d"}]}')).orderBy("seed").first()
    assert (len(s["plan"]), s["plan"][0]["tasks"], s["critical"][0]["status"]) == (1, ["x"], "fail")
    k = normalise.schema_recommendations(said("schema", '{"priorityRecommendations":[{"type":"Event","reason":"r"},{"type":"x"}]}')).orderBy("seed").collect()
    assert [x["type"] for x in k] == ["Event", "WebPage"]


def test_import_kinds(spark):
    got = delimited.kinds(delimited.classify(spark.createDataFrame([("a", "one.com\none.com\n???\n"), ("b", "Domain\nsub.two.org\n")], "filename string, body string"))).orderBy("filename").collect()
    assert [(r["file_kind"], r["source"], r["domain"], r["ignored"]) for r in got] == [("source-pages", 1, 0, 1), ("referring-domains", 0, 1, 0)]


def test_templates(spark):
    kinds = spark.createDataFrame([("Product",), ("Hotel",), ("Event",), ("BreadcrumbList",)], "kind string")
    got = {r["kind"]: json.loads(r["t"]) for r in kinds.select("kind", structured.template(F.col("kind"), F.lit("N"), F.lit("https://a.com/p"), F.lit(None).cast("string")).alias("t")).collect()}
    assert got["Product"]["offers"]["availability"].endswith("/InStock") and got["Hotel"]["name"] == "Organization"
    assert list(got["Event"]) == ["@context", "@type", "name", "url", "description"] and got["BreadcrumbList"]["itemListElement"][0]["item"] == "https://a.com"


def test_inventory_of_repeated_urls_agrees_with_sql(spark, tmp_path):
    titled = "<html lang='en'><title>A title that is long enough for any rule</title><h1>One</h1>"
    rows = [(1, "https://a.com/x", titled + "word " * 400), (2, "https://a.com/x", "<p>thin"), (3, "https://a.com/x", None), (4, "https://a.com/y", "<p>thin"), (5, None, "<p>thin"), (6, None, titled)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["k_page_inventory"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT page_id, url, coalesce(html, '') AS html FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = duck.execute(SQL["k_page_inventory"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
    assert len({r["issues"] for r in got.where("url like '%/x'").collect()}) == 1
    # pages without URL keep their own counts
    facts = pages.page_facts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    alone = [r["issues"] for r in audit.inventory(facts).where("url is null").collect()]
    assert len(set(alone)) == 2
