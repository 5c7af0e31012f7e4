"""The paged report source against a local service over the events of the test tables."""

import json
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import periods
from tidemark.sources import report

EVENTS = Path("/root/testdata/sf0.001/events.parquet")
pytestmark = pytest.mark.skipif(not EVENTS.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def service(spark):
    """Rows for each user or kind of event of a day, in pages; every third distinct request first finds the service busy."""
    rows = spark.read.parquet(str(EVENTS)).selectExpr("cast(ts AS date) AS day", "user_id", "event_type", "value").collect()
    asked, lock = [], threading.Lock()

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            search = "startDate" in body
            day = body["startDate"] if search else body["dateRanges"][0]["startDate"]
            dimension = body["dimensions"][0] if search else body["dimensions"][0]["name"]
            start, size = (body["startRow"], body["rowLimit"]) if search else (int(body["offset"]), int(body["limit"]))
            with lock:
                again = (day, dimension, start) in asked
                asked.append((day, dimension, start))
            if dimension == "refused":
                return self.answer(403, {"error": {"message": "No permission."}})
            if not again and start == size:
                return self.answer(503, {})
            of_day = Counter(str(r["user_id"]) if dimension == "page" else r["event_type"] for r in rows if str(r["day"]) == day)
            found = sorted(of_day.items(), key=lambda x: (-x[1], x[0]))[start : start + size]
            if search:
                return self.answer(200, {"rows": [{"keys": [k], "clicks": n, "impressions": 2 * n, "ctr": 0.5, "position": 1} for k, n in found]} if found else {})
            self.answer(200, {"rows": [{"dimensionValues": [{"value": k}], "metricValues": [{"value": str(n + m)} for m in range(8)]} for k, n in found], "rowCount": len(of_day)})

        def answer(self, status, said):
            data = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(report.Reports)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    days = sorted({r["day"] for r in rows})
    yield f"http://127.0.0.1:{server.server_port}/", asked, days
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


def source(spark, service, **options):
    made = {"url": service[0], "wait": 0.01, "rowsPerPage": 7, "dimensions": "page,query", **options}
    reader = spark.read.format("report")
    for k, v in made.items():
        reader = reader.option(k, str(v))
    return reader.load()


def direct(spark, first, last, dimension):
    key = F.col("user_id").cast("string") if dimension == "page" else F.col("event_type")
    rows = spark.read.parquet(str(EVENTS)).where(F.col("ts").cast("date").between(first, last))
    return sorted(map(tuple, rows.groupBy(F.col("ts").cast("date").alias("day"), key.alias("key")).count().collect()))


@pytest.mark.parametrize("expected", [0, 20])
def test_filters_become_requests_and_pages_the_whole(spark, service, expected):
    _, asked, days = service
    asked.clear()
    first, last = days[2], days[4]
    answers = source(spark, service, expectedRows=expected).where(F.col("day").between(first, last) & (F.col("dimension") == "page"))
    got = periods.search_rows(answers)
    assert sorted((r["day"], r["key"], int(r["clicks"])) for r in got.collect()) == direct(spark, first, last, "page")
    assert {d for d, _, _ in asked} == {str(d) for d in days if first <= d <= last} and {x for _, x, _ in asked} == {"page"}
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan report" in plan and " Filter (" not in plan  # both filters are the source's
    assert answers.rdd.getNumPartitions() == sum(first <= d <= last for d in days) * (3 if expected else 1)


def test_analytics_and_days_by_option(spark, service):
    _, _, days = service
    answers = source(spark, service, kind="analytics", start=days[0], end=days[1], dimensions="query")
    got = sorted((r["day"], r["key"], int(r["activeUsers"]), int(r["engagementSeconds"])) for r in periods.analytics_rows(answers).collect())
    assert got == [(*x, x[-1] + 7) for x in direct(spark, days[0], days[1], "query")]
    few = answers.where((F.col("day") == F.lit(days[1])) & F.col("dimension").startswith("q") & (F.col("start_row") == 0))
    assert [r["day"] for r in few.collect()] == [days[1]]


def test_nothing_asked_and_errors(spark, service):
    _, asked, days = service
    asked.clear()
    none = source(spark, service).where((F.col("day") > F.lit(days[3])) & (F.col("day") < F.lit(days[3])))
    assert none.count() == 0 and asked == []
    assert source(spark, service, start="1999-01-01", end="1999-01-02").count() == 0
    with pytest.raises(Exception, match="No permission"):
        source(spark, service, start=days[0], end=days[0], dimensions="refused").count()
    with pytest.raises(Exception, match="start and end"):
        source(spark, service).count()
    with pytest.raises(RuntimeError, match="Report request failed"):
        report.ask("http://127.0.0.1:9/", report.request_body("search", date(2024, 1, 1), "query", 0, 5), {}, 1, 0.01, 1)
