"""Page fetch against a local server, the walk of JSON-LD, the limiter as a stream, kept tables."""

import json
import threading
import time
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, pages
from tidemark.sources import fetch
from tidemark.streaming import limiter


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("location", "/page")
            self.end_headers()
            return
        if self.path == "/loop":
            self.send_response(302)
            self.send_header("location", "/loop")
            self.end_headers()
            return
        found = self.path == "/page"
        self.send_response(200 if found else 404)
        self.send_header("content-type", "text/html")
        self.send_header("x-robots-tag", "noindex")
        self.end_headers()
        self.wfile.write(b"<title>Found</title>" + b"x" * 1000 if found else b"gone")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    urls = spark.createDataFrame([(f"{site}/{p}",) for p in ("page", "moved", "none", "loop", "page")] + [("http://127.0.0.1:9/",), (None,)], "url string")
    got = {r["requested_url"].removeprefix(site): r for r in fetch.fetched(urls, allowed=lambda _: True, most=500, timeout=5).collect()}
    assert len(got) == 5
    assert (got["/moved"]["final_url"], got["/moved"]["status"], len(got["/page"]["html"])) == (f"{site}/page", 200, 500)
    assert (got["/none"]["status"], got["/none"]["x_robots_tag"], got["/loop"]["error"]) == (404, "noindex", "Too many redirects.")
    assert got["http://127.0.0.1:9/"]["error"] and got["http://127.0.0.1:9/"]["status"] is None
    refused = fetch.fetched(urls.where(F.col("url").endswith("/page"))).first()
    assert refused["error"] == "Private or local network URLs are not allowed."


def test_page_source(spark, site):
    spark.dataSource.register(fetch.Pages)
    rows = spark.read.format("pages").option("urls", json.dumps([f"{site}/page", f"{site}/moved", f"{site}/none"])).option("urlsPerPartition", "2").option("allowPrivate", "true").load()
    assert rows.rdd.getNumPartitions() == 2
    facts = pages.page_facts(rows, url="final_url").select("title", "status", "ok", "x_robots_tag").collect()
    assert sorted((r["title"], r["status"], r["ok"]) for r in facts) == [("", 404, False), ("Found", 200, True), ("Found", 200, True)]


def test_five_requests_at_once_in_the_order_of_the_urls(monkeypatch):
    lock, now, most = threading.Lock(), [0], [0]

    def slow(url, *_):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (3 - int(url) % 3))
        with lock:
            now[0] -= 1
        return url, url, 200, "", "", "", 1, None

    monkeypatch.setattr(fetch, "get", slow)
    got = [b.column(0)[0].as_py() for b in fetch._rows(iter(map(str, range(23))), lambda _: True, 1, 1)]
    assert got == [str(k) for k in range(23)] and most[0] == fetch.AT_ONCE
    assert list(fetch._rows(iter([]), lambda _: True, 1, 1)) == []


def objects(value, at=()):
    """Typed objects by plain recursion, whole-number keys first."""
    if isinstance(value, dict) and "@type" in value and (value["@type"] or value["@type"] == []):
        kind = value["@type"]
        for t in kind if isinstance(kind, list) else [kind]:
            yield list(at), t if isinstance(t, str) else "[object Object]" if isinstance(t, dict) else json.dumps(int(t) if isinstance(t, float) else t)
    within = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    within.sort(key=lambda x: (0, int(x[0])) if str(x[0]).isdecimal() else (1, 0))
    for k, (_, x) in enumerate(within):
        yield from objects(x, (*at, k))


BLOCKS = [
    '{"b":{"@type":"B"},"@type":["A",1.0,true,null,{"x":1}],"2":{"@type":"Two"},"a":[{"@type":""},{"@type":"C"}]}',
    '[{"@type":"X","t":"{\\"@type\\":\\"text\\"}","u":"[]"},[[{"10":{"@type":"Ten"},"9":{"@type":"Nine"}}]]]',
    ' {"@type" : 5, "x" : {"@type":0}, "y":{"@type":false}, "z":{"@type":[]}, "ä":{"@type":"Ü\\u00e9"}} ',
    '{"a":{"@type":"first"},"b":{"@type":"B"},"a":{"@type":"last"}}',
    '"{\\"@type\\":\\"text\\"}"', "5", "null", "[]", "{}", "[" * 400 + '{"@type":"Deep"}' + "]" * 400,
    json.dumps([{"@type": f"T{k}", "in": {"@type": ["U", f"V{k}"]}} for k in range(300)]),
]
BROKEN = ['{"@type":"A"} junk', '{"@type":"A"},{"@type":"B"}', "{'@type':'A'}", '{"@type":NaN}', '{"@type":"A"', "", "[" * 100_000, '1,"b":2', '{"@type":"A",}', None]


def test_types_in_order_of_the_text(spark):
    rows = spark.createDataFrame([("p", k, raw) for k, raw in enumerate(BLOCKS + BROKEN)], "page_url string, block int, raw string")
    got = {}
    for r in blocks.walk_types(rows).orderBy("block", "path").collect():
        got.setdefault(r["block"], []).append((r["path"], r["type"]))
    assert got == {k: want for k, raw in enumerate(BLOCKS) if (want := list(objects(json.loads(raw))))}
    one = spark.createDataFrame([(BLOCKS + BROKEN,), ([],), (None,)], "raws array<string>").select(blocks.read("raws").alias("x")).select("x.*").collect()
    assert one[0]["valid"] == [True] * len(BLOCKS) + [False] * len(BROKEN)
    assert one[0]["types"] == list(dict.fromkeys(t for raw in BLOCKS for _, t in objects(json.loads(raw))))
    assert [tuple(x) for x in one[1:]] == [([], [], "")] * 2


def test_name_of_the_site_and_no_python(spark):
    raws = ['{"@type":"Person","name":"P"}', '{"@graph":[{"@type":["LocalBusiness","X"],"name":"L"},{"@type":"WebSite","name":"W"}]}']
    html = "".join(f'<script type="application/ld+json">{raw}</script>' for raw in raws)
    facts = pages.page_facts(spark.createDataFrame([("http://a.com/", html)], "url string, html string"))
    assert facts.first()["site_name"] == "L"
    assert "Python" not in facts._jdf.queryExecution().toString() and "ArrowEval" not in facts._jdf.queryExecution().toString()


def test_page_without_html_has_no_types(spark):
    row = pages.page_facts(spark.createDataFrame([("http://a.com/", None)], "url string, html string")).first()
    assert (row["schema_types"], row["blocks"], row["site_name"], row["canonical"], row["error"]) == ([], [], "Website", "http://a.com/", None)


def test_limiter_over_batches_is_the_same_as_at_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"c{k % 3}", "contact", start + timedelta(seconds=40 * k)) for k in range(90)] + [("c0", "health", start)]
    events = spark.createDataFrame(rows, "client string, action string, ts timestamp")
    want = sorted(map(tuple, limiter.limit(events).where("action <> 'health'").collect()))
    assert limiter.limit(events).where("action = 'health'").first()["allowed"] is True
    counts = {}
    for client, _, ts, allowed, remaining in want:
        began, n = counts.get(client, (None, 0))
        began, n = (ts, 1) if began is None or ts >= began + timedelta(seconds=600) else (began, n + 1)
        counts[client] = began, n
        assert (allowed, remaining) == (n <= 5, max(0, 5 - n))
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(stream).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("judged").collect())) == want


def test_walk_reads_each_block_once(spark):
    rows = spark.createDataFrame([("p", raw) for raw in BLOCKS], "page_url string, raw string")
    plan = blocks.walk_types(rows, body=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "aggregate(" not in plan


def test_values_of_a_repeated_key_and_texts_of_objects(spark):
    raws = [
        '{"a":1,"a":"{\\"@type\\":\\"text\\"}","@type":false,"b":{"@type":5.0,"b":1,"b":2}}',
        ' { "@type" : "\\ud800A" , "x":[{"@type":"é\U0001f600","n":1.50e1}], "x":{"s":"\\/}","@type":["B",[null,"c",[1e25]]]} }',
    ]
    rows = spark.createDataFrame([("p", k, raw) for k, raw in enumerate(raws)], "page_url string, block int, raw string")
    got = sorted(tuple(r)[1:] for r in blocks.walk_types(rows).collect())
    inner = '{"s":"/}","@type":["B",[null,"c",[1.0E25]]]}'
    whole = got[1][-1]
    assert got == [(0, [2], "5", '{"@type":5.0,"b":1,"b":2}'), (1, [], "?A", whole), (1, [1], ",c,[1.0E25]", inner), (1, [1], "B", inner)]
    assert whole.startswith('{"@type":') and whole.endswith(inner + "}") and '"n":15.0' in whole
    assert sorted(tuple(r)[1:] for r in blocks.walk_types(rows, body=False).collect()) == sorted(r[:-1] for r in got)
