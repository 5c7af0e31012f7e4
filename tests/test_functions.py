from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as T
from tidemark.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strip_decodes_amp_before_lt(spark):
    assert value(spark, T.strip(F.lit("<p>a&amp;lt;b</p><script>x</script> c  d"))) == "a<b c d"


def test_attr_quirks(spark):
    assert value(spark, T.attr(F.lit('<img data-src="x" src="y">'), "src")) == "x"
    assert value(spark, T.attr(F.lit('<meta content="it\'s ok">'), "content")) == "it"
    assert value(spark, T.attr(F.lit("<a href=/p>"), "href")) == "/p"


def test_decimal_entities(spark):
    assert value(spark, T.decode_more(F.lit("a&#233;&#8364;&#128512;b&apos;"))) == "aé€😀b'"


def test_headings_need_their_own_close(spark):
    got = value(spark, T.headings(F.lit("<h1>A</h1><h2>B</h3></h2><h2></h2>")))
    assert [(h["level"], h["text"]) for h in got] == [(1, "A"), (2, "B"), (2, "")]


def test_root_domain(spark):
    for name, root in (("www.shop.example.co.uk", "example.co.uk"), ("blog.x.example.net", "example.net"), ("example.net", "example.net"), ("", "")):
        assert value(spark, U.root_domain(F.lit(name))) == root


def test_absolute(spark):
    base = "https://A.com/x/y?q=1#f"
    cases = {"/p": "https://a.com/p", "z": "https://a.com/x/z", "../z": "https://a.com/z", "//b.com/q": "https://b.com/q", "?r": "https://a.com/x/y?r", "#g": "https://a.com/x/y?q=1#g", "http://c.com": "http://c.com/", "mailto:x@y": "mailto:x@y", "./a/./b/../c": "https://a.com/x/a/c"}
    for href, want in cases.items():
        assert value(spark, U.absolute(F.lit(href), F.lit(base))) == want, href


def test_private_addresses(spark):
    for name, private in (("10.0.0.1", True), ("8.8.8.8", False), ("172.20.1.1", True), ("100.64.0.1", True), ("::1", True), ("2001:4860::8888", False), ("not an address", True)):
        assert value(spark, U.private_address(F.lit(name))) is private, name


def test_public_url(spark):
    assert value(spark, U.public_url(F.lit("Example.com"))) == "https://example.com/"
    for bad in ("ftp://a.com", "https://u:p@a.com", "http://localhost", "http://127.0.0.1/"):
        assert value(spark, U.public_url(F.lit(bad))) is None


def test_unwrap(spark):
    assert value(spark, U.unwrap(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.com%2Fa&rut=1"))) == "https://x.com/a"


def test_change_and_rounding(spark):
    for (a, b), want in {(5, 0): 100, (0, 0): 0, (3, 4): -25}.items():
        assert value(spark, N.change(F.lit(float(a)), F.lit(float(b)))) == want
    assert value(spark, N.round_half_up(F.lit(-0.5))) == 0
    assert value(spark, N.number(F.lit(""))) == 0


def test_bands_and_buckets(spark):
    assert value(spark, N.band_midpoint(F.lit("20–40%"))) == 30
    assert value(spark, N.band_midpoint(F.lit("5K+"))) == 0
    for v, want in ((2500.0, "good"), (2501.0, "needs-improvement"), (4000.0, "needs-improvement"), (4001.0, "poor"), (None, "unknown")):
        assert value(spark, N.metric_bucket(F.lit("LCP"), F.lit(v).cast("double"))) == want


def test_import_cells(spark):
    for cell, url in ((" \u200b\"shop.com/a b#f\" ", "https://shop.com/a%20b"), ("N/A", ""), ("—", ""), ("//x.org", "https://x.org/"), ("ftp://x.org", ""), ("12", ""), ("word", ""), ("HTTP://A.com", "http://a.com/")):
        assert value(spark, U.import_url(F.lit(cell))) == url, cell
    for cell, root in (("blog.five.co.uk", "five.co.uk"), ("https://A.b.gov.uk/x", "gov.uk"), ("a@b.com", ""), ("null", ""), ("3.5", "")):
        assert value(spark, U.import_domain(F.lit(cell))) == root, cell


def test_fixed_values(spark):
    for name, root in (("a.b.com.pk", "b.com.pk"), ("a.b.gov.uk", "gov.uk"), ("a.b.com.br", "b.com.br")):
        assert value(spark, U.root_domain(F.lit(name))) == root
    for name, private in (("192.0.0.8", True), ("192.0.2.1", False), ("fe80::1", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False)):
        assert value(spark, U.private_address(F.lit(name))) is private, name


def test_trim_takes_blanks_of_both_ends_without_a_pattern(spark):
    ends = " \t\n\x0b\f\r\xa0﻿       　"
    rows = [(ends + "a" + ends + "b" + ends,), (ends,), ("",), (None,), ("​a\x00",)]
    got = spark.createDataFrame(rows, "s string").select(T.trim(F.col("s")).alias("s"))
    assert [r["s"] for r in got.collect()] == ["a" + ends + "b", "", "", None, "​a\x00"]
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
