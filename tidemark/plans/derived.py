"""Queries over web data that Spark derives from the test tables: exports in files, measurement answers, requests of one client."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import addresses, blocks, ordinals, pages, performance
from tidemark.operators.link_state import LinkState
from tidemark.plans.catalogue import _HOST, _NORM, _ROOT, query, table, web_pages
from tidemark.sources import delimited, sinks
from tidemark.sources.kept import shared_folder
from tidemark.streaming import limiter

#: What scripts trim, as SQL has it.
_BLANK = r"[\s\x{0B}\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def exported(rows: DataFrame, header: str) -> str:
    """The folder of files that hold rows as quoted text: each task writes the lines of one, below a header."""
    path = f"{shared_folder(rows.sparkSession)}/export-{uuid.uuid4().hex}"
    lines = sinks.csv_lines(rows)
    heads = lines.select(F.spark_partition_id().alias("part")).distinct()
    lines = lines.select(F.spark_partition_id().alias("part"), F.lit(1).alias("n"), "line").union(heads.select("part", F.lit(0), F.lit(header)))
    files = lines.repartition("part").sortWithinPartitions("part", "n")
    files.select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    return path


@query(rf"SELECT doc_id::VARCHAR AS doc_id, lang, length(t) AS n, sha256(t) AS text_sha256 FROM (SELECT doc_id, lang, regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM documents)")
def d_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many lines, written as quoted cells and read back by chunks of the files."""
    path = exported(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc,language,content")
    rows = delimited.read_rows(spark, path).where(F.col("row")[0] != "doc")
    return rows.select(F.col("row")[0].alias("doc_id"), F.col("row")[1].alias("lang"), F.length(F.col("row")[2]).alias("n"), F.sha2(F.col("row")[2].cast("binary"), 256).alias("text_sha256"))


@query("SELECT c_custkey::VARCHAR AS custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def d_split_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exported(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "key,name,segment")
    rows = delimited.read_rows(spark, path).where(F.col("row")[0] != "key")
    return rows.select(*[F.col("row")[k].alias(c) for k, c in enumerate(("custkey", "name", "segment"))])


@query(f"SELECT DISTINCT CASE WHEN {_ROOT} = 'example.com' THEN 'target' ELSE 'source' END AS kind, {_NORM} AS value FROM pages")
def d_split_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export of linking pages, classified; those of the own site are targets."""
    path = exported(table(spark, sf_dir, "pages").select("url", "page_id"), "Source URL,Last crawled")
    rows = delimited.read_rows(spark, path).withColumn("target_url", F.lit("https://www.example.com/"))
    return delimited.classify_rows(rows).select("kind", "value").distinct()


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS k, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT 'https://c' || o_custkey || '.com/' AS url, CASE k % 4 WHEN 0 THEN 'https://r.com/' || k WHEN 1 THEN 'https://s.com/' || k ELSE '<img id="' || k || '">' END AS resource, CASE WHEN k % 3 = 0 THEN 0 ELSE o_totalprice END AS bytes FROM i WHERE n <= 30 AND k % 4 <> 3""")
def n_resource_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that name a URL, a source, a node, or nothing, in answers made of each customer's orders."""
    k = F.col("o_orderkey")
    item = F.struct(
        "o_orderkey",
        F.struct(
            F.when(k % 4 == 0, F.concat(F.lit("https://r.com/"), k)).when(k % 4 == 1, "").alias("url"),
            F.when(k % 4 == 1, F.struct(F.concat(F.lit("https://s.com/"), k).alias("url"))).alias("source"),
            F.when(k % 4 == 2, F.struct(F.concat(F.lit('<img id="'), k, F.lit('">')).alias("snippet"))).alias("node"),
            F.when(k % 3 != 0, F.col("o_totalprice")).alias("totalBytes"),
            F.lit(1.5).alias("wastedBytes"),
        ).alias("item"),
    )
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item))["item"].alias("items"))
    audit = F.struct(F.lit(0.3).alias("score"), F.struct("items").alias("details"))
    body = F.to_json(F.struct(F.struct(F.create_map(F.lit("unused-javascript"), audit).alias("audits")).alias("lighthouseResult")))
    said = by_customer.select(F.concat(F.lit("https://c"), "o_custkey", F.lit(".com/")).alias("url"), F.lit("mobile").alias("strategy"), body.alias("body"))
    return performance.resources(performance.diagnostics(performance.lab(said))).select("url", "resource", "bytes")


_ACTIONS = "CASE event_type WHEN 'click' THEN 'contact' WHEN 'view' THEN 'site-audit' WHEN 'error' THEN 'pagespeed' WHEN 'purchase' THEN 'health' ELSE 'other' END"


@query(f"""WITH RECURSIVE a AS (SELECT {_ACTIONS} AS action, ts, event_id FROM events), e AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts, event_id) AS n, CASE action WHEN 'contact' THEN 600 ELSE 60 END AS s FROM a WHERE action <> 'health'),
w AS (SELECT action, ts, n, ts AS began, 1 AS count FROM e WHERE n = 1
  UNION ALL SELECT e.action, e.ts, e.n, CASE WHEN epoch_us(e.ts) >= epoch_us(w.began) + s * 1000000 THEN e.ts ELSE w.began END, CASE WHEN epoch_us(e.ts) >= epoch_us(w.began) + s * 1000000 THEN 1 ELSE w.count + 1 END FROM w JOIN e ON e.action = w.action AND e.n = w.n + 1),
l AS (SELECT *, CASE action WHEN 'contact' THEN 5 WHEN 'site-audit' THEN 40 WHEN 'pagespeed' THEN 20 ELSE 60 END AS most FROM w)
SELECT action, ts::VARCHAR AS ts, count <= most AS allowed, greatest(0, most - count)::INTEGER AS remaining FROM l UNION ALL SELECT action, ts::VARCHAR, true, NULL FROM a WHERE action = 'health'""")
def f_limiter_one_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one client makes all requests."""
    rows = table(spark, sf_dir, "events").select(F.lit("one").alias("client"), F.expr(_ACTIONS).alias("action"), "ts")
    return limiter.limit(rows).select("action", F.col("ts").cast("string").alias("ts"), "allowed", "remaining")


_LD = '<script type="application/ld+json">'


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS s FROM orders),
i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem),
found AS (SELECT k, '' AS path, ['Order'] AS types FROM o UNION ALL SELECT k, (1 + s)::VARCHAR, ['Person'] FROM o UNION ALL SELECT k, '0', ['Note', '5'] FROM o WHERE s = 1
  UNION ALL SELECT k, (2 + s) || '.' || n, CASE WHEN l_partkey % 2 = 0 THEN ['Product'] ELSE ['Product', 'Offer'] END FROM o JOIN i ON l_orderkey = k)
SELECT k::VARCHAR AS order_key, path, type FROM (SELECT k, path, unnest(types) AS type FROM found)""")
def n_walk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that state an order with its customer and items; a key that is a whole number comes first, a text that
    looks like an object is none, and a page's second block is broken."""
    part = F.col("l_partkey").cast("string")
    kinds = F.when(F.col("l_partkey") % 2 == 0, '"Product"').otherwise('["Product","Offer"]')
    item = F.concat(F.lit('{"sku":'), part, F.lit(',"@type":'), kinds, F.lit(',"note":"{\\"@type\\":\\"none\\"}"}'))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("t"))))["t"], ",").alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    note = F.when(F.col("o_orderkey") % 3 == 0, ',"7":{"@type":["Note",5.0]}').otherwise("")
    body = F.concat(F.lit('{ "@type" : "Order","customer":{"@type":"Person","id":'), F.col("o_custkey"), F.lit('},"items":['), F.coalesce("items", F.lit("")), F.lit("]"), note, F.lit("}"))
    html = F.concat(F.lit(f"<html>{_LD}"), body, F.lit(f"</script>{_LD}"), body, F.lit(" also</script></html>"))
    found = orders.select(F.col("o_orderkey").cast("string").alias("page_url"), F.posexplode(pages.raw_blocks(html)).alias("block", "raw"))
    return blocks.walk_types(found, body=False).select(F.col("page_url").alias("order_key"), F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "type")


@query("""SELECT url, CASE page_id % 4 WHEN 0 THEN ['Organization', 'Place'] WHEN 1 THEN ['Article', 'K' || (page_id % 10)] WHEN 2 THEN ['LocalBusiness'] ELSE [] END AS types,
CASE page_id % 4 WHEN 3 THEN 0 ELSE 1 END AS valid, CASE page_id % 4 WHEN 3 THEN 1 ELSE 0 END AS invalid, CASE page_id % 4 WHEN 0 THEN 'Site ' || page_id WHEN 2 THEN 'Shop ' || page_id END AS site_name FROM pages""")
def n_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a block that its number decides."""
    k = F.col("page_id")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit('{"@graph":[{"@type":"Organization","name":"Site '), k, F.lit('","location":{"@type":"Place"}}]}')))
        .when(k % 4 == 1, F.concat(F.lit('{"@type":["Article","K'), k % 10, F.lit('"],"name":"none","author":{"@type":"Article"}}')))
        .when(k % 4 == 2, F.concat(F.lit('[{"@type":"LocalBusiness","name":"Shop '), k, F.lit('"}]')))
        .otherwise('{"@type":"Article"')
    )
    facts = pages.page_facts(web_pages(spark, sf_dir).withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit(_LD), said, F.lit("</script>"))))
    valid = F.size(F.filter("blocks", lambda b: b["valid"]))
    return facts.select(F.col("final_url").alias("url"), F.col("schema_types").alias("types"), valid.alias("valid"), (F.size("blocks") - valid).alias("invalid"), F.when(k % 2 == 0, F.col("site_name")).alias("site_name"))


_PLACE = ["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def _placed(spark: SparkSession, sf_dir: str) -> ordinals.Numbered:
    return ordinals.numbered(table(spark, sf_dir, "lineitem").select(*_PLACE), [F.desc("l_shipdate"), *_PLACE[1:]])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) AS ordinal FROM lineitem")
def w_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every line item, newest first."""
    return _placed(spark, sf_dir).rows().select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "ordinal")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) AS ordinal FROM lineitem ORDER BY ordinal LIMIT 100 OFFSET 1900")
def l_ordinal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twentieth page of a hundred; the page is the feature."""
    return _placed(spark, sf_dir).page(20, 100).select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


_SUMMED = f"""l AS (SELECT {_HOST} AS d, page_id % 5 = 0 OR page_id % 3 <> 0 AS live, page_id % 5 = 0 OR page_id % 4 <> 0 AS follow FROM pages),
g AS (SELECT d, count(*) AS n, count_if(live) AS l, count_if(live AND follow) AS f FROM l GROUP BY d)"""


@query(f"""WITH {_SUMMED}, s AS (SELECT sum(n)::BIGINT AS candidates, sum(l)::BIGINT AS live, count_if(l > 0)::BIGINT AS domains, sum(f)::BIGINT AS follow, max(l)::BIGINT AS largest FROM g)
SELECT candidates, live, domains, follow, live - follow AS nofollow, candidates - live AS unverified, round(follow / live, 6) AS follow_ratio, round(largest / live, 6) AS concentration FROM s""")
def u_merged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in three batches, one of which comes twice; every fifth is seen again in the next batch, then live."""
    k = F.col("page_id")
    link = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), k).alias("source_url"), U.host(F.col("url")).alias("source_domain"), F.lit("https://t.com/").alias("target_url"), F.lit("a").alias("anchor"), F.lit(False).alias("no_link_found"), F.lit(200).alias("http_status"))
    first = link.withColumns({"live": k % 3 != 0, "follow": k % 4 != 0, "rel": F.when(k % 4 != 0, "").otherwise("nofollow"), "part": k % 3})
    again = link.where(k % 5 == 0).withColumns({"live": F.lit(True), "follow": F.lit(True), "rel": F.lit(""), "part": (k + 1) % 3})
    rows, state = first.unionByName(again), LinkState(spark, f"{shared_folder(spark)}/links-{uuid.uuid4().hex}")
    for batch in (0, 1, 1, 2):
        state.merge(rows.where(F.col("part") == batch), batch)
    return state.summary().withColumns({c: F.round(c, 6) for c in ("follow_ratio", "concentration")})


# an address of each line item as a number, and where the private ranges begin and end
_NUMBER = "CASE WHEN l_partkey % 3 = 0 THEN 10 WHEN l_partkey % 3 = 1 THEN 172 ELSE l_suppkey % 256 END * 16777216::BIGINT + (l_partkey % 256) * 65536 + (l_orderkey % 256) * 256 + l_linenumber"
_FOURS = "(VALUES ('0.0.0.0/8', 0, 8), ('10.0.0.0/8', 10, 8), ('100.64.0.0/10', 25664, 10), ('127.0.0.0/8', 127, 8), ('169.254.0.0/16', 43518, 16), ('172.16.0.0/12', 44048, 12), ('192.0.0.0/24', 12582912, 24), ('192.168.0.0/16', 49320, 16), ('198.18.0.0/15', 50706, 15), ('224.0.0.0/3', 224, 3)) r(range, base, n)"


@query(f"""WITH a AS (SELECT {_NUMBER} AS x FROM lineitem), d AS (SELECT x, count(*) AS c FROM a GROUP BY x),
r AS (SELECT range, CASE n WHEN 24 THEN base * 256::BIGINT WHEN 8 THEN base * 16777216::BIGINT WHEN 3 THEN base * 16777216::BIGINT ELSE base * 65536::BIGINT END AS first, (1::BIGINT << (32 - n)) AS size FROM {_FOURS}),
f AS (SELECT x, c, (SELECT range FROM r WHERE x >= first AND x < first + size) AS range FROM d)
SELECT x AS number, range, c::BIGINT AS items FROM f""")
def p_address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of line items, one in two as IPv6 writes it, in the ranges that must not be fetched."""
    x = F.expr(_NUMBER)
    byte = lambda k: F.shiftright(x, k).bitwiseAND(F.lit(255)).cast("string")
    four = F.concat_ws(".", *[byte(k) for k in (24, 16, 8, 0)])
    six = F.concat(F.lit("::FFFF:"), F.hex(F.shiftright(x, 16)), F.lit(":"), F.hex(x.bitwiseAND(F.lit(65535))))
    rows = table(spark, sf_dir, "lineitem").select(x.alias("number"), F.when(F.col("l_linenumber") % 2 == 0, four).otherwise(six).alias("address"))
    return addresses.held_by(rows, "address", addresses.private_ranges(spark)).groupBy("number", "range").agg(F.count("*").alias("items"))
