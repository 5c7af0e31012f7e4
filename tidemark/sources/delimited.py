"""Delimited import (S19, D01-D06): files as rows of text to classified URLs and domains.

Small files are rows (filename, body), so many are imported at once: `rows_of`.  Large ones are read in many tasks: `read_rows`.
A quoted cell may hold line ends, so whether a line ends a row depends on all that stands before it in the file: on whether
the number of quotes up to its end is even.  Each chunk of a file says how many rows end in it if it begins outside quotes and
if it begins within; these pairs are combined over a file's chunks, of which there are few; then each chunk knows how it begins
and which rows its lines belong to.  Only rows of several lines are put together by a grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.urls import clean_cell, host, import_domain, import_url, root_domain

DELIMITERS, SNIFFED, CAPS = [",", ";", "\t"], 8, {"source": 5000, "domain": 2000, "target": 5000}
#: What a header says that tells what a column holds, and names by which a header is known.
ROLES = {
    "source": r"linking page|source page|source url|backlink|linking url|referring page|from page",
    "domain": r"^site$|linking site|referring domain|^domain$",
    "target": r"target page|target url|linked page|destination",
}
HEADERS = r"^(?:linking page|source page|source url|backlink|linking url|referring page|from page|site|linking site|referring domain|domain|target page|target url|linked page|destination|last crawled|links?|pages?)$"


#: Stand for the end of a cell and of a row, and begin what stands for any of the three in a text: characters that no text should have.
CELL, ROW, ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"


def _outside(line: Column) -> Column:
    """What of a line stands outside quotes."""
    return F.array_join(F.filter(F.split(line, '"', -1), lambda x, k: k % 2 == 0), "")


def _commonest(lines: Column) -> Column:
    """The commonest delimiter outside quotes of an array of lines; the first of equally common ones."""
    head = F.array_join(F.transform(lines, _outside), "\n")
    counts = F.array(*[F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)])
    return F.array_max(counts)["d"]


def _plain(body: Column) -> Column:
    return F.regexp_replace(body, r"^\x{FEFF}", "")


def delimiter(body: Column) -> Column:
    """The commonest delimiter outside quotes in the first lines that are not empty; comma if none is there.  Lines are
    taken one by one: quotes of one don't reach into the next."""
    return _commonest(F.slice(F.filter(F.split(_plain(body), r"\r?\n", -1), lambda x: T.trim(x) != ""), 1, SNIFFED))


def records(body: Column, delim: Column) -> Column:
    """Rows of trimmed cells; quotes, which may open and close anywhere in a cell, may hold delimiters, line ends, and
    doubled quotes.  Blank rows are dropped.

    The text is split at its quotes: every other piece stands outside.  There, ends of cells and rows are marked; nothing between two
    pieces within is a doubled quote.  So the time is in proportion to the text."""
    plain, safe = _plain(body), _plain(body)
    for mark, said in ((ESCAPE, "c"), (CELL, "a"), (ROW, "b")):
        safe = F.replace(safe, F.lit(mark), F.lit(ESCAPE + said))
    safe = F.concat(F.when(F.rlike(plain, F.lit(f"[{CELL}{ROW}{ESCAPE}]")), safe).otherwise(plain), F.lit("\n"))  # so the last piece is never empty
    parts = F.split(safe, '"', -1)

    def told(x: Column, k: Column) -> Column:
        ended = F.replace(F.regexp_replace(x, r"\r\n?|\n", ROW), delim, F.lit(CELL))
        return F.when(k % 2 == 1, x).when((x == "") & (k > 0), '"').otherwise(ended)

    back = lambda v: F.when(F.instr(v, ESCAPE) > 0, F.replace(F.replace(F.replace(v, F.lit(ESCAPE + "a"), F.lit(CELL)), F.lit(ESCAPE + "b"), F.lit(ROW)), F.lit(ESCAPE + "c"), F.lit(ESCAPE))).otherwise(v)
    rows = F.split(F.array_join(F.transform(parts, told), ""), ROW, -1)
    return F.filter(F.transform(rows, lambda r: F.transform(F.split(r, CELL, -1), lambda v: T.trim(back(v)))), lambda r: F.exists(r, lambda v: v != ""))


def rows_of(files: DataFrame) -> DataFrame:
    """files (filename, body) to (filename, line, row): the rows of each, numbered from 0 on."""
    return files.select("filename", F.posexplode(records(F.col("body"), delimiter(F.col("body")))).alias("line", "row"))


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(filename, chunk, at, value): lines of files, where chunk is what a task reads of one, and at their order in it."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("at"), "value")


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _begun(lines: DataFrame) -> DataFrame:
    """(filename, chunk, within, before): whether a chunk begins within quotes, and how many rows ended before it."""
    inside = Window.partitionBy("filename", "chunk").orderBy("at")
    odd = (F.sum(_quotes(F.col("value"))).over(inside) % 2).alias("odd")
    ends = lines.select("filename", "chunk", "at", odd).groupBy("filename", "chunk").agg(F.max_by("odd", "at").alias("odd"), F.count_if(F.col("odd") == 0).alias("outside"), F.count_if(F.col("odd") == 1).alias("inside"))
    over = Window.partitionBy("filename").orderBy("chunk")
    known = ends.withColumn("within", (F.sum("odd").over(over) - F.col("odd")) % 2).withColumn("ends", F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside")))
    return known.select("filename", "chunk", "within", (F.sum("ends").over(over) - F.col("ends")).alias("before"))


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(filename, record, value): the texts of files cut at the line ends outside quotes, numbered from 0 on in each file."""
    lines = _lines(spark, paths)
    inside = Window.partitionBy("filename", "chunk").orderBy("at")
    begun = _begun(lines).withColumnsRenamed({"filename": "_f", "chunk": "_c"})
    odd = F.sum(_quotes(F.col("value"))).over(inside) % 2
    counted = lines.withColumn("odd", odd)
    counted = counted.withColumn("even_ends", F.count_if(F.col("odd") == 0).over(inside)).withColumn("odd_ends", F.count_if(F.col("odd") == 1).over(inside))
    told = counted.join(begun, (F.col("filename") == F.col("_f")) & (F.col("chunk") == F.col("_c")))
    ends = F.col("odd") == F.col("within")
    told = told.withColumn("ends", ends).withColumn("record", F.col("before") + F.when(F.col("within") == 0, F.col("even_ends")).otherwise(F.col("odd_ends")) - ends.cast("long"))
    began = (F.col("odd") + F.col("within") + _quotes(F.col("value"))) % 2 == 0  # whether the line begins outside
    one = F.col("ends") & began
    whole = told.where(one).select("filename", "record", "value")
    parts = told.where(~one).groupBy("filename", "record").agg(F.sort_array(F.collect_list(F.struct("chunk", "at", "value"))).alias("x"))
    return whole.union(parts.select("filename", "record", F.array_join("x.value", "\n").alias("value")))


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(filename, line, row) of delimited files, each read by as many tasks as it has splits; line numbers rise within a file,
    with gaps."""
    lines = _lines(spark, paths).where(T.trim(F.col("value")) != "")
    first = F.row_number().over(Window.partitionBy("filename").orderBy("chunk", "at"))
    heads = lines.withColumn("n", first).where(F.col("n") <= SNIFFED).groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("x"))
    delims = heads.select(F.col("filename").alias("_f"), _commonest(F.transform("x.value", lambda v: _plain(F.regexp_replace(v, r"\r$", "")))).alias("delim"))
    cut = read_records(spark, paths).withColumn("value", F.when(F.col("record") == 0, _plain(F.col("value"))).otherwise(F.col("value")))
    rows = cut.join(delims, F.col("filename") == F.col("_f")).select("filename", "record", F.posexplode(records(F.col("value"), F.col("delim"))).alias("sub", "row"))
    return rows.select("filename", (F.col("record") * 2**20 + F.col("sub")).alias("line"), "row")


def _links(cell: Column, own: Column, always: str | None = None) -> Column:
    """A URL as an array of (kind, value), empty if the cell is none: a page of the own site, or of a target column, is a target."""
    url = F.transform(F.array(import_url(cell)), lambda u: F.struct(F.when(F.lit(always == "target") | (root_domain(host(u)) == own), "target").otherwise("source").alias("kind"), u.alias("value")))
    return F.filter(url, lambda x: x["value"] != "")


def _domains(cell: Column, own: Column) -> Column:
    name = F.transform(F.array(import_domain(cell)), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value")))
    return F.filter(name, lambda x: (x["value"] != "") & (x["value"] != own))


def classify(files: DataFrame) -> DataFrame:
    """Files (filename, body, and target_url if it is known) to filename, kind, value, ord; see `classify_rows`."""
    target = F.col("target_url") if "target_url" in files.columns else F.lit("")
    return classify_rows(files.select("filename", target.alias("target_url"), F.posexplode(records(F.col("body"), delimiter(F.col("body")))).alias("line", "row")))


def classify_rows(rows: DataFrame) -> DataFrame:
    """Rows (filename, line, row, and target_url if it is known) to filename, kind, value, ord; kind is source, domain,
    target or ignored.

    Columns that a file's first row names keep their roles.  A row of which these give nothing is looked through cell by cell:
    a URL of the own site is a target, another a source, and what is a domain a domain.  A row without any is ignored;
    blank rows are not counted.  Values are distinct within a kind.  A file's first row is found by an aggregation that tasks
    combine first, so a file of most rows is no hot group."""
    own = root_domain(host(F.col("target_url"))) if "target_url" in rows.columns else F.lit("")
    rows = rows.select("filename", own.alias("own"), "line", "row")
    first = rows.groupBy("filename").agg(F.min("line").alias("first"), F.min_by("row", "line").alias("headers"))
    first = first.select(F.col("filename").alias("_f"), "first", F.transform("headers", lambda h: F.lower(clean_cell(h))).alias("headers"))
    at = {name: F.array_position(F.transform("headers", lambda h: F.rlike(h, F.lit(pattern))), True).alias(name) for name, pattern in ROLES.items()}  # noqa: B023
    first = first.select("_f", "first", F.exists("headers", lambda h: F.rlike(h, F.lit(HEADERS))).alias("headed"), F.struct(*at.values()).alias("at"))
    lines = rows.join(first, F.col("filename") == F.col("_f")).where("not (headed and line = first)").where(F.exists("row", lambda c: clean_cell(c) != ""))
    cell = {name: F.when(F.col(f"at.{name}") > 0, F.get("row", F.col(f"at.{name}") - 1)) for name in ROLES}
    named = F.concat(_links(cell["source"], F.col("own"), "source"), _links(cell["target"], F.col("own"), "target"), _domains(cell["domain"], F.col("own")))
    lines = lines.withColumn("found", named)

    def look(c: Column) -> Column:
        links = _links(c, F.col("own"))
        return F.when(F.size(links) > 0, links).when(F.rlike(clean_cell(c), F.lit(r"^\d+(?:\.\d+)?$")), F.slice(links, 1, 0)).otherwise(_domains(c, F.col("own")))

    lines = lines.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(F.flatten(F.transform("row", look))))
    nothing = F.array(F.struct(F.lit("ignored").alias("kind"), F.lit("").alias("value")))
    each = lines.select("filename", "line", F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(nothing)).alias("pos", "x"))
    each = each.select("filename", "x.kind", "x.value", (F.col("line").cast("long") * 100_000 + F.col("pos")).alias("ord"))
    kept = each.where("kind <> 'ignored'").groupBy("filename", "kind", "value").agg(F.min("ord").alias("ord"))
    return kept.union(each.where("kind = 'ignored'"))


def kinds(classified: DataFrame) -> DataFrame:
    """What each file is, by what it holds, and how many of each there are."""
    counts = {k: F.count_if(F.col("kind") == k) for k in ("source", "domain", "target", "ignored")}
    kind = F.when(F.col("source") > 0, "source-pages").when(F.col("domain") > 0, "referring-domains").when(F.col("target") > 0, "target-pages-only").otherwise("unrecognised")
    return classified.groupBy("filename").agg(*[c.alias(k) for k, c in counts.items()]).withColumn("file_kind", kind)


def capped(classified: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """An import keeps so many rows of each kind, the first ones of each file."""
    n = F.row_number().over(Window.partitionBy("filename", "kind").orderBy("ord", "value"))
    limit = F.lit(None).cast("int")
    for kind, most in (caps or CAPS).items():
        limit = F.when(F.col("kind") == kind, most).otherwise(limit)
    return classified.withColumn("_n", n).where(limit.isNull() | (F.col("_n") <= limit)).drop("_n")
