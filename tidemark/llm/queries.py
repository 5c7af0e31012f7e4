"""The registered queries of the training-data operators, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, decontaminate, fim, language_id, lexical, licenses, line_dedup, ngram_join, packing, quality, toxicity, url_filter
from tidemark.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def ranks(path: str | None = None) -> dict[bytes, int]:
    return bpe.read_ranks(path or public_tokenizers.path(RANKS))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks(), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), near=None)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of decontamination, for which there is no SQL."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_near_items")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "group_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=50)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(WORDS), end=1, capacity=4096, apart=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed="7", unit="line", rate=100, spm=50, keep_text=False)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_decontaminate, op4_toxicity, op5_nearest_neighbours, op6_quality, op7_ngram_join, op8_language_id, op9_license_scan, op10_url_filter, op11_lexical_search, op12_packing, op13_fill_in_middle, op3_near_matches)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Runs of ten words or more are made of windows that end, or begin, where they first reach ten words.
_LINE_DEDUP = """
WITH docs AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM docs),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda x: x <> '')) AS w FROM lines),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM counted),
forward AS (SELECT a.doc_id, a.p AS a, (SELECT min(b.p) FROM summed b WHERE b.doc_id = a.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= 10) AS b FROM summed a),
backward AS (SELECT a.doc_id, (SELECT max(b.p) FROM summed b WHERE b.doc_id = a.doc_id AND b.p <= a.p AND a.c - b.c + b.w >= 10) AS a, a.p AS b FROM summed a),
windows AS (SELECT DISTINCT doc_id, a, b FROM (SELECT * FROM forward UNION ALL SELECT * FROM backward) WHERE a IS NOT NULL AND b IS NOT NULL),
said AS (SELECT w.doc_id, a, b, string_agg(line, chr(10) ORDER BY p) AS said FROM windows w JOIN summed s ON s.doc_id = w.doc_id AND s.p BETWEEN a AND b GROUP BY w.doc_id, a, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY said, b - a ORDER BY doc_id, a) AS n FROM said),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS p FROM ranked WHERE n > 1),
kept AS (SELECT c.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY c.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.p = c.p GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS said
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS said FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN iw ON iw.said = dw.said AND iw.n = dw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)"""

_NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k : k + 4], ' ')))) AS s FROM d WHERE len(w) > 0),
classes AS (SELECT s, min(doc_id) AS class_id FROM sets GROUP BY s),
parts AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM classes),
common AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS m, b.n AS n, count(*) AS c FROM parts a JOIN parts b ON a.x = b.x AND a.class_id < b.class_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 10 * c >= 8 * (m + n - c)),
bothways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, y.b FROM reach JOIN bothways y ON y.a = reach.b),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM bothways GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(g.group_id, d.doc_id) AS group_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes c ON c.s = sets.s LEFT JOIN counts n ON n.a = c.class_id LEFT JOIN groups g ON g.a = c.class_id"""


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, x, t.replace("'", "''")) for k, (x, t) in enumerate(licenses.NOTICES))
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    shingles = "list_distinct(list_transform(generate_series(1, len({0}) - 4), lambda k: array_to_string({0}[k : k + 4], ' ')))"
    return f"""
WITH notices(template, license, text) AS (VALUES {rows}),
t AS (SELECT template, license, len(w) AS n, {shingles.format("w")} AS s FROM (SELECT *, {words} AS w FROM notices) WHERE len(w) >= 5),
widths AS (SELECT DISTINCT n, greatest(n + 3, n + n // 2) AS wide, greatest(n + 3, n + n // 2) - n + 1 AS step FROM t),
d AS (SELECT doc_id, {words} AS w FROM documents),
cut AS (SELECT doc_id, n, k, w[k + 1 : k + wide] AS v FROM (SELECT *, unnest(generate_series(0, len(w) - 5, step)) AS k FROM d, widths WHERE len(w) >= 5)),
v AS (SELECT doc_id, n, k, {shingles.format("v")} AS s FROM cut WHERE len(v) >= 5),
held AS (SELECT doc_id, license, k, len(list_intersect(v.s, t.s)) / len(t.s) AS share FROM v JOIN t ON t.n = v.n)
SELECT doc_id, license, max(share) AS containment, min(k)::BIGINT AS first_word, count(*)::BIGINT AS n_windows FROM held WHERE share >= 0.8 GROUP BY doc_id, license"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_LEXICAL_SEARCH = f"""
WITH docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM docs),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM items JOIN df USING (term) JOIN tf USING (term), size GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

_FILL_IN_MIDDLE = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, list_transform(generate_series(0, 3), lambda k: ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS x FROM units),
cuts AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b FROM drawn),
parts AS (SELECT *, array_to_string(list_filter(u, lambda y, k: k <= a), '') AS prefix, array_to_string(list_filter(u, lambda y, k: k > a AND k <= b), '') AS middle, array_to_string(list_filter(u, lambda y, k: k > b), '') AS suffix FROM cuts),
formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM formed"""

SQL: dict[str, str] = {"op2_line_dedup": _LINE_DEDUP, "op3_decontaminate": _DECONTAMINATE, "op7_ngram_join": _NGRAM_JOIN, "op9_license_scan": _license_sql(), "op11_lexical_search": _LEXICAL_SEARCH, "op13_fill_in_middle": _FILL_IN_MIDDLE}
