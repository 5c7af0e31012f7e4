"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with texts of that language.  A text is
lower-cased, encoded in pieces of CHUNK bytes with every dictionary, and gets the language whose encodings are smallest in
total.  The margin is the share that the best saves over the second best; below REJECT it is narrow and `rejected` is
true, and lang_pred still names the best.  The score rises with the margin from 0 to 1.

Dictionaries take at most TEXTS texts a language, those of smallest hash among all that may be learned from: whole ones in this
order until DICTIONARY bytes are full.  Texts of over LONG bytes come after all others and fill what room is left, the last up to
where it is full.  With so many languages that all dictionaries would pass TOTAL bytes, all are smaller (below LEAST bytes it is
an error).  Predictions read every whole text.

A text that is null or has no letter (category L of Unicode) is `und` with score 0, and so is any if nothing was learned.  With one language, all
others are that one with score 1.  Ties go to the language first in order.  Rows without lang or text teach nothing.
Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bucket

FOLDS, HELD_OUT = 3, 1
TEXTS, LONG, DICTIONARY, CHUNK, REJECT = 100, 12_000, 120_000, 4096, 0.01
#: Bytes of all dictionaries, which are collected and sent out, and the fewest of one.
TOTAL, LEAST = 64_000_000, 2000
_LETTER = regex.compile(r"\p{L}")
_LEVEL, _PARAMS = 5, dict(min_match=4, write_content_size=0, write_checksum=0)


def learn(docs: DataFrame, texts: int = TEXTS) -> dict[str, bytes]:
    """The content of each language's dictionary."""
    own = F.coalesce(bucket("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    long = (F.octet_length("text") > LONG).alias("long")
    known = docs.where(own & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "doc_id", long, F.xxhash64("text").alias("h"))
    # the smallest hash of each of 4 * texts parts first: combined before the shuffle, so a language of most rows is no hot group
    parts = known.groupBy("lang", "long", F.pmod("h", F.lit(4 * texts)).alias("part")).agg(F.min(F.struct("h", "doc_id")).alias("x"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("long", "x.h"))
    first = parts.select("lang", "long", "x.h", "x.doc_id", place.alias("n")).where(F.col("n") <= texts).drop("n")
    first = first.collect()  # at most `texts` a language
    n_langs = max(1, len({r["lang"] for r in first}))
    most = min(DICTIONARY, TOTAL // n_langs)
    if most < LEAST:
        raise ValueError(f"more than {TOTAL // LEAST} languages")
    chosen = docs.sparkSession.createDataFrame([(r["lang"], r["doc_id"], r["h"]) for r in first], f"lang string, doc_id {dict(docs.dtypes)['doc_id']}, h long")
    rows = docs.select("doc_id", "lang", "text", long, F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["lang", "doc_id", "h"])
    # no more of a text than a dictionary can take
    held = rows.groupBy("lang", "long", "h").agg(F.min(F.substr("text", F.lit(1), F.lit(most))).alias("text")).toLocalIterator()
    out: dict[str, list[tuple[bool, int, bytes]]] = {}
    for row in held:
        out.setdefault(row["lang"], []).append((row["long"], row["h"], row["text"].lower().encode()))
    return {lang: filled([x for _, _, x in sorted(got)], most) for lang, got in sorted(out.items())}


def filled(texts: list[bytes], most: int) -> bytes:
    """Whole texts in order while they fit, then the next up to where it is full, at the end of a character."""
    out = b""
    for x in texts:
        room = most - len(out) - bool(out)
        if room <= 0:
            break
        part = x if len(x) <= room else x[:room].decode(errors="ignore").encode()
        out += b"\n" * bool(out) + part
    return out


class Judge:
    def __init__(self, contents: dict[str, bytes]):
        params = zstd.ZstdCompressionParameters.from_level(_LEVEL, **_PARAMS)
        self.by_lang = []
        for lang, content in contents.items():
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by_lang.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=params)))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.by_lang or not _LETTER.search(text):
            return "und", 0.0, True
        data = text.lower().encode()
        chunks = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        sizes = sorted((sum(map(len, map(c.compress, chunks))), lang) for lang, c in self.by_lang)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin / (margin + 0.02), margin < REJECT


def predict(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; the dictionaries are bounded."""

    def run(batches):
        judge = Judge(contents)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    fed = docs.select("doc_id", F.coalesce(bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return fed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
