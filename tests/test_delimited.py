"""Delimited reading against a character-by-character parser."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import delimited

BLANK = "\t\n\x0b\x0c\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def parsed(text, delim):
    rows, row, cell, quoted, k = [], [], "", False, 0
    text = text.removeprefix("﻿")
    while k <= len(text):
        c = text[k] if k < len(text) else None
        if c == '"' and quoted and text[k + 1 : k + 2] == '"':
            cell, k = cell + '"', k + 1
        elif c == '"':
            quoted = not quoted
        elif c is None or not quoted and c in (delim, "\n", "\r"):
            row.append(cell.strip(BLANK))
            cell = ""
            if c != delim:
                k += c == "\r" and text[k + 1 : k + 2] == "\n"
                rows += [row] if any(row) else []
                row = []
        else:
            cell += c
        k += 1
    return rows


def odd_text(rng, n):
    return "".join(rng.choices(['"', '""', ",", ";", "\t", "\n", "\r\n", "\r", "a", "é ", " b", "﷐", "﷑", "﷒", "x,y"], [3, 1, 4, 1, 1, 4, 1, 0.3, 4, 1, 1, 0.2, 0.2, 0.2, 1], k=n))


def test_records_agree_with_a_parser(spark):
    rng = random.Random(7)
    bodies = [odd_text(rng, rng.randint(0, 60)) for _ in range(400)] + ["", "﻿\"a\"\n", '"never closed, \n b', '""""', 'a""b', '"a" "b",c']
    rows = spark.createDataFrame([(k, b, d) for k, b in enumerate(bodies) for d in ",;\t"], "k int, body string, d string").select("k", "d", delimited.records(F.col("body"), F.col("d")).alias("r"))
    assert {(r["k"], r["d"]): r["r"] for r in rows.collect()} == {(k, d): parsed(b, d) for k, b in enumerate(bodies) for d in ",;\t"}


def test_records_take_time_in_proportion(spark):
    body = '"a ""quoted"" cell",2\n' * 200_000  # one row of the table; took hours when cells were folded one by one
    assert spark.createDataFrame([(body,)], "body string").select(F.size(delimited.records(F.col("body"), F.lit(","))).alias("n")).first()["n"] == 200_000


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, split):
    rng = random.Random(split)
    bodies = {f"{k}.csv": "h,i\n" + odd_text(rng, rng.choice([3, 50, 900])) + ('"' if k == 3 else "") for k in range(6)}
    bodies["empty.csv"], bodies["bom.csv"] = "", '﻿"a;b";"c\n\nd";\n;;\n"";e'
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = delimited.read_rows(spark, str(tmp_path))
        if split == 64:
            assert delimited._lines(spark, str(tmp_path)).select("chunk").distinct().count() > 3
        got = {}
        for r in sorted(rows.collect(), key=lambda r: (r["filename"], r["line"])):
            got.setdefault(r["filename"].rsplit("/", 1)[1], []).append(r["row"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sniffed = {r["name"]: r["d"] for r in spark.createDataFrame(list(bodies.items()), "name string, body string").select("name", delimited.delimiter(F.col("body")).alias("d")).collect()}
    assert got == {name: rows for name, body in bodies.items() if (rows := parsed(body, sniffed[name]))}


def test_classifying_a_split_file_agrees_with_a_body(spark, tmp_path):
    body = "Source URL;Note\r\n" + "".join(f'blog{k}.one.com/x;"a\n{k};"\r\n' for k in range(50)) + "n/a;-\r\n"
    (tmp_path / "a.csv").write_bytes(body.encode())
    whole = delimited.classify(spark.createDataFrame([("a", body, "https://one.org/")], "filename string, body string, target_url string"))
    split = delimited.classify_rows(delimited.read_rows(spark, str(tmp_path)).withColumn("target_url", F.lit("https://one.org/")))
    of = lambda df: sorted((r["kind"], r["value"]) for r in df.collect())
    assert of(whole) == of(split) and len(of(split)) == 51
