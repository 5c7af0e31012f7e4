"""License scans by MinHash bands over overlapping text windows, with DataFrame functions only.

A text's words (lower-cased, runs of letters and digits) give shingles of five.  For each template length there is one
width of windows, about half again as wide, at such steps that every stretch as long as the template lies whole in a window.
Windows without any shingle of a template of their width hold none of it and are left out first, which loses nothing.
The others get BANDS MinHash values, each a band of its own, and so do the templates; equal bands retrieve candidates.
A window that contains 0.8 of a template has a Jaccard similarity of at least 1/4 with it, so 64 bands miss it with a
probability of at most 0.75**64 = 1e-8.  Exact containment of the template's shingles in the window then decides.

Texts that hold fewer shingles of every template of a width than a match needs are left out before windows are cut, which
also loses nothing; so full license bodies cost little where there are none.

Licenses share wording: the GPL-2.0 notice holds 0.87 of the GPL-3.0's.  Of two matches of different licenses in overlapping
windows, of which one has half or more of its matched shingles in the other, only that with more matched shingles stays
(if equal, that of which more is there; if that is equal too, both).

Templates are a parameter (KNOWN: the notices below and the bodies in license_texts); their shingles and bands are broadcast,
so there may be at most TEMPLATES.  Templates of fewer than five words are an error.  Null, empty and short texts have no match;
texts of any length are read whole.  Extra columns are ignored; an empty table gives an empty result.
Rows that agree in doc_id and text are one document.  A document may match several licenses, and a row is returned for each.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import row_key

SHINGLE, CONTAINED, BANDS, TEMPLATES = 5, 0.8, 64, 5000

#: Sentences by which texts state their license.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."

#: More sentences of this kind; the query's SQL has only NOTICES.
MORE_NOTICES = [
    *[(f"{short}-{v}", f"{start} the GNU {name} License, version {v.removesuffix('.0')}.") for short, name, versions in (("GPL", "General Public", ["2.0"]), ("LGPL", "Lesser General Public", ["2.1", "3.0"]), ("AGPL", "Affero General Public", ["3.0"])) for v in versions for start in ("This work is licensed under", "Licensed under the terms of")],
    ("GPL-3.0", "Licensed under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", _GNU.format(";", "General Public License", ";", 2)),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("AGPL-3.0", _GNU.format(":", "Affero General Public License", ",", 3)),
    ("LGPL-3.0", _GNU.format(":", "Lesser General Public License", ",", 3)),
    ("LGPL-2.1", _GNU.format(";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-2.0", _LIBRARY.format("Library General Public License", 2)),
    ("LGPL-2.1", _LIBRARY.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _LIBRARY.format("Lesser General Public License", 3)),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bodies() -> list[tuple[str, str]]:
    """License bodies, each file of license_texts named after its license."""
    return [(x.stem, x.read_text(encoding="utf-8")) for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


#: All templates; the first are NOTICES.
KNOWN = NOTICES + MORE_NOTICES + bodies()


def scan_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def width(n: int) -> int:
    """Words in a window for a template of n words."""
    return max(n + 3, n + n // 2)


def _shingles(words: Column) -> Column:
    """The set of shingle hashes of an array of words."""
    n = F.size(words) - SHINGLE + 1
    all_of = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(SHINGLE)]))
    return F.when(n > 0, F.array_distinct(all_of)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("least")))


def _once(x: Column) -> Column:
    """x, in a generator: expressions above use its value and are not merged with it, which would compute it for each use."""
    return F.explode(F.array(x))


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """license, n (words), shingles."""
    if len(notices) > TEMPLATES:
        raise ValueError(f"more than {TEMPLATES} templates")
    short = [x for x, t in notices if len([w for w in re.split(r"[\W_]+", t) if w]) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(notices)], "template int, license string, text string")
    rows = rows.select("template", "license", _once(scan_words(F.col("text"))).alias("words")).where(F.size("words") >= SHINGLE)
    return rows.select("template", "license", F.size("words").alias("n"), _once(_shingles(F.col("words"))).alias("shingles"))


def _best(found: Column) -> Column:
    """The matches of a document without those that a better one of another license explains."""

    def explained(a: Column, b: Column) -> Column:
        better = (F.size(b["got"]) > F.size(a["got"])) | ((F.size(b["got"]) == F.size(a["got"])) & (b["share"] > a["share"]))
        beside = (b["at"] < a["end"]) & (a["at"] < b["end"])
        return (a["license"] != b["license"]) & beside & better & (2 * F.size(F.array_intersect(a["got"], b["got"])) >= F.size(a["got"]))

    return F.filter(found, lambda a: ~F.exists(found, lambda b: explained(a, b)))


def scan(docs: DataFrame, notices: list[tuple[str, str]] = KNOWN, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment (best of all windows), first_word (of the first window that has it), n_windows."""
    spark = docs.sparkSession
    known = templates(spark, notices)
    widths = known.groupBy("n").agg(F.min(F.ceil(F.size("shingles") * contained)).alias("least")).withColumn("wide", F.greatest(F.col("n") + 3, F.col("n") + F.floor(F.col("n") / 2)).cast("int")).withColumn("step", F.col("wide") - F.col("n") + 1)
    wanted = known.select("n", F.explode("shingles").alias("s")).distinct().join(widths, "n")
    words = docs.select(*row_key(), scan_words(F.col("text")).alias("words"))
    places = words.select("_d", "_t", "words", F.posexplode_outer("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - SHINGLE)
    places = places.withColumn("s", F.xxhash64(F.col("word"), *[F.get("words", F.col("pos") + j) for j in range(1, SHINGLE)]))
    hits = places.join(F.broadcast(wanted), "s").groupBy("_d", "_t", "n", "wide", "step", "least").agg(F.collect_set("s").alias("s"), F.collect_set("pos").alias("pos")).where(F.size("s") >= F.col("least"))
    low = lambda p: F.greatest(F.lit(0), F.ceil((p + SHINGLE - F.col("wide")) / F.col("step"))).cast("int")
    high = lambda p: F.floor(p / F.col("step")).cast("int")
    ks = F.array_distinct(F.flatten(F.transform(F.filter("pos", lambda p: low(p) <= high(p)), lambda p: F.sequence(low(p), high(p)))))
    likely = hits.select(F.col("_d").alias("d"), F.col("_t").alias("t"), "n", "wide", "step", ks.alias("ks"))
    texts = docs.select(*row_key(), "text").join(likely, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_t") == F.col("t")))
    windows = texts.select("_d", "_t", "n", "wide", "step", "ks", _once(scan_words(F.col("text"))).alias("words")).select("_d", "_t", "words", "n", "wide", "step", F.explode("ks").alias("k"))
    windows = windows.select("_d", "_t", "n", "wide", (F.col("k") * F.col("step")).alias("at"), _once(F.slice("words", F.col("k") * F.col("step") + 1, F.col("wide"))).alias("window"))
    windows = windows.select("_d", "_t", "n", "wide", "at", _once(_shingles(F.col("window"))).alias("mine"))
    signed = windows.select("*", F.explode(_bands(F.col("mine"))).alias("x")).select("_d", "_t", "n", "wide", "at", "mine", "x.band", "x.least")
    theirs = known.select("n", "template", F.explode(_bands(F.col("shingles"))).alias("x")).select("n", "template", "x.band", "x.least")
    near = signed.join(F.broadcast(theirs), ["n", "band", "least"]).groupBy("_d", "_t", "n", "at", "template").agg(F.first("mine").alias("mine"), F.first("wide").alias("wide"))
    got = near.join(F.broadcast(known.select("template", "license", "shingles")), "template").withColumn("got", F.array_intersect("mine", "shingles"))
    held = got.withColumn("share", F.size("got") / F.size("shingles")).where(F.col("share") >= contained)
    found = held.groupBy("_d", "_t").agg(F.collect_list(F.struct("license", "at", (F.col("at") + F.col("wide")).alias("end"), "share", "got")).alias("found"))
    best = found.select("_d", "_t", F.explode(_best(F.col("found"))).alias("x")).select("_d", "_t", "x.license", "x.share", "x.at")
    return (
        best.groupBy(F.col("_d").alias("doc_id"), F.col("_t"), "license")
        .agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
        .select("doc_id", "license", "containment", "first_word", "n_windows")
    )
