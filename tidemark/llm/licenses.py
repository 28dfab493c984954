"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

A text's words give shingles of three words, and the shingles are cut to
blocks. A window is two adjacent blocks, for block sizes 4, 8, 16, ...; a
template belongs to the smallest size whose block holds all its shingles, so
wherever it stands in a text, one window holds it whole and it makes up a
quarter of the window at least. ``BANDS`` MinHashes of one row each retrieve
it: with a share ``j`` of equal shingles the chance is ``1 - (1 - j) ** BANDS``
(see ``retrieval_chance``). Retrieved pairs are verified by the exact share of
the template's shingles that the window holds.

The MinHash of a window is the smaller one of its blocks', so minima are taken
once per smallest block, and a window can only meet a template's minimum if
one of those blocks has it; texts without such a block end there.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.support import operator_conf, scratch

SHINGLE = 3
BASE_BLOCK = 4
BANDS = 16
#: Masks of the MinHash orders: a hash is compared after XOR with one of them.
_RANDOM = random.Random(20)
MASKS = tuple(_RANDOM.getrandbits(64) - (1 << 63) for _ in range(BANDS))

#: Opening or characteristic words of public licences and notices.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                             "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                     "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                              "that the following conditions are met"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
)


def retrieval_chance(share: float, bands: int = BANDS) -> float:
    """Chance that one of ``bands`` MinHashes of one row meets at a share of equal shingles."""
    return 1 - (1 - share) ** bands


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+"), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(w: Column) -> Column:
    n = F.size(w) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.slice(w, 1, F.greatest(n, F.lit(1))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
                  ).otherwise(F.array().cast("array<bigint>"))


def minhash(hashes: Column, mask: int) -> Column:
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask))))


def block_minima(hashes: Column, size: int) -> Column:
    """Per block of ``size`` hashes, its minimum in each order."""
    starts = F.sequence(F.lit(1), F.size(hashes), F.lit(size))
    blocks = F.transform(starts, lambda s: F.slice(hashes, s, size))
    minima = F.transform(blocks, lambda b: F.array(*(minhash(b, m) for m in MASKS)))
    return F.when(F.size(hashes) > 0, minima).otherwise(F.array().cast("array<array<bigint>>"))


def block_size(shingles: int) -> int:
    size = BASE_BLOCK
    while size + 1 < shingles:
        size *= 2
    return size


def _template_table(spark: SparkSession, templates) -> DataFrame:
    table = spark.createDataFrame([(i, name, part, text) for i, (name, part, text) in enumerate(templates)],
                                  "template int, license string, part string, text string")
    table = table.withColumn("w", words(F.col("text"))).withColumn("h", F.array_distinct(shingle_hashes(F.col("w"))))
    return table.withColumn("minima", F.array(*(minhash(F.col("h"), m) for m in MASKS)))


def shingle_texts(w: Column) -> Column:
    n = F.size(w) - (SHINGLE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE))))
                  ).otherwise(F.array().cast("array<string>"))


def _found_in_windows(w: Column, base: Column, size: int, templates, containment: float) -> Column:
    """``(template, first_word, containment)`` of every window of two blocks of
    ``size`` and template of that size that meet in a band and pass the share."""
    per = size // BASE_BLOCK
    # a window's minimum in order k is that of its two blocks, which are 2 * per base blocks
    least = lambda b, k: F.array_min(F.transform(F.slice(base, b + 1, 2 * per), lambda m: m[k]))
    windows = F.transform(F.sequence(F.lit(0), F.size(base) - 1, F.lit(per)), lambda b: F.struct(
        b.alias("b"), F.array(*(least(b, k) for k in range(BANDS))).alias("bands")))
    wanted = [sorted({t["minima"][k] for t in templates}) for k in range(BANDS)]
    met = F.filter(windows, lambda x: F.array_contains(F.array(*(x["bands"][k].isin(wanted[k]) for k in range(BANDS))), True))
    known = F.array(*(F.struct(F.lit(t["template"]).alias("template"), F.array(*map(F.lit, t["minima"])).alias("minima"),
                               shingle_texts(F.array(*map(F.lit, t["w"]))).alias("shingles")) for t in templates))
    retrieved = lambda x: F.filter(known, lambda t: F.array_contains(F.zip_with(x["bands"], t["minima"], lambda u, v: u == v), True))
    share = lambda x, t: F.size(F.array_intersect(
        t["shingles"], shingle_texts(F.slice(w, x["b"] * BASE_BLOCK + 1, 2 * size + SHINGLE - 1)))) / F.size(t["shingles"])
    pairs = F.flatten(F.transform(met, lambda x: F.transform(retrieved(x), lambda t: F.struct(
        t["template"].alias("template"), (x["b"] * BASE_BLOCK).alias("first_word"), share(x, t).alias("containment")))))
    return F.filter(pairs, lambda p: p["containment"] >= containment)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = 0.8) -> DataFrame:
    """License templates that texts hold: ``doc_id, license, part, template, containment, first_word, places``.

    One row per row of ``docs`` and template with a share of at least
    ``containment`` of the template's distinct shingles in one window: the best
    share, the first word of the earliest window with it, and the number of windows that
    reach ``containment``. Words are runs of ASCII letters and digits in lower case.
    Null, empty and too short texts hold nothing, templates under three words are
    an error. Null and repeated ids keep their own rows; no rows give no rows;
    other columns are not read. ``templates`` is a literal list in the plan: a few hundred at most.
    """
    spark = docs.sparkSession
    with scratch(spark, "licenses") as s, operator_conf(spark):
        known = _template_table(spark, templates).collect()  # the list passed in
        if not all(t["h"] for t in known):
            raise ValueError(f"every template needs {SHINGLE} words")
        if not known:
            raise ValueError("no templates")
        sizes = {}
        for t in known:
            sizes.setdefault(block_size(len(t["h"])), []).append(t)
        wanted = [sorted({t["minima"][k] for t in known}) for k in range(BANDS)]

        # the row number also keeps the filter below from being computed from the text a second time
        cut = let(words(F.col(text_col)), lambda w: let(shingle_hashes(w), lambda h: F.struct(w.alias("w"), block_minima(h, BASE_BLOCK).alias("base"))))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), cut.alias("cut"))
        meets = lambda m: F.array(*(m[k].isin(wanted[k]) for k in range(BANDS)))
        rows = rows.where(F.exists("cut.base", lambda m: F.array_contains(meets(m), True)))
        rows = s.table(rows.select("row", "doc_id", "cut.w", "cut.base"), "rows")

        # all in the row: windows that meet a minimum, their templates by band, then the shares; only finds leave it
        found = [_found_in_windows(F.col("w"), F.col("base"), size, of_size, containment) for size, of_size in sizes.items()]
        verified = rows.select("row", "doc_id", F.explode(F.concat(*found)).alias("f")).select("row", "doc_id", "f.*")
        names = spark.createDataFrame([(t["template"], t["license"], t["part"]) for t in known], "template int, license string, part string")
        verified = verified.join(F.broadcast(names), "template")  # the list passed in
        best = verified.groupBy("row", "doc_id", "template", "license", "part").agg(
            F.min(F.struct((-F.col("containment")).alias("c"), "first_word")).alias("best"), F.count("*").alias("places"))
        return s.table(best.select("doc_id", "license", "part", "template", (-F.col("best.c")).alias("containment"),
                                   F.col("best.first_word").cast("bigint").alias("first_word"), "places"), "result", keep=True, few=True)
