"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are `SHINGLE` words (a shorter template is one
shingle of its own length). Windows start at every shingle that some template has, so they overlap, and span
1, 2, 4, ... shingles; a template is sought in the smallest size that holds it. A window keeps the shingles
that any template has, so its Jaccard similarity with a contained template stays near 1. `BANDS` bands of
`ROWS` minima retrieve templates: at similarity 0.8 a template is missed with probability
(1 - 0.8^ROWS)^BANDS = 8e-8. Exact containment, the share of the template's shingles in the window, then
verifies: at least `threshold`.

A text is scanned only if it holds the longest word of one of so many of a template's shingles that a match
cannot lack them all, so nothing is lost. Templates are a small list of the caller's, sent as a broadcast table; its size
is checked.

Defined results: null text matches nothing; rows with the same id are one document; one row per document
and template found, with the best containment and the first word's place; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS = 5, 16, 2

#: Public licence notices, by SPDX-style name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles_of(text: str) -> list[str]:
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))) if words else []


def _bands(shingles: Column) -> Column:
    """The band keys of an array of shingles."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(seed))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, most_templates: int = 20_000) -> DataFrame:
    """doc_id, license_id, containment, first_word (from 0)."""
    known = {name: s for name, t in (TEMPLATES if templates is None else templates).items() if (s := shingles_of(t))}
    if len(known) > most_templates:
        raise ValueError(f"{len(known)} templates are more than a broadcast table should hold ({most_templates})")
    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).where("false")
    span = {name: 1 << (len(s) - 1).bit_length() for name, s in known.items()}
    every = sorted({s for group in known.values() for s in group})
    sizes = sorted({len(s.split()) for s in every})
    needed = {name: -(-round(threshold * 1_000_000) * len(s) // 1_000_000) for name, s in known.items()}
    # a match has `needed` of a template's shingles, so at least one of any len - needed + 1 of them
    longest = lambda s: max(s.split(), key=len)
    anchors = sorted({longest(s) for name, group in known.items() for s in sorted(group, key=lambda s: -len(longest(s)))[: len(group) - needed[name] + 1]})

    spark = docs.sparkSession
    table = spark.createDataFrame([(n, span[n], s) for n, s in sorted(known.items())], "license_id string, span int, shingles array<string>")
    banded = table.select("license_id", "span", "shingles", F.explode(_bands(F.col("shingles"))).alias("band"))

    lower = F.lower(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), lower.alias("low")).where(F.col("low").rlike("|".join(map(re.escape, anchors))))
    words = texts.select("doc_id", F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    # only where a word opens some template shingle is a shingle built
    opening = sorted({s.split()[0] for s in every})
    at = F.filter(F.transform("w", lambda w, i: F.when(w.isin(*opening), i)), lambda i: i.isNotNull())
    opened = words.select("doc_id", "w", at.alias("at"))

    def built(n: int) -> Column:
        return F.transform("at", lambda i: F.struct(i.alias("i"), F.array_join(F.slice(F.col("w"), i + 1, n), " ").alias("s")))

    hits = F.flatten(F.array(*[built(n) for n in sizes]))
    found = opened.select("doc_id", F.array_sort(F.filter(hits, lambda x: x["s"].isin(*every))).alias("h"))

    least = {}
    for name, s in known.items():
        least[span[name]] = min(least.get(span[name], needed[name]), needed[name])

    def windows(size: int) -> Column:
        inside = lambda x, k: F.filter(F.slice(F.col("h"), k + 1, size * len(sizes)), lambda y: y["i"] < x["i"] + size)
        all_ = F.transform("h", lambda x, k: F.struct(x["i"].alias("at"), F.lit(size).alias("span"), F.array_distinct(F.transform(inside(x, k), lambda y: y["s"])).alias("shingles")))
        return F.filter(all_, lambda v: F.size(v["shingles"]) >= least[size])

    seen = found.select("doc_id", F.explode(F.concat(*[windows(size) for size in sorted(least)])).alias("v")).select("doc_id", "v.at", "v.span", F.col("v.shingles").alias("seen"))
    probes = seen.select("doc_id", "at", "span", "seen", F.explode(_bands(F.col("seen"))).alias("band"))
    met = probes.join(F.broadcast(banded), ["span", "band"])
    share = F.size(F.array_intersect("seen", "shingles")) / F.size("shingles")
    good = met.select("doc_id", "license_id", "at", share.alias("containment")).where(F.col("containment") >= threshold)
    return good.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"))
