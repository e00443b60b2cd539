"""Operator 6: license scans by MinHash bands over overlapping text windows. DataFrame functions only.

A template of n shingles (five words each) is looked for in windows of n + s - 1 shingles that begin every s shingles, s
an eighth of n, so an occurrence of the template lies whole in some window. A window that holds 0.8 of the template's
shingles has a Jaccard similarity of at least 0.59 with it; with ``BANDS`` bands of one hash each it is retrieved with a
probability of 1 - 0.41^16, more than 0.999999. Retrieved windows count when they hold 0.8 of the template's shingles.

Only windows with at least one shingle of a template are hashed: others hold none of it, so no match is lost. Before
that, texts are passed over by plain substring searches for words that stand in so many of each template's shingles that
too few are left without them.

The registered templates are whole texts, in ``license_texts``, notices and grants, names, and SPDX lines; each reports
for itself, so a text may have several rows, as a license whose clauses another repeats has. A notice that is worded
otherwise is found by the name in it. One of few words must stand whole: its words differ from another license's by
one or two only.

Cases: a null or empty text, and one of fewer words than a shingle unless a template is as short, matches nothing. A
template of fewer words than a shingle is one shingle of its own words and is found by them. Repeated rows count once for
their id. An empty table or list of templates gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize

WORDS, BANDS, CONTAINED = 5, 16, 0.8
#: Templates are sent to all executors; more words than these in all are refused.
MOST_WORDS = 200_000

# Notices by which public licenses are named or granted.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "lgpl-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
}
NAMES = {
    "apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"),
    "mit": ("MIT License",),
    "isc": ("ISC License",),
    "bsd-2-clause": ("BSD 2-Clause License",),
    "bsd-3-clause": ("BSD 3-Clause License",),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "mpl-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "cc0-1.0": ("CC0 1.0",),
    "unlicense": ("The Unlicense",),
}
SPDX = "Apache-2.0 MIT ISC BSD-2-Clause BSD-3-Clause GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 Unlicense Zlib".split()
TEMPLATES = (
    NOTICES
    | {f"{name}-name-{k}": text for name, texts in NAMES.items() for k, text in enumerate(texts, 1)}
    | {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
    | {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shapes(templates: dict[str, str]) -> list[tuple[str, list[list[str]], int, int, int]]:
    """Of each template: name, distinct shingles, words a shingle, stride and shingles of a window."""
    out = []
    for name, text in sorted(templates.items()):
        words = template_words(text)
        if words:
            k = min(WORDS, len(words))
            n = len(words) - k + 1
            stride = max(1, n // 8)
            out.append((name, [list(x) for x in dict.fromkeys(tuple(words[i : i + k]) for i in range(n))], k, stride, n + stride - 1))
    if sum(len(s) for x in out for s in x[1]) > MOST_WORDS * WORDS:
        raise ValueError("the templates are too large to be sent to every executor")
    return out


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(words: list[Column], k: int) -> Column:
    return F.xxhash64(*words, F.lit(k))


# Lambdas of one argument each, over what a loop has at hand.


def _shingles(k: int):
    return lambda words: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(k)), lambda i: _hash([F.get(words, i + F.lit(j)) for j in range(k)], k)))


def _hashed(k: int):
    return lambda s: _hash([F.get(s, F.lit(j)) for j in range(k)], k)


def _starts(h: Column, stride: Column, width: Column) -> Column:
    # The last window may be shorter, so that every shingle is in one.
    return F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)) + stride - 1, stride)


def _constant(values: list[int]) -> Column:
    # One literal once it is folded, instead of an expression a value.
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _holds(known: dict[int, Column]):
    return lambda x: F.coalesce(*(F.when(x["k"] == k, F.arrays_overlap(x["h"], every)) for k, every in known.items()), F.lit(False))


def _of_each(ks: list[int]):
    return lambda words: F.array(*(F.struct(F.lit(k).alias("k"), _shingles(k)(words).alias("h")) for k in ks))


def _window(a: Column) -> Column:
    return F.struct(a.alias("at"), F.slice("h", a + 1, F.col("width")).alias("w"))


def _seeded(b: int):
    return lambda v: F.xxhash64(v, F.lit(b))


def _sketch(shingles: Column) -> Column:
    return F.array(*(F.array_min(F.transform(shingles, _seeded(b))) for b in range(BANDS)))


def telling(shingles: list[list[str]], known: set[str] = frozenset()) -> set[str]:
    """Words without any of which, and any known one, a text holds less than ``CONTAINED`` of the shingles."""
    left, out = [s for s in shingles if not known.intersection(s)], set()
    while len(left) >= CONTAINED * len(shingles):
        # Long words stand in fewer other texts.
        count = Counter(w for s in left for w in {x for x in s if len(x) >= 7} or {max(s, key=lambda w: (len(w), w))})
        word = max(count, key=lambda w: (count[w], len(w), w))
        out.add(word)
        left = [s for s in left if word not in s]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (the best window's), first_word (of the first matching window) and n_windows."""
    spark = docs.sparkSession
    own = shapes(TEMPLATES if templates is None else templates)
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if not own:
        return spark.createDataFrame([], f"doc_id {base.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word int, n_windows long")
    rare: set[str] = set()
    for x in own:
        rare |= telling(x[1], rare)
    low = F.lower("text")
    near = base
    if len(rare) <= 64:
        some = F.lit(False)
        for w in sorted(rare, key=lambda w: (-len(w), w)):
            # Short ones stand within too many other words.
            some = some | (low.contains(w) if len(w) >= 5 else low.contains(w) & low.rlike(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"))
        near = base.filter(some)
    ks = sorted({x[2] for x in own})
    known = []
    for k in ks:
        # The templates' hashes come from the same functions, once.
        table = spark.createDataFrame([(*x[:1], *x[2:], x[1]) for x in own if x[2] == k], "license string, k int, stride int, width int, words array<array<string>>")
        hashed = table.withColumn("s", F.transform("words", _hashed(k)))
        known += hashed.select("license", "k", "stride", "width", "s", _sketch(F.col("s")).alias("tb")).collect()
    # The one pass over all texts: the hashes of those with a shingle of some template. Outer generators keep the
    # optimizer from computing their input once more to see whether it is empty.
    every = {k: _constant(sorted({v for r in known if r["k"] == k for v in r["s"]})) for k in ks}
    hashes = F.filter(F.flatten(F.transform(F.array(text_words(F.col("text"))), _of_each(ks))), _holds(every))
    held = materialize(near.select("doc_id", F.explode_outer(hashes).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.k", "x.h"))
    forms = [(k, stride, width, sorted({v for r in known if (r["k"], r["stride"], r["width"]) == (k, stride, width) for v in r["s"]})) for k, stride, width in sorted({(r["k"], r["stride"], r["width"]) for r in known})]
    cut = spark.createDataFrame(forms, "k int, stride int, width int, every array<bigint>")
    placed = held.join(F.broadcast(cut), "k").filter(F.arrays_overlap("h", "every"))
    inside = F.filter(F.transform(_starts(F.col("h"), F.col("stride"), F.col("width")), _window), lambda x: F.arrays_overlap(x["w"], F.col("every")))
    windows = placed.select("doc_id", "k", "stride", "width", F.explode_outer(inside).alias("x")).filter("x IS NOT NULL")
    banded = windows.select("doc_id", "k", "stride", "width", F.col("x.at").alias("at"), F.array_distinct("x.w").alias("w"), F.posexplode_outer(_sketch(F.col("x.w"))).alias("band", "value"))
    # Retrieval: a template and a window that agree in a band. Then the whole shingle sets decide.
    keys = spark.createDataFrame([(r["license"], r["k"], r["stride"], r["width"], b, v) for r in known for b, v in enumerate(r["tb"])], "license string, k int, stride int, width int, band int, value bigint")
    sets = spark.createDataFrame([(r["license"], r["s"]) for r in known], "license string, s array<bigint>")
    found = banded.join(F.broadcast(keys), ["k", "stride", "width", "band", "value"]).join(F.broadcast(sets), "license")
    contained = found.select("doc_id", "license", "at", (F.size(F.array_intersect("w", "s")) / F.size("s")).alias("c"))
    out = contained.filter(F.col("c") >= CONTAINED).distinct()
    return out.groupBy("doc_id", "license").agg(F.max("c").alias("containment"), F.min("at").cast("int").alias("first_word"), F.count("*").alias("n_windows"))
