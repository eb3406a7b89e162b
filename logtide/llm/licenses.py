"""License scans: which documents hold which license notice, and where.

MinHash bands over overlapping windows of words retrieve templates, exact
shingle containment verifies them.

A template of L words is looked for in windows of L + s - 1 words that start
every s = max(1, L // 4) words, so any L words in a row lie inside a window. A
window that holds a share c of the template's n shingles has a resemblance of
at least c n / (n + n_window - c n); ``bands_for`` gives the bands (of one
MinHash row each) that make a collision that likely. A collision is only a
candidate: the window's shingles are then compared with the template's.

A few *pivot words* are so chosen that more than 1 - containment of each
template's shingles hold one. A window without any cannot reach the
containment, so only windows that hold one are looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "BSD-head": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "rights-reserved": "All rights reserved.",
}

TOKEN = r"[\p{L}\p{N}]+"
MAX_TEMPLATES = 1000  # the templates are held on the driver and written into the plan


def tokens(text: Column) -> Column:
    """Words (runs of letters and digits) in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def shingles(words: list[str], k: int) -> list[str]:
    """Distinct runs of k words; a shorter list is one shingle."""
    n = max(1, len(words) - k + 1)
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(n)))


def bands_for(n: int, n_window: int, containment: float, certainty: float) -> int:
    """Bands after which a window of this containment has collided with probability ``certainty``."""
    held = math.ceil(containment * n - 1e-9)
    resemblance = held / (n + n_window - held)
    return 1 if resemblance >= 1 else math.ceil(math.log(1 - certainty) / math.log(1 - resemblance))


def pivot_words(by_template: Mapping[str, list[str]], containment: float) -> list[str]:
    """Words without which a text cannot hold the share ``containment`` of any template's shingles.

    Of each template more than 1 - ``containment`` of the shingles hold a pivot
    word, so a text with none misses that share. Greedy: most shingles of
    templates not yet settled times squared word length, ties by code point.
    """
    out: list[str] = []
    while True:
        left = []
        for parts in by_template.values():
            free = [s for s in parts if not set(out) & set(s.split(" "))]
            if len(free) >= containment * len(parts) - 1e-9:
                left += free
        if not left:
            return out
        count = Counter(w for s in left for w in set(s.split(" ")))
        out.append(min(count, key=lambda w: (-count[w] * len(w) ** 2, w)))


def _minhashes(hashes: str, bands: int) -> str:
    """SQL: array with the smallest of the hashes after xor with each band's constant (each shingle is equally likely to be it)."""
    return "array(" + ", ".join(f"array_min(transform({hashes}, h -> h ^ xxhash64({b}, 'band')))" for b in range(bands)) + ")"


def _strings(values: list[str]) -> str:
    """SQL array of strings that hold letters, digits and spaces only."""
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    k: int = 5,
    containment: float = 0.8,
    certainty: float = 0.999,
) -> DataFrame:
    """doc_id, license, containment (best window), word (number of that window's first word): one row per match.

    A template of fewer than ``k`` words is one shingle of its own length. Texts
    that are null, empty or without words match nothing. Of windows that tie
    the first is given. Repeated rows (same doc_id and text) give one row per
    license; rows that share a doc_id with other texts each count, and the best
    window of all of them is given. Null doc_ids stay. Other columns are not
    read.
    """
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    split = _template_words(spark, templates)
    docs = docs.select("doc_id", "text")
    by_length: dict[int, list[str]] = {}
    for name, words in split.items():
        by_length.setdefault(len(words), []).append(name)
    pivots = pivot_words({n: shingles(w, min(k, len(w))) for n, w in split.items()}, containment)
    at = F.expr(f"filter(sequence(0, size(_words) - 1), i -> array_contains({_strings(pivots)}, _words[i]))")
    # Without word borders, so it lets through more than texts with a pivot word.
    low = F.lower("text")
    quick = reduce(lambda a, b: a | b, [low.contains(w) for w in pivots])
    base = docs.filter(quick).select("doc_id", tokens(F.col("text")).alias("_words")).filter("size(_words) > 0")
    base = base.withColumn("_at", at)
    # One pass over the text: the matches of all length classes are one array, exploded.
    classes = [_matches(spark, length, names, split, k, containment, certainty) for length, names in sorted(by_length.items())]
    found = base.select("doc_id", F.explode(F.flatten(F.array(*classes))).alias("_m"))
    best = found.groupBy("doc_id", F.col("_m.license").alias("license")).agg(
        F.max("_m.containment").alias("containment"), F.max_by("_m.word", F.struct(F.col("_m.containment"), -F.col("_m.word"))).alias("word")
    )
    return best


def _template_words(spark: SparkSession, templates: Mapping[str, str]) -> dict[str, list[str]]:
    """Templates split into words by the same expression as the texts."""
    rows = spark.createDataFrame([(str(n), t) for n, t in templates.items()], "name string, text string")
    out = {r[0]: list(r[1]) for r in rows.select("name", tokens(F.col("text"))).collect()}
    if not all(out.values()):
        raise ValueError("a template without words")
    return out


def _band_keys(spark: SparkSession, sets: Mapping[str, list[str]], bands: int) -> dict[str, list[int]]:
    """The templates' MinHashes, by the same expression as the windows'."""
    t = spark.createDataFrame(list(sets.items()), "name string, parts array<string>")
    t = t.select("name", F.expr("transform(parts, s -> xxhash64(s))").alias("hashes"))
    return {r[0]: list(r[1]) for r in t.select("name", F.expr(_minhashes("hashes", bands))).collect()}


def _matches(
    spark: SparkSession, length: int, names: list[str], split: Mapping[str, list[str]], k: int, containment: float, certainty: float
) -> Column:
    """Array of (license, containment, word) for the templates of one length; SQL text, one parse for the whole expression."""
    size = min(k, length)
    step = max(1, length // 4)
    span = length + step - 1  # words of a window; at the end of a text it is shorter
    sets = {n: shingles(split[n], size) for n in names}
    bands = max(bands_for(len(s), span - size + 1, containment, certainty) for s in sets.values())
    keys = _band_keys(spark, sets, bands)
    # The windows that hold a pivot word at p: the last one that starts at or before p, and those before it that reach p.
    back = f"sequence(0, {(span - 1) // step})"
    each = f"transform(_at, p -> filter(transform({back}, k -> (p div {step} - k) * {step}), s -> s >= 0 AND s + {span} > p))"
    starts = f"filter(array_distinct(flatten({each})), s -> s <= greatest(size(_words) - {length}, 0))"
    parts = (
        f"array_distinct(transform(sequence(0, greatest(least({span}, CAST(size(_words) - s AS INT)) - {size}, 0)), "
        f"i -> array_join(slice(_words, CAST(s + i + 1 AS INT), {size}), ' ')))"
    )
    with_parts = f"transform({starts}, s -> named_struct('word', CAST(s AS INT), 'parts', {parts}))"
    with_hashes = f"transform({with_parts}, w -> named_struct('word', w.word, 'parts', w.parts, 'hashes', transform(w.parts, x -> xxhash64(x))))"
    marked = f"transform({with_hashes}, w -> named_struct('word', w.word, 'parts', w.parts, 'marks', {_minhashes('w.hashes', bands)}))"
    found = []
    for n in names:
        hit = " OR ".join(f"w.marks[{b}] = {key}L" for b, key in enumerate(keys[n]))
        share = f"size(array_intersect(w.parts, {_strings(sets[n])})) / {len(sets[n])}D"
        row = f"named_struct('license', '{_quoted(n)}', 'containment', {share}, 'word', w.word)"
        found.append(f"filter(transform(filter({marked}, w -> {hit}), w -> {row}), m -> m.containment >= {containment}D)")
    return F.expr(found[0] if len(found) == 1 else f"concat({', '.join(found)})")


def _quoted(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")
