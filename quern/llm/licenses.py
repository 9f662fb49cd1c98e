"""License scans by conditional compression (operator 4)."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter
from functools import cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, text_or_empty

# Public wordings of licenses and of the notices that name them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
)
#: Every template has more words with these stems than 0.1 of its words, so a text without any can't hold its wording with that share of differences.
ANCHOR = r"(?i)licen[cs]|permi(?:ssion|tted)|copyright|warrant|distribut|software|binary|waive|mozilla|eclipse|unencumbered|domain"
WORD = re.compile(r"[a-z0-9]+(?:[.'\-][a-z0-9]+)*")
#: Words before and after an anchor that belong to its block.
REACH = 60


def wording(text: str) -> list[tuple[str, int]]:
    return [(m.group(), m.start()) for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text))]


@cache
def compressor(dictionary: bytes = b""):
    """Explicit parameters, or zstandard takes other ones with a dictionary than without, and savings would be of two measures."""
    import zstandard

    level = zstandard.ZstdCompressionParameters.from_level(3, source_size=1 << 14, write_content_size=False)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=level)
    return zstandard.ZstdCompressor(compression_params=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


@cache
def templates() -> list[tuple[str, list[str], object, Counter]]:
    out = []
    for name, text in TEMPLATES:
        words = [w for w, _ in wording(text)]
        out.append((name, words, compressor(" ".join(words).encode()), Counter(words)))
    return out


@cache
def anchor() -> re.Pattern:
    return re.compile(ANCHOR)


def blocks(words: list[tuple[str, int]], reach: int = REACH) -> list[tuple[int, int]]:
    """Ranges of words around anchors; those that touch are one."""
    out: list[tuple[int, int]] = []
    for i, (w, _) in enumerate(words):
        if anchor().search(w):
            a, b = max(0, i - reach), min(len(words), i + reach + 1)
            if out and a <= out[-1][1]:
                a = out.pop()[0]
            out.append((a, b))
    return out


def windows(a: int, b: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of at most `size` words that cover a block; what is at most `overlap` long is whole in one of them."""
    out = [(a, min(b, a + size))]
    while out[-1][1] < b:
        a += size - overlap
        out.append((a, min(b, a + size)))
    return out


def free(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a range beside the taken ones, which are sorted and apart."""
    out = []
    for k in range(max(0, bisect_right(taken, (a, a)) - 1), len(taken)):
        if taken[k][0] >= b:
            break
        if a < taken[k][0]:
            out.append((a, taken[k][0]))
        a = max(a, taken[k][1])
    return [*out, (a, b)] if a < b else out


def differences(template: list[str], block: list[str], most: int | None = None) -> tuple[int, int, int] | None:
    """(differences, from, to): the fewest words to insert, drop or change to make the template of a range of the block; of equal ones the first. None if more than `most`.

    The range's end is found with a bit for each word of the template (Myers), its start word by word before that end.
    """
    size = len(template)
    same: dict[str, int] = {}
    for i, w in enumerate(template):
        same[w] = same.get(w, 0) | 1 << i
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, n = full, 0, size
    best, end = size, 0
    for j, w in enumerate(block, 1):
        eq = same.get(w, 0)
        flat = eq | down
        cross = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(cross | up)) & full, up & cross
        n += bool(more & last) - bool(less & last)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(flat | more)) & full, more & flat
        if n < best:
            best, end = n, j
    if most is not None and best > most:
        return None
    at = max(0, end - size - best)
    row = [(0, j) for j in range(at, end + 1)]
    for i, w in enumerate(template, 1):
        new = [(i, at)]
        for j, b in enumerate(block[at:end], 1):
            new.append(min((row[j - 1][0] + (w != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return best, row[-1][1], end


def best_in(words: list[tuple[str, int]], a: int, b: int, most: float) -> tuple | None:
    """(rank, row of found_in, from, to) of a range's confirmed wording with the fewest differences for its length, of equal ones the longest, then the first."""
    own = [w for w, _ in words[a:b]]
    have = Counter(own)
    near = [k for k, (_, t, _, c) in enumerate(templates()) if sum(min(n, have[w]) for w, n in c.items()) >= len(t) - int(most * len(t))]
    if not near:
        return None
    data = " ".join(own).encode()
    bare = len(compressor().compress(data))
    ranked = sorted(((bare - len(templates()[k][2].compress(data))) / len(templates()[k][1]) ** 0.5, k) for k in near)[::-1]
    best = None
    for saved, k in ranked:
        name, template, _, _ = templates()[k]
        if best and best[0][:2] < (0, -len(template)):  # exact and longer
            continue
        found = differences(template, own, int(most * len(template)))
        if found and found[2] > found[1]:
            n, i, j = found
            rank = (n / len(template), -len(template), a + j, a + i, k)
            if best is None or rank < best[0]:
                best = rank, (name, words[a + i][1], j - i, n, round(saved * len(template) ** 0.5)), a + i, a + j
    return best


def found_in(text: str, most: float) -> list[tuple[str, int, int, int, int]]:
    """(license, place, words, differences, reduction) of a text's notices, by place.

    Blocks are looked at in windows that overlap by the longest wording that can be confirmed. Of each window the
    templates are left out that have more words missing there than may differ, which is exact. All others are compared
    word by word, in the order of how many bytes they save as its raw dictionary, for their own length; those with at
    most `most` differences a word are confirmed. Of confirmed ranges of a text that overlap the one with the fewest
    differences for its length stays, then the longest. What is left beside it is looked at again.
    """
    words = wording(text)
    longest = max(len(t) + int(most * len(t)) for _, t, *_ in templates())
    reach = max(REACH, longest)
    heap: list[tuple] = []
    taken: list[tuple[int, int]] = []
    out = []

    def look(a: int, b: int) -> None:
        if best := best_in(words, a, b, most):
            heappush(heap, (*best, a, b))

    for block in blocks(words, reach):
        for window in windows(*block, 2 * reach + 1, longest):
            look(*window)
    while heap:  # what is left of a range has no better wording than the whole, so the first of the heap is the best of all
        _, row, i, j, a, b = heappop(heap)
        if any(s <= i and j <= e for s, e in free(a, b, taken)):
            insort(taken, (i, j))
            out.append(row)
        for part in free(a, b, taken):
            look(*part)
    return sorted(out, key=lambda r: r[1])


def scan(df: DataFrame, most: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per license wording in a text: id, license, place (code points before it), n_words, differences, exact, reduction.

    Texts with a stem of ANCHOR, which Spark tells, go to Python; all words within reach of one are looked at,
    which is whole for `most` up to 0.1. A null or empty text has none; repeated rows repeat theirs.
    """

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (id_col, "license", "place", "n_words", "differences", "exact", "reduction")}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for name, place, n, d, saved in found_in(text, most):
                for k, v in zip(out, (key, name, place, n, d, d == 0, saved), strict=True):
                    out[k].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    some = df.select(id_col, text_or_empty(text_col).alias("_text")).filter(F.col("_text").rlike(ANCHOR))
    return by_batch(some, f"`{id_col}` {kind}, license string, place long, n_words int, differences int, exact boolean, reduction int", run)
