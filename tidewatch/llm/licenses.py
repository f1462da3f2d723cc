"""License scans by patience alignment of texts with license templates.

A text's and a template's words are aligned by patience: words that occur once in both are
anchors, the longest increasing subsequence of their places is kept, and the gaps between kept
anchors are aligned in the same way (runs of equal words at a gap's ends are taken first). A
template's coverage is the share of its words that the alignment matches; a place of at least
the asked coverage is found.

Texts are scanned whole. A place is a dense window, of at most WIDE times the template's words, or
several pieces as dense with PIECE matched words or more each and foreign text of any length between
them. Windows come first, and pieces are sought outside the windows of all templates, and within those of others
where that matches more words. Whatever is covered holds all but a few of the words that the template has once, so only windows with enough
distinct ones of these are aligned, the shortest ones first, from left to right. Words are unique
or not within such a window, so neither a second copy of a license nor common words around it
take anchors away; what a window leaves of the template's ends is aligned with the words next to it.
Each place of a template is reported, and the scan goes on behind it. The words that windows leave are
then searched for pieces in stretches that grow from level to level up to the whole text, half of each
shared with the next, so that each level reads the text twice. A text that holds none of a
template's ``needed`` words can't cover it (the other words are too few), which is tested on the
JVM before any text goes to Python.

Defined cases: null and empty texts have no license; repeated rows give a row each; several
templates may be found in one text, but where pieces of their places overlap only the one with the most
matched words stays (then the best covered, then the smaller name, then the earlier); extra
columns don't matter.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, tidy
from tidewatch.session import table

#: Usual wordings of license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense-full": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
        "in perpetuity of all present and future rights to this software under copyright law."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
COVERAGE = 0.85
#: A window has at most so many times the template's words, and a piece so many times its matched ones. Matched words of a piece, at
#: least, and foreign words in a row that end one, if there are more of them.
WIDE, PIECE = 2, 10
WORD = re.compile(r"[0-9A-Za-z]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def needed_words(words: Sequence[str], coverage: float) -> set[str]:
    """The longest words, as many as leave fewer than coverage asks; a covered text holds one of them."""
    left, out = Counter(words), set()
    for word in sorted(left, key=lambda w: (-len(w), w)):
        if sum(n for w, n in left.items() if w not in out) < coverage * len(words):
            break
        out.add(word)
    return out


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that grows in its second part; places are sorted by the first."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, b) in enumerate(places):
        pile = bisect.bisect_left(tops, b)
        tops[pile : pile + 1] = [b]
        ends[pile : pile + 1] = [n]
        before.append(ends[pile - 1] if pile else -1)
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(places[n])
        n = before[n]
    return chain[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, both increasing. Gaps wait on a stack, not on the call stack."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        at = {w: n for n, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = _increasing([(n, at[w]) for n, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in at])
        if not anchors:
            continue
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            gaps.append((p + 1, r, q + 1, s))
        out += anchors
    return sorted(out)


class Template:
    """The words of a license, and which of them a covered window must hold."""

    def __init__(self, words: Sequence[str], coverage: float):
        self.words, self.least = list(words), math.ceil(coverage * len(words) - 1e-9)
        times = Counter(words)
        self.once = {w: k for k, w in enumerate(words) if times[w] == 1}
        # Each word that isn't matched may be one that the template has once.
        self.need = max(1, len(self.once) - (len(words) - self.least))

    def fit(self, words: Sequence[str], begin: int, end: int, after: int) -> list[tuple[int, int]]:
        """Matched places (of words, of the template) from a window, and from the words next to it for what is left of the template's ends."""
        pairs = [(begin + a, b) for a, b in align(words[begin:end], self.words)]
        if not pairs:
            return pairs
        (first, missing), (last, known) = pairs[0], pairs[-1]
        if missing:
            low = max(after, first - WIDE * missing)
            pairs = [(low + a, b) for a, b in align(words[low:first], self.words[:missing])] + pairs
        if rest := len(self.words) - known - 1:
            pairs += [(last + 1 + a, known + 1 + b) for a, b in align(words[last + 1 : last + 1 + WIDE * rest], self.words[known + 1 :])]
        return pairs

    def places(self, words: Sequence[str], at: Mapping[str, Sequence[int]]) -> Iterator[list[tuple[int, int]]]:
        met = sorted((n, k) for w, k in self.once.items() for n in at.get(w, ()))
        if len({k for _, k in met}) < self.need:
            return
        held: Counter[int] = Counter()
        left = after = 0
        for right, (n, k) in enumerate(met):
            if n < after:
                continue
            held[k] += 1
            while left < right:
                place, word = met[left]
                if place > n - WIDE * len(self.words) and held[word] == 1 and len(held) <= self.need:
                    break
                left += 1
                held[word] -= 1
                if not held[word]:
                    del held[word]
            if len(held) < self.need:
                continue
            pairs = self.fit(words, met[left][0], n + 1, after)
            if len(pairs) >= self.least:
                yield pairs
                after, held = pairs[-1][0] + 1, Counter()
                left = bisect.bisect_left(met, (after, -1))

    def scattered(self, words: Sequence[str], at: Mapping[str, Sequence[int]], taken: Sequence[tuple[int, int]]) -> Iterator[list[list[tuple[int, int]]]]:
        """Pieces of each place that no window holds, among the words outside taken (begin, end of words)."""
        if self.least < 2 * PIECE:
            return
        free = np.ones(len(words), bool)
        for begin, end in taken:
            free[begin:end] = False
        met = {w: [n for n in at.get(w, ()) if free[n]] for w in self.once}
        if sum(map(bool, met.values())) < self.need:
            return
        rest = np.flatnonzero(free).tolist()
        width = 2 * WIDE * len(self.words)
        while True:
            begin = 0
            while begin < len(rest):
                stretch = rest[begin : begin + width]
                pieces: list[list[tuple[int, int]]] = []
                if sum(bisect.bisect_left(m, stretch[0]) < bisect.bisect_right(m, stretch[-1]) for m in met.values()) >= self.need:
                    pieces = dense_pieces([(stretch[a], b) for a, b in align([words[n] for n in stretch], self.words)])
                if sum(map(len, pieces)) < self.least:
                    begin += width // 2
                    continue
                yield pieces
                for piece in pieces:
                    free[piece[0][0] : piece[-1][0] + 1] = False
                rest = [n for n in rest if free[n]]
                met = {w: [n for n in m if free[n]] for w, m in met.items()}
            if width >= len(rest):
                return
            width *= 2


def dense_pieces(pairs: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Matched places cut where more than PIECE foreign words stand in a row; without pieces that are short, or thin."""
    pieces: list[list[tuple[int, int]]] = []
    for n, pair in enumerate(pairs):
        if not n or pair[0] - pairs[n - 1][0] > PIECE + 1:
            pieces.append([])
        pieces[-1].append(pair)
    return [p for p in pieces if len(p) >= PIECE and p[-1][0] - p[0][0] < WIDE * len(p)]


def scan(text: str, templates: Mapping[str, Template]) -> list[tuple[str, float, int, int]]:
    """(name, coverage, begin, end) in characters of each template's places, best covered first."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    known = set().union(*(t.once for t in templates.values()))
    at: dict[str, list[int]] = {}
    for n, w in enumerate(words):
        if w in known:
            at.setdefault(w, []).append(n)
    found = {name: [[pairs] for pairs in template.places(words, at)] for name, template in templates.items()}
    windows = [piece for _, pieces in _best(found, templates, len(words)) for piece in pieces]
    for name, template in templates.items():
        own = _extents(found[name])
        found[name] += template.scattered(words, at, [*windows, *own])
        found[name] += template.scattered(words, at, own)  # a window of another template may be part of this one
    best = _best(found, templates, len(words))
    return sorted(((name, share, spans[pieces[0][0]][0], spans[pieces[-1][1] - 1][1]) for (name, share), pieces in best), key=lambda f: (-f[1], f[2], f[0]))


def _extents(places: Sequence[list[list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """Begin and end, in words, of each piece."""
    return [(piece[0][0], piece[-1][0] + 1) for pieces in places for piece in pieces]


def _best(found: Mapping[str, list], templates: Mapping[str, Template], n_words: int) -> list[tuple[tuple[str, float], list[tuple[int, int]]]]:
    """(name, coverage) and pieces of places; where some overlap, the one with most words."""
    ranked = []
    for name, places in found.items():
        for n, place in enumerate(places):
            size = sum(map(len, place))
            ranked.append((-size, -size / len(templates[name].words), name, n, _extents([place])))
    kept, free = [], np.ones(n_words, bool)
    for _, share, name, _, pieces in sorted(ranked):
        if all(free[begin:end].all() for begin, end in pieces):
            kept.append(((name, -share), pieces))
            for begin, end in pieces:
                free[begin:end] = False
    return kept


FOUND = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and licenses: array<struct<name, coverage, begin, end>>, best first, for each row."""
    split = {name: Template(words_of(text), coverage) for name, text in templates.items()}
    needed = sorted(set().union(*(needed_words(t.words, coverage) for t in split.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("name", "coverage", "begin", "end"), f, strict=True)) for f in scan(t, split)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, FOUND)], ["doc_id", "licenses"])

    may = F.col("text").rlike("(?i)" + "|".join(needed))
    return docs.select("doc_id", F.when(may, F.col("text")).alias("text")).mapInArrow(tidy(run), "doc_id long, licenses array<struct<name: string, coverage: double, begin: long, end: long>>")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    best = F.try_element_at("licenses", F.lit(1))
    return find_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", best["name"].alias("license"), best["coverage"].alias("coverage"), best["begin"].alias("begin"), best["end"].alias("end"),
        F.array_join(F.array_distinct(F.transform("licenses", lambda x: x["name"])), ",").alias("licenses"), F.size("licenses").alias("n_places"),
    )
