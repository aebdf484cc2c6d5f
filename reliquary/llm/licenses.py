"""License scans by patience alignment.

Text and template are aligned on the words unique to both: their longest increasing subsequence
anchors the alignment, equal words next to the anchors extend it, and the gaps in between are
aligned the same way; a gap without unique words is aligned by its longest common subsequence.
Coverage is the share of the template's words that found a place.
"""

from __future__ import annotations

import math
import pkgutil
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Short notices and opening clauses. A key is a licence, or licence#variant.
NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT#notice": "Released under the MIT License.",
    "MIT#clause": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Whole licence texts, files of texts/.
TEXTS = (
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC",
    "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)


def _gnu(program: str, kind: str, version: str) -> tuple[str, str]:
    """The first paragraph of a GNU licence's standard notice, and all three."""
    first = f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    return first, f"""{first} This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License
along with this {program}. If not, see <https://www.gnu.org/licenses/>."""


def _headers() -> dict[str, str]:
    """Standard notices, as the licences' publishers word them."""
    out = {
        "Apache-2.0#header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "MPL-2.0#header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    }
    gnu = [("General", "program", v, f"GPL-{v}.0") for v in "123"] + [("Lesser General", "library", v, f"LGPL-{v}") for v in ("2.1", "3.0")] + [("Affero General", "program", "3", "AGPL-3.0")]
    for kind, program, version, name in gnu:
        out[f"{name}#paragraph"], out[f"{name}#header"] = _gnu(program, kind, version.removesuffix(".0"))
    for short, long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
        for version, kind in (("4.0", "International"), ("3.0", "Unported")):
            words = f"Attribution{long if version == '4.0' else long.replace('NoDerivatives', 'NoDerivs')} {version} {kind}"
            out[f"CC-{short}-{version}#sentence"] = f"This work is licensed under a Creative Commons {words} License."
            out[f"CC-{short}-{version}#header"] = f"This work is licensed under the Creative Commons {words} License. To view a copy of this license, visit http://creativecommons.org/licenses/{short.lower()}/{version}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
    return out


#: Several templates a licence: notices, standard headers, whole texts.
TEMPLATES = NOTICES | _headers() | {f"{name}#text": pkgutil.get_data(__name__, f"texts/{name}.txt").decode("utf-8") for name in TEXTS}
_EDGE = b".,;:!?()[]{}\"'`*#<>|"


def words_of(data: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, without punctuation at their ends."""
    return [w for x in data.lower().split() if (w := x.strip(_EDGE))]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by first) that also rises in the second, by patience sorting."""
    tops, piles, back = [], [], {}
    for p in pairs:
        at = bisect_left(tops, p[1])
        if at == len(tops):
            tops.append(p[1])
            piles.append(p)
        else:
            tops[at], piles[at] = p[1], p
        back[p] = piles[at - 1] if at else None
    out, p = [], piles[-1] if piles else None
    while p:
        out.append(p)
        p = back[p]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Longest common subsequence, for gaps: a bit for each place of b, clear where a prefix of a gains a word."""
    at = defaultdict(int)
    for j, w in enumerate(b):
        at[w] |= 1 << j
    row = full = (1 << len(b)) - 1
    rows = [row]
    for w in a:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        once_a, once_b = ({w: k for w, k in zip(x[lo:hi], range(lo, hi), strict=True) if n[w] == 1} for x, lo, hi in ((a, i0, i1), (b, j0, j1)) for n in [Counter(x[lo:hi])])
        anchors = _increasing([(k, once_b[w]) for w, k in once_a.items() if w in once_b])
        if not anchors:
            out.extend((i0 + i, j0 + j) for i, j in _common(a[i0:i1], b[j0:j1]))
            continue
        i, j = i0, j0
        for p, q in anchors:
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        todo.append((i, i1, j, j1))
    return sorted(out)


class _Template:
    def __init__(self, name: str, text: str, least: float):
        self.license, _, self.kind = name.partition("#")
        self.words = words_of(text.encode())
        self.need = max(1, math.ceil(least * len(self.words) - 1e-9))
        self.times = Counter(self.words).most_common()

    def possible(self, times: dict[bytes, int]) -> bool:
        """Whether a text with so many of each word can hold enough of the template's words."""
        left = len(self.words) - self.need
        for w, n in self.times:
            if (has := times.get(w, 0)) < n:
                left -= n - has
                if left < 0:
                    return False
        return True


class Scanner:
    """Finds templates in word lists.

    A match that covers `least` of a template lies within twice its length and has one of any
    (1 - least) * length + 1 of the template's words, so only the surroundings of the rarest of
    these in the text are aligned: long texts cost no more than their hits, and none is missed.
    Surroundings are shared by places a quarter of a template apart, so a long template is aligned
    a few times at most for each of its lengths. Where a copy of the template would lie comes first,
    twice its length on either side after that.

    Each word of a text counts for one match, those with the most words first; what they leave is
    scanned again until nothing is found.
    """

    def __init__(self, templates: dict[str, str], least: float):
        self.templates = [_Template(k, v, least) for k, v in templates.items()]

    def scan(self, words: list[bytes]) -> list[tuple[str, str, float, int, int, int]]:
        """(license, template, coverage, matched, first word, last word) of each match, the best covered first."""
        words, out = list(words), []
        times, templates = Counter(words), self.templates
        while templates := [t for t in templates if len(words) >= t.need and t.possible(times)]:
            wanted, places = {w for t in templates for w, _ in t.times}, defaultdict(list)
            for i, w in enumerate(words):
                if w in wanted:
                    places[w].append(i)
            hits = [(t, h) for t in templates for h in self._matches(t, words, places)]
            if not hits:
                break
            for t, h in sorted(hits, key=lambda x: (-len(x[1]), len(x[0].words), x[1][0], x[0].license, x[0].kind)):
                if all(words[i] for i in h):
                    out.append((t.license, t.kind, len(h) / len(t.words), len(h), h[0], h[-1]))
                    for i in h:
                        times[words[i]] -= 1
                        words[i] = b""
        return sorted(out, key=lambda r: (-r[2], -r[3], r[0], r[4]))

    def _matches(self, t: _Template, words: list[bytes], places: dict[bytes, list[int]]) -> list[list[int]]:
        """The places of the words of each match of one template, none of them in two."""
        size, out, words = len(t.words), [], list(words)
        rare = sorted(range(size), key=lambda i: (len(places.get(t.words[i], ())), i))[: size - t.need + 1]
        found = sorted({(p, i) for i in rare for p in places.get(t.words[i], ())})
        step = max(1, size // 4)
        for close in (True, False):
            tried = set()
            for p, i in found:
                key = (p - i if close else p) // step
                if not words[p] or key in tried:
                    continue
                tried.add(key)
                lo, hi = (step * (key - 1), step * (key + 2) + size) if close else (step * key - 2 * size, step * (key + 1) + 2 * size)
                lo = max(0, lo)
                while t.possible(Counter(words[lo:hi])):
                    pairs = self._densest(align(words[lo:hi], t.words), 2 * size)
                    if len(pairs) < t.need:
                        break
                    out.append(self._tight([lo + q for q, _ in pairs], words))
                    for q in out[-1]:
                        words[q] = b""
        return out

    @staticmethod
    def _tight(at: list[int], words: list[bytes]) -> list[int]:
        """The same words, ending as early as they can from their start on, then starting as late as they can."""
        for k in range(1, len(at)):
            at[k] = next((q for q in range(at[k - 1] + 1, at[k]) if words[q] == words[at[k]]), at[k])
        for k in range(len(at) - 2, -1, -1):
            at[k] = next((q for q in range(at[k + 1] - 1, at[k], -1) if words[q] == words[at[k]]), at[k])
        return at

    @staticmethod
    def _densest(pairs: list, width: int) -> list:
        """The most pairs within so many words."""
        best, i = [], 0
        for j in range(len(pairs)):
            while pairs[j][0] - pairs[i][0] >= width:
                i += 1
            if j + 1 - i > len(best):
                best = pairs[i : j + 1]
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_licenses, license (the best covered, else null), coverage,
    matched, first_word, last_word, and all matches as found (license, template, coverage, matched,
    first_word, last_word), several of a license if it is there several times.

    A license is found when some stretch of at most twice a template's length covers `least` of
    its words in order, not counting words of larger matches. Templates are named license or
    license#template; n_licenses counts licenses. A null, empty or blank text has none. Of equally
    covered ones the longer match is the best, then the first by name. Rows are judged each by
    their text, so repeated ones get equal results and null ids stay null; an empty table gives an
    empty result, and further columns are ignored.
    """
    hit = "coverage double, matched int, first_word int, last_word int"
    schema = f"doc_id long, n_licenses int, license string, {hit}, found array<struct<license:string,template:string,{hit.replace(', ', ',').replace(' ', ':')}>>"
    kind = pa.struct([("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])
    flat = [f for f in kind if f.name != "template"]

    def scan(batches):
        scanner = Scanner(templates, least)
        for b in batches:
            found = [[dict(zip(kind.names, r, strict=True)) for r in scanner.scan(words_of(x.as_py()))] for x in b["data"]]
            best = [f[0] if f else {} for f in found]
            cols = [pa.array([x.get(f.name) for x in best], f.type) for f in flat]
            many = pa.array([len({x["license"] for x in f}) for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"], many, *cols, pa.array(found, pa.list_(kind))], ["doc_id", "n_licenses", *[f.name for f in flat], "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return materialise(rows.mapInArrow(scan, schema), "licenses")
