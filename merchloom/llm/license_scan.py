"""Operator 10: license texts by patience alignment.

Words that occur once in a template and once in a part of the text are anchors; the longest increasing run of them is
kept, and the gaps between are aligned in the same way. The share of the template's words that are aligned is its
coverage, and it must be as large a share of the words that the alignment spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

# Notices, opening texts and whole texts of public licenses, as their publishers word them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "All-Rights-Reserved": ("All rights reserved.",),
}
LEAST_COVERAGE = 0.9
_WORD = re.compile(r"[^\W_]+")


class Template(NamedTuple):
    license: str
    words: tuple[str, ...]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, ascending by the first, that ascends by the second too: patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(template: list[str] | tuple[str, ...], text: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in the template, in the text): equal ends, then anchors, then the gaps in the same way."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = Counter(template[a:b])
        there = {w: i for i, w in enumerate(template[a:b], a) if once[w] == 1}
        count: Counter[str] = Counter(w for w in text[c:d] if w in there)
        anchors = sorted((there[w], i) for i, w in enumerate(text[c:d], c) if w in there and count[w] == 1)
        chain = _increasing(anchors)
        if not chain:
            continue
        out.extend(chain)
        for (x, y), (u, v) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def _common(template: tuple[str, ...], text: list[str]) -> int:
    """Length of the longest common subsequence, by one integer whose bits are the template's places."""
    full = (1 << len(template)) - 1
    at: dict[str, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    free = full
    for w in text:
        met = free & at.get(w, 0)
        free = ((free + met) | (free - met)) & full
    return len(template) - free.bit_count()


class Limits(NamedTuple):
    """Least share, and what a stretch must have of a template of n words: words, words at most, pairs of neighbours."""

    least: float
    enough: int
    most: int
    pairs: int


def limits(n: int, least: float) -> Limits:
    enough, most = math.ceil(least * n - 1e-9), int(n / least + 1e-9)
    return Limits(least, enough, most, 3 * enough - n - 1 - most)


class Scanner:
    """Templates, and bounds by which the parts of a text that cannot hold one are passed over; no bound loses a place.

    A stretch passes if `least` of the template's words are aligned with it, and these are `least` of its words up to
    the last. So it has at most n / least words, shares enough words with the template, shares enough neighbours (each
    word left out on either side parts at most two of them), and has a long enough common subsequence.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.templates = [Template(name, tuple(words_of(t))) for name, texts in templates.items() for t in texts if words_of(t)]
        self.needs = [Counter(t.words) for t in self.templates]
        self.by_pair: dict[tuple[str, str], list[int]] = {}
        for k, t in enumerate(self.templates):
            for pair in set(pairwise(t.words)):
                self.by_pair.setdefault(pair, []).append(k)

    def best(self, text: str, least: float) -> tuple[str | None, float, int, int, int, list[str]]:
        """Best license, its coverage, aligned words, first and last place in the text's words; all licenses found."""
        if not text:
            return None, 0.0, 0, -1, -1, []
        words = words_of(text)
        spots: list[list[int]] = [[] for _ in self.templates]
        for i, pair in enumerate(pairwise(words)):
            for k in self.by_pair.get(pair, ()):
                spots[k].append(i)
        top: tuple[float, int, str | None, int, int] = (0.0, 0, None, -1, -1)
        found: set[str] = set()
        for k, template in enumerate(self.templates):
            best: list[tuple[int, int]] = []
            limit = limits(len(template.words), least)
            for start, end in self._parts(limit, spots[k], len(words)):
                best = self._aligned(k, limit, words, start, end, best)
            if best:
                found.add(template.license)
                rank = (len(best) / len(template.words), len(best))
                if rank > top[:2]:
                    top = (*rank, template.license, best[0][1], best[-1][1])
        coverage, matched, name, first, last = top
        return name, coverage, matched, first, last, sorted(found)

    @staticmethod
    def _parts(limit: Limits, spots: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Parts of the text that together hold every stretch with enough of the template's neighbours."""
        need, most = limit.pairs, limit.most
        if need < 1:
            yield 0, size
            return
        start = end = -1
        for first, last in zip(spots, spots[need - 1 :], strict=False):
            if last + 2 - first > most:
                continue
            lo, hi = max(0, last + 2 - most), min(size, first + most)
            if lo > end >= 0:
                yield start, end
                start = lo
            start, end = (lo if start < 0 else start), hi
        if end >= 0:
            yield start, end

    def _aligned(self, k: int, limit: Limits, words: list[str], start: int, end: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest alignment of a stretch of words[start:end], if longer than `best`.

        A stretch begins and ends with a word of the template. Its last words are taken by the words that any stretch
        up to them shares with the template, the fullest first, until none can have more aligned than the best.
        """
        template, need, enough = self.templates[k].words, self.needs[k], limit.enough
        own = [i for i in range(start, end) if words[i] in need]
        ends = self._ends(need, limit, words, own)
        # a common subsequence of all that a run of ends reaches bounds that of each
        bound: dict[int, int] = {}
        runs = max(1, len(template) // 4)
        for _, run in groupby(ends, lambda x: own[x[1]] // runs):
            some = list(run)
            common = _common(template, words[own[some[0][2]] : own[some[-1][1]] + 1])
            bound |= {at: common for _, at, _ in some}
        known: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for total, at, left in sorted(ends, key=lambda x: (-x[0], x[1])):
            if total <= len(best):
                break
            if bound[at] < max(enough, len(best) + 1):
                continue
            for lo, hi in self._stretches(need, limit, words, own[left : at + 1], total, len(best)):
                part = tuple(words[lo:hi])
                if part not in known:
                    known[part] = align(template, words[lo:hi])
                pairs = known[part]
                if len(pairs) >= max(enough, len(best) + 1) and len(pairs) >= limit.least * (pairs[-1][1] - pairs[0][1] + 1):
                    best = [(a, lo + b) for a, b in pairs]
        return best

    @staticmethod
    def _ends(need: Counter[str], limit: Limits, words: list[str], own: list[int]) -> list[tuple[int, int, int]]:
        """Template words of the longest stretch up to a word, that word's place in `own`, and the stretch's first one."""
        out = []
        have: Counter[str] = Counter()
        total = left = 0
        for at, i in enumerate(own):
            total += have[words[i]] < need[words[i]]
            have[words[i]] += 1
            while own[left] <= i - limit.most:
                v = words[own[left]]
                have[v] -= 1
                total -= have[v] < need[v]
                left += 1
            if total >= limit.enough:
                out.append((total, at, left))
        return out

    @staticmethod
    def _stretches(need: Counter[str], limit: Limits, words: list[str], own: list[int], total: int, beat: int) -> list[tuple[int, int]]:
        """Starts and ends of the stretches up to own[-1] that share more than `beat` words, the fullest first, of these the shortest."""
        end = own[-1] + 1
        have = Counter(words[i] for i in own)
        out = []
        for i in own:
            if total < max(limit.enough, beat + 1):
                break
            if total >= limit.least * (end - i):
                out.append((-total, end - i))
            have[words[i]] -= 1
            total -= have[words[i]] < need[words[i]]
        return [(end - size, end) for _, size in sorted(out)]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, license, coverage, n_aligned, first_word, last_word, licenses (all found, sorted).

    license is null, coverage 0 and the places -1 where no template reaches `least`; ties go to the template with more
    words aligned, then to the first. Null and empty texts have none. Texts are scanned whole, rows one by one; other
    columns are ignored, whatever their names.
    """
    arrow_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        for b in batches:
            out = [scanner.best(t.as_py() or "", least) for t in b.column(1)]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "license", "coverage", "n_aligned", "first_word", "last_word", "licenses"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, license string, coverage double, n_aligned long, first_word long, last_word long, licenses array<string>")
    return out.withColumnRenamed("id", id_col)
