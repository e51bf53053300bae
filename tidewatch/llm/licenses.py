"""License scans by patience alignment.

Words that are unique both in a text and in a license's template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same way; a gap without
anchors takes a longest rise over all equal words. The share of the template's words that are aligned is its
coverage. Texts are aligned in windows of bounded size, so that a second copy nearby hides nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import map_batches, table

COVERAGE = 0.8
#: Templates of fewer words are short statements, where each word tells: they are to be covered whole.
SHORT = 20

#: Names and wordings of public licenses, notices and short statements of them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "BSD statement": "Released under the BSD License.",
    "ISC statement": "Released under the ISC License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 statement": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 statement": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY statement": "Licensed under CC BY 4.0.",
    "CC-BY-NC statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND statement": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND statement": "Licensed under CC BY-NC-ND 4.0.",
    "CC0 statement": "Licensed under CC0 1.0.",
    "Reserved": "All rights reserved.",
}

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by their first, whose second rises: patience sorting."""
    tops, at, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile:
            back[i] = at[pile - 1]
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str], whole: bool = True) -> list[tuple[int, int]]:
    """Aligned places (text, template): equal ends, then anchors unique to both sides, then the gaps between.

    A gap that has no anchors gives a longest common subsequence if whole, else nothing.
    """
    out, open_ = [], [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        wanted: dict[str, int] = {}
        for j in range(c, d):
            wanted[template[j]] = -1 if template[j] in wanted else j
        seen: dict[str, int] = {}
        for i in range(a, b):
            if text[i] in wanted:
                seen[text[i]] = -1 if text[i] in seen else i
        anchors = increasing([(i, wanted[w]) for w, i in seen.items() if i >= 0 and wanted[w] >= 0])
        if not anchors:
            if whole:
                places: dict[str, list[int]] = {}
                for j in range(d - 1, c - 1, -1):
                    places.setdefault(template[j], []).append(j)
                out += increasing([(i, j) for i in range(a, b) for j in places.get(text[i], ())])
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if i + 1 < k and j + 1 < m:
                open_.append((i + 1, k, j + 1, m))
    return sorted(out)


def regions(text: list[str], vocabulary: set[str], size: int) -> list[tuple[int, int]]:
    """Stretches of the text where words of the template crowd: half of any size words, widened by size either way."""
    hits = [i for i, w in enumerate(text) if w in vocabulary]
    need, out = max(1, size // 2), []
    for k in range(len(hits) - need + 1):
        if hits[k + need - 1] - hits[k] < 2 * size:
            a, b = max(0, hits[k] - size), min(len(text), hits[k + need - 1] + size + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


def lcs_reach(text: list[str], template: list[str]) -> tuple[int, int]:
    """Length of a longest common subsequence, and the first place of the text behind which it is complete: one row of bits a word."""
    masks: dict[str, int] = {}
    for j, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << j
    full = row = (1 << len(template)) - 1
    best, place = 0, 0
    for i, w in enumerate(text):
        met = row & masks.get(w, 0)
        if met:
            row = (row + met | row - met) & full
            n = len(template) - row.bit_count()
            if n > best:
                best, place = n, i + 1
    return best, place


def windows(a: int, b: int, size: int) -> list[tuple[int, int]]:
    """Windows of a stretch, a quarter more than size long and twice as long as it, a quarter of size apart."""
    step = max(1, size // 4)
    return sorted({(i, min(i + n, b)) for n in (size + step, 2 * size) for i in range(a, max(a + 1, b - n + step), step)})


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.templates = [(name, w, Counter(w)) for name, t in templates.items() if (w := words(t))]
        self.least = {name: len(w) if len(w) < SHORT else coverage * len(w) for name, w, _ in self.templates}
        self.telling = {name: self.told(w) for name, w, _ in self.templates if len(w) >= SHORT}
        self.all = set().union(*(v for _, _, v in self.templates))

    def told(self, template: list[str]) -> list[set[int]]:
        """For each other template that would cover this one, the places of the words that it lacks."""
        out = []
        for _, other, _ in self.templates:
            same = {j for _, j in align(other, template)}
            if self.coverage * len(template) <= len(same) < len(template):
                out.append(set(range(len(template))) - same)
        return out

    def places(self, own: list[str], name: str, template: list[str], counts: Counter) -> list[list[tuple[int, int]]]:
        """Alignments that reach the coverage: of each stretch, and of its windows, in which all gaps are aligned.

        The coverage holds for the words that tell the template from similar ones, too.
        """
        out, size, least = [], len(template), self.least[name]
        for a, b in regions(own, set(counts), size):
            for i, j in [*([(a, b)] if size >= SHORT else []), *windows(a, b, size)]:
                part = own[i:j]
                held = Counter(w for w in part if w in counts)
                if sum(min(n, counts[w]) for w, n in held.items()) >= least:
                    pairs = align(part, template, whole=j - i <= 2 * size)
                    if len(pairs) >= least:
                        met = {y for _, y in pairs}
                        if all(len(met & t) >= self.coverage * len(t) for t in self.telling.get(name, ())):
                            out.append([(i + x, y) for x, y in pairs])
        if not out and size >= SHORT and (pairs := self.thin(own, template, counts, least)):
            met = {y for _, y in pairs}
            if all(len(met & t) >= self.coverage * len(t) for t in self.telling.get(name, ())):
                out.append(pairs)
        return out

    def thin(self, own: list[str], template: list[str], counts: Counter, least: float) -> list[tuple[int, int]]:
        """An alignment of a template whose words lie in order but nowhere crowd, however many foreign words lie between them.

        Looked for over the whole text where its words allow the coverage; of the longest ones the one that is complete first,
        from where it last can begin.
        """
        at = [i for i, w in enumerate(own) if w in counts]
        part = [own[i] for i in at]
        held = Counter(part)
        if sum(min(n, counts[w]) for w, n in held.items()) < least:
            return []
        n, end = lcs_reach(part, template)
        if n < least:
            return []
        _, back = lcs_reach(part[:end][::-1], template[::-1])
        start = end - back
        pairs = align(part[start:end], template)
        if len(pairs) < n:  # anchors that stand in another order in between
            places: dict[str, list[int]] = {}
            for j in range(len(template) - 1, -1, -1):
                places.setdefault(template[j], []).append(j)
            pairs = increasing([(i, j) for i in range(end - start) for j in places.get(part[start + i], ())])
        return [(at[start + i], j) for i, j in pairs]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first and one past the last word) for each template that is covered."""
        if not text:
            return []
        own = words(text)
        present = self.all.intersection(own)
        found = []
        for k, (name, template, counts) in enumerate(self.templates):
            # Each aligned word is one of the template's: fewer of its distinct words than this cannot cover it.
            repeats = len(template) - len(counts)
            if len(present & counts.keys()) + repeats >= self.least[name]:
                found += [(-len(p), -len(p) / len(template), p[-1][0] - p[0][0], p[0][0], k, p) for p in self.places(own, name, template, counts)]
        # Of alignments that share half of the words of the smaller one, only the best stays.
        out, taken = {}, []
        for n, share, span, start, k, pairs in sorted(found, key=lambda f: f[:5]):
            at = {i for i, _ in pairs}
            if all(2 * len(at & t) < len(at) for t in taken):
                taken.append(at)
                best = out.get(k)
                if best is None or (n, span, start) < best[0]:
                    out[k] = (n, span, start), (self.templates[k][0], -share, -n, start, start + span + 1)
        return [out[k][1] for k in sorted(out)]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(key, license, coverage, n_matched, first_word, end_word): licenses whose template a text covers.

    Words are compared in lower case without punctuation. A row is given for each text and template of which
    coverage of the words are aligned, and coverage of those that tell it from similar templates, or all words
    if it has fewer than SHORT. Words of the template may crowd, as in a copy, or, for templates of SHORT words and more, lie
    in order with any number of foreign words between them; statements of fewer words have to crowd, as their words are
    everybody's. Of templates that claim the same words, the one with most of them stays; where a template occurs several times, for the best of them, the
    shortest and then the first of equals. Null and empty texts give nothing, repeated rows give repeated results, null keys
    are kept. Other columns are not looked at. An empty table gives no rows.
    """
    chosen = templates or TEMPLATES

    def make():
        scanner = Scanner(chosen, coverage)

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            found = [(i, *f) for i, t in enumerate(batch.column(text)) for f in scanner.scan(t.as_py())]
            i, *rest = zip(*found, strict=True) if found else ((), (), (), (), (), ())
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(i, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=[key, "license", "coverage", "n_matched", "first_word", "end_word"])

        return each

    fields = [docs.schema[key], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("n_matched", "first_word", "end_word"))]
    return map_batches(docs.select(key, text), make, T.StructType(fields))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
