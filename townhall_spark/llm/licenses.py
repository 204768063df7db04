"""License scans by patience alignment.

Text and template are aligned on anchors, words that are unique to both; of these the
longest sequence in the same order is kept, and the gaps between its members are
aligned the same way. The share of the template's words that the alignment matches is
its coverage.

A text is aligned with a template if it holds enough of the template's words at all, in
any order: fewer cannot cover it. Where in the text is found the same way: a span is as
short as it can be and still hold enough of the words. So no place that the template
covers is missed for words that stand between its own, however many: the words of a
licence text may be spread over the whole text. Those of a notice of less than
``LONG`` words must stand within twice its length, and those of one of up to four words
next to each other, as any long text holds a few common words in some order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import WordHashes, values
from townhall_spark.llm.words import HashSet, words

# Public licence texts and the notices that stand for them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not '
     "use this file except in compliance with the License. You may obtain a copy of the License "
     "at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed "
     'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
     "for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     'software and associated documentation files (the "Software"), to deal in the Software '
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial "
     'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
     "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
     "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
     "with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: Redistributions "
     "of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or "
     "other materials provided with the distribution. Neither the name of the copyright holder "
     "nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
     "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
     "License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Usual wordings of the notices, and licences that differ from others by few words.
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: Redistributions "
     "of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright "
     "notice, this list of conditions and the following disclaimer in the documentation and/or "
     "other materials provided with the distribution."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under "
     "the terms of the GNU Lesser General Public License as published by the Free Software "
     "Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU Affero General Public License as published by the Free Software "
     "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and "
     "related or neighboring rights to this work."),
)
# Further public licence texts, and paragraphs that several of them share.
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
          "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
          "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
          "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
          "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
          "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
          "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
          "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
          "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GPL = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU {name} Public License for more details. You should have received a copy of the "
        "GNU {name} Public License along with this program.")
_TEXTS = dict(TEMPLATES)
TEMPLATES += (
    ("BSD-3-Clause", f"{_TEXTS['BSD-3-Clause']} {_AS_IS}"),
    ("BSD-2-Clause", f"{_TEXTS['BSD-2-Clause']} {_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
     "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event "
     "will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: The origin of this software must not be misrepresented; you must not claim that "
     "you wrote the original software. If you use this software in a product, an acknowledgment in "
     "the product documentation would be appreciated but is not required. Altered source versions "
     "must be plainly marked as such, and must not be misrepresented as being the original software. "
     "This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization "
     "obtaining a copy of the software and accompanying documentation covered by this license (the "
     "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
     "to prepare derivative works of the Software, and to permit third-parties to whom the Software "
     "is furnished to do so, all subject to the following: The copyright notices in the Software and "
     "this entire statement, including the above license grant, this restriction and the following "
     "disclaimer, must be included in all copies of the Software, in whole or in part, and all "
     "derivative works of the Software, unless such copies or derivative works are solely in the form "
     "of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is "
     "free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
     "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
     "by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
     "software dedicate any and all copyright interest in the software to the public domain."),
    ("GPL-3.0", _GPL.format(name="General")), ("LGPL-3.0", _GPL.format(name="Lesser General")),
    ("AGPL-3.0", _GPL.format(name="Affero General")),
)
# Identifiers of the public licence list, and the names that notices use.
IDENTIFIERS = ("0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0",
               "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
               "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0",
               "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
               "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
               "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "OFL-1.1",
               "Unlicense", "WTFPL", "Zlib")
NAMES = (("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License 2.0"),
         ("Apache-2.0", "Apache 2.0"), ("Apache-2.0", "Apache 2.0 License"),
         ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
         ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-2.0", "GNU General Public License v2.0"),
         ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-3.0", "GPLv3"), ("GPL-2.0", "GPLv2"),
         ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
         ("AGPL-3.0", "GNU Affero General Public License v3.0"), ("BSL-1.0", "Boost Software License 1.0"),
         ("Zlib", "zlib License"), ("EPL-2.0", "Eclipse Public License 2.0"))
TEMPLATES += tuple((of, f"SPDX-License-Identifier: {of}") for of in IDENTIFIERS)
TEMPLATES += tuple((of, f"{way} {article}{name}") for of, name in NAMES
                   for way in ("Licensed under", "Released under", "Distributed under")
                   for article in ("", "the "))
TEMPLATES += tuple((of, name) for of, name in NAMES if name.endswith("License") and len(name) > 16)
LEAST = 0.85
# Words from which a template is a licence text, whose words may stand any distance apart.
LONG = 40
# Words that turn a notice behind them into its opposite.
DENIALS = ("not", "never")
MATCHES = ("array<struct<license:string,template:int,coverage:double,start_word:bigint,"
           "end_word:bigint>>")


def longest_rising(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before[i] = ends[at - 1] if at else -1
        tails[at:at + 1] = [v]
        ends[at:at + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """Matched (text, template) places, rising in both, by patience alignment.

    A gap without anchors is matched from both of its ends as far as it agrees.
    """
    matched, work = [], [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if right[w] == 1 == left[w]}
        pairs = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where]
        anchors = [pairs[k] for k in longest_rising([p[1] for p in pairs])]
        if not anchors:
            continue
        matched.extend(anchors)
        for i, j in [*anchors, (b, d)]:
            work.append((a, i, c, j))
            a, c = i + 1, j + 1
    return sorted(matched)


class Match(NamedTuple):
    license: str
    template: int
    coverage: float
    start_word: int
    end_word: int


class Scanner:
    """The templates' words, and how often each template has each of them."""

    def __init__(self, templates: Sequence[tuple[str, str]], least: float = LEAST):
        seen = WordHashes()
        self.names = [name for name, _ in templates]
        self.words = [seen.of(words(t)).tolist() for _, t in templates]
        # No float may ask for a word more than the share does.
        self.need = np.array([max(1, math.ceil(least * len(own) - 1e-9)) for own in self.words])
        self.known = HashSet(np.array([w for own in self.words for w in own], np.uint64))
        self.times = np.zeros((len(templates), len(self.known.sorted)), np.int16)
        for n, own in enumerate(self.words):
            np.add.at(self.times[n], np.searchsorted(self.known.sorted, np.array(own, np.uint64)), 1)
        self.denials = set(seen.of([w.encode() for w in DENIALS]).tolist())

    def matches(self, hashes: np.ndarray) -> list[Match]:
        """All places of the text that cover a template, best first where they overlap."""
        at = self.known.where(hashes)
        if not len(at):
            return []
        which = np.searchsorted(self.known.sorted, hashes[at])
        present = np.unique(which)
        held = np.minimum(np.bincount(which, minlength=self.times.shape[1])[present], 1 << 14)
        enough = np.minimum(self.times[:, present], held).sum(axis=1) >= self.need
        found = []
        for n in np.flatnonzero(enough & (self.need > 0)).tolist():
            own = self.times[n][which] > 0
            found.extend(self._places(n, at[own].tolist(), hashes))
        # A longer template says more than a notice inside of it, and a whole one more than one
        # that lacks a paragraph.
        found.sort(key=lambda m: (-(m.coverage ** 2 * len(self.words[m.template])), m.template,
                                  m.start_word))
        kept: list[Match] = []
        for m in found:
            if all(m.end_word <= k.start_word or m.start_word >= k.end_word for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start_word)

    def _reach(self, n: int) -> int | None:
        """Words within which a template's must stand; of a licence text any number."""
        length = len(self.words[n])
        return None if length >= LONG else length if length <= 4 else 2 * length

    def _places(self, n: int, hits: list[int], hashes: np.ndarray) -> Iterator[Match]:
        """Aligns template ``n`` to the shortest spans that hold enough of its words.

        ``hits`` are the places of its words. A span ends at each hit in turn and starts
        as late as it can; what the span's neighbours may add, up to the template's
        length, is aligned with it. An alignment that lacks so many words cannot be
        complete before so many hits later.
        """
        template, need, reach = self.words[n], int(self.need[n]), self._reach(n)
        wanted, held = Counter(template), Counter()
        enough, left, skip, past = 0, 0, 0, 0
        for right, hit in enumerate(hits):
            word = int(hashes[hit])
            held[word] += 1
            enough += held[word] <= wanted[word]
            while left <= right:
                first = int(hashes[hits[left]])
                late = hits[left] < past or (reach is not None and hit - hits[left] >= reach)
                if not late and (enough < need or (
                        held[first] <= wanted[first] and enough == need)):
                    break
                enough -= held[first] <= wanted[first]
                held[first] -= 1
                left += 1
            skip -= 1
            if enough < need or skip > 0:
                continue
            low, high = hits[left], hit + 1
            room = len(template) if reach is None else max(0, reach - (high - low))
            low, high = max(past, low - room), min(len(hashes), high + room)
            matched = align(hashes[low:high].tolist(), template)
            coverage = len(matched) / len(template)
            start, end = (low + matched[0][0], low + matched[-1][0] + 1) if matched else (0, 0)
            if len(matched) >= need and (reach is None or end - start <= reach):
                past = end
                if reach is None or not start or int(hashes[start - 1]) not in self.denials:
                    yield Match(self.names[n], n, coverage, start, end)
            else:
                skip = max(1, need - len(matched))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, licenses, matches) per row: licenses, sorted, and every place of one.

    Texts are searched whole. A match is a place where at least ``least`` of a
    template's words align: of a licence text at any distances, of a notice of less than
    ``LONG`` words within twice its length, of one of up to four words side by side. A
    notice behind a denial is none. Of overlapping matches the one with most words counts, each
    by the share of its template, then the first template. Null and empty texts match nothing; repeated rows each
    give a row; an empty table gives an empty table; other columns are not read.
    Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    form = pa.struct([("license", pa.string()), ("template", pa.int32()),
                      ("coverage", pa.float64()), ("start_word", pa.int64()),
                      ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = Scanner(templates, least), WordHashes()
        for batch in batches:
            found = [scanner.matches(seen.of(words(t))) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([sorted({m.license for m in f}) for f in found], pa.list_(pa.string())),
                 pa.array([[m._asdict() for m in f] for f in found], pa.list_(form))],
                names=["key", "licenses", "matches"])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, licenses array<string>, matches {MATCHES}").withColumnRenamed("key", key)
