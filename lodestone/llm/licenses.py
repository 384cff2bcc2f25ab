"""License scan: winnowed fingerprints of templates in an inverted index, then banded sequence alignment.

Templates are cut into words and 3-word grams; of each window of grams the smallest hash is a fingerprint (winnowing),
kept in an inverted index with its places. A document's grams are looked up, all of them, so a shared run of five words
cannot be missed. Hits that lie on near diagonals are one candidate; a banded alignment of template and text then tells
the matched words, their share of the template and the span in the text.

The index holds the templates only, so its size doesn't depend on the corpus.

Of overlapping matches the one with the most matched words, less its edits, is reported: a notice isn't counted for a
similar license too.

Defined cases: null and empty texts have no matches; ties go to the earlier start, then the license's name; repeated
rows are scanned each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
_WORD = re.compile(r"[A-Za-z0-9]+")

#: Wording of public licenses' paragraphs that stand in several notices.
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Wording of public licenses' notices, by identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        MIT_WARRANTY,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        BSD_CONDITIONS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", BSD_CONDITIONS + " " + BSD_DISCLAIMER],
    "LGPL-3.0": [
        "SPDX-License-Identifier: LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["SPDX-License-Identifier: ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def align(template: list[int], text: list[int], *, band: int, offset: int) -> tuple[int, int, int, int]:
    """(matched, first, last, edits) of the best alignment of a whole template with a part of `text`, within `band` of the
    diagonal text place = template place + offset. Words match or not; gaps and mismatches cost one each."""
    m, n, far = len(template), len(text), 10**9
    width = 2 * band + 1
    # cost[j] for text place i + offset - band + j after i template words; each with (matched, first text word)
    cost = [(0, 0, i) for i in range(offset - band, offset + band + 1)]  # the text before the match is free
    for i in range(1, m + 1):
        now = []
        for j in range(width):
            place = i + offset - band + j  # words of the text used
            best = (far, 0, place)
            if 0 <= place <= n:
                if place >= 1 and cost[j][0] < far:
                    same = template[i - 1] == text[place - 1] and template[i - 1] > 0
                    c, k, a = cost[j]
                    best = min(best, (c + (not same), k - same, a))
                if j + 1 < width and cost[j + 1][0] < far:
                    c, k, a = cost[j + 1]
                    best = min(best, (c + 1, k, a))
                if j and now[j - 1][0] < far:
                    c, k, a = now[j - 1]
                    best = min(best, (c + 1, k, a))
            now.append(best)
        cost = now
    j = min(range(width), key=lambda x: (cost[x][0], cost[x][1], abs(x - band)))
    c, k, a = cost[j]
    return -k, max(a, 0), min(m + offset - band + j, n), c


class Index:
    """Inverted index of templates' winnowed grams, and the templates as word numbers."""

    def __init__(self, templates: dict[str, list[str]], *, gram: int = GRAM, window: int = WINDOW):
        self.gram = gram
        self.number: dict[str, int] = {}
        self.templates: list[tuple[str, int, list[int]]] = []
        for name, texts in templates.items():
            for i, text in enumerate(texts):
                self.templates.append((name, i, [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]))
        self.base = len(self.number) + 1
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, _, ids) in enumerate(self.templates):
            hashes = self.grams(np.array(ids)).tolist()
            mixed = [(h * 0x9E3779B97F4A7C15) % 2**64 for h in hashes]
            for a in range(max(len(mixed) - window + 1, 1)):
                part = mixed[a : a + window]
                if part:
                    i = a + max(x for x in range(len(part)) if part[x] == min(part))
                    if (t, i) not in places[hashes[i]]:
                        places[hashes[i]].append((t, i))
        self.places = dict(places)
        self.keys = np.array(sorted(self.places), dtype=np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A number for each gram of word numbers; 0 where a word is no template's."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.empty(0, np.int64)
        h, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(self.gram):
            h = h * self.base + ids[i : n + i]
            known &= ids[i : n + i] > 0
        return np.where(known, h, 0)

    def matches(self, text: str, *, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, int, int, float]]:
        """(license, template, start, end, matched, words of the template, coverage) in order of start; spans in code points."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        h = self.grams(ids)
        at = np.searchsorted(self.keys, h)
        hits = np.flatnonzero((h > 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h))
        if not len(hits):
            return []
        diagonals: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for p in hits.tolist():
            for t, i in self.places[int(h[p])]:
                diagonals[t][p - i].append(p)
        spans = [m.span() for m in _WORD.finditer(text)]
        listed, out = ids.tolist(), set()
        for t, offsets in diagonals.items():
            name, nth, template = self.templates[t]
            last, a, b = None, 0, 0
            for offset in sorted(offsets):
                hit = offsets[offset]
                if last is not None and offset - last <= band // 2 and a <= hit[0] and hit[-1] < b:
                    continue  # the band around the one before holds this diagonal, and its match these hits
                last = offset
                m = len(template)
                if offset >= 0 and listed[offset : offset + m] == template:
                    matched, a, b, edits = m, offset, offset + m, 0
                else:
                    from_ = max(offset - band, 0)
                    part = listed[from_ : offset + m + band]
                    matched, a, b, edits = align(template, part, band=band, offset=offset - from_)
                    a, b = a + from_, b + from_
                    while a < b and listed[a] != template[0] and listed[a] not in template:
                        a += 1
                    while b > a and listed[b - 1] not in template:
                        b -= 1
                if matched >= coverage * m and b > a:
                    out.add((edits - matched, spans[a][0], name, nth, spans[b - 1][1], matched, m))
        kept: list[tuple[int, int]] = []  # spans so far, sorted, apart from each other
        best = []
        for _, start, name, nth, end, matched, m in sorted(out):
            i = bisect_right(kept, (start, end))
            if (i and kept[i - 1][1] > start) or (i < len(kept) and kept[i][0] < end):
                continue
            kept.insert(i, (start, end))
            best.append((name, nth, start, end, matched, m, matched / m))
        return sorted(best, key=lambda x: x[2])


_SCHEMA = "doc_id long, license string, template int, start long, end long, matched_words int, template_words int, coverage double"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, band: int = BAND, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, start, end, matched_words, template_words, coverage: a row for each match in each whole text."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    rows += [(doc, *m) for m in index.matches(text, band=band, coverage=coverage)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
