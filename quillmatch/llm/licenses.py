"""License scans by winnowed fingerprints and banded alignment.

Method: a text becomes its words (letters and digits in lower case). Hashes of ``GRAM`` consecutive words are winnowed (Schleimer, Wilkerson, Aiken,
2003): of every ``WINDOW`` consecutive hashes the least is kept. The templates' fingerprints form an inverted index; a text's fingerprints look it up, and hits of
one template on nearby diagonals become a candidate. Each candidate is aligned with the template, word by word, within a band of
diagonals around its hits; the alignment gives the matched share of the template, the span in the text, and the matched runs. What it leaves of the text on either
side is aligned again, so notices that stand close together give a row each.

Templates of at most ``SHORT`` words keep all of their hashes, and so does the text side for them: a text's hash also counts if it is in the
index of such short templates. So any run of ``GRAM + WINDOW - 1`` words in common with a template, and any ``GRAM`` words in common with a short one, is found.

The templates are a bounded list in the code of each worker (``TEMPLATES`` or the caller's; at most ``MOST_WORDS`` words together). Nothing is exchanged.

Cases: null text counts as empty (no rows); templates without words match nothing; several notices in one text give a row each; of
overlapping matches of one template the better counts, of different templates (texts of one family, or a notice that begins a longer text) the one with more matched words, where
they share half of the lesser's span; repeated rows give repeated results; empty tables give empty results; extra columns don't matter. A key with the name of a result column is called ``key``.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.rows import blocks, give_back
from quillmatch.llm.words import mix, utf8, words

GRAM, WINDOW, COVERAGE, BAND, MOST_WORDS, STEP = 3, 6, 0.75, 12, 500_000, 1 << 20
#: Templates of at most so many words keep all of their hashes.
SHORT = 16

# License texts and notices by name, as projects put them into their files: fixed values.
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission. "
)
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of "
    "the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": BSD_CONDITIONS + BSD_DISCLAIMER,
    "BSD-3-Clause": BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER,
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "GPL-2.0": GNU.format(work="program", name="General Public License", version="2"),
    "GPL-3.0": GNU.format(work="program", name="General Public License", version="3"),
    "LGPL-2.1": GNU.format(work="library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0": GNU.format(work="library", name="Lesser General Public License", version="3"),
    "AGPL-3.0": GNU.format(work="program", name="Affero General Public License", version="3"),
}
RESULT = "license string, coverage double, start long, `end` long, runs array<struct<start: long, `end`: long>>"


def grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``GRAM`` words that begin at each word, whether they are all of one text)."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(GRAM, np.uint64)])
    for k in range(GRAM):
        total = mix(total ^ padded[k : k + n]) + np.uint64(k)
    whole = np.ones(n, bool)
    for k in range(1, GRAM):
        at = first[1:] - k
        whole[at[at >= first[:-1]]] = False
    return total, whole


def winnowed(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Indices of the values that are the least of some ``WINDOW`` consecutive ones (the last of equals); windows over a text's end only add to them."""
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    v = np.where(whole, values, np.uint64(2**64 - 1))
    padded = np.concatenate([v, np.full(WINDOW, 2**64 - 1, np.uint64)])
    least, at = padded[:n].copy(), np.arange(n)
    for k in range(1, WINDOW):
        take = padded[k : k + n] <= least
        take &= np.arange(n) + k < n
        least = np.where(take, padded[k : k + n], least)
        at = np.where(take, np.arange(n) + k, at)
    chosen = np.zeros(n, bool)
    chosen[at] = True
    return np.flatnonzero(chosen & whole)


def aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Pairs (template word, text word) of a best alignment by matches, of those one with the shortest span, with text - template within ``band`` of ``shift``
    and text words from ``low`` to ``high``."""
    m, width = len(template), 2 * band + 1
    high = len(text) if high is None else high
    # cell (i, d): template words before i, text words before i + shift - band + d; matches, then the place of the first one: the later the better
    score = np.zeros((m + 1, width + 2), np.int64)
    one = 1 << 32
    for i in range(1, m + 1):
        j = np.arange(i - 1 + shift - band, i + shift + band)
        inside = (j >= low) & (j < high)
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i - 1]
        # along the diagonal, down (the text's word stays), then across (a running maximum)
        before = score[i - 1, 1 : width + 1]
        row = np.maximum(before + np.where(same, np.where(before > 0, one, one + j), 0), score[i - 1, 2 : width + 2])
        score[i, 1 : width + 1] = np.maximum.accumulate(row)
    last = score[m, 1 : width + 1]
    most = last >> 32
    if not most[-1]:
        return []
    # of the ends with the most matches that of the shortest span
    ends = np.flatnonzero(most == most[-1])
    pairs, i, d = [], m, 1 + int(ends[np.argmin(ends - (last[ends] & (one - 1)))])
    while i > 0 and d > 0:
        j = i - 1 + shift - band + d - 1
        s = score[i, d]
        if d > 1 and score[i, d - 1] == s:
            d -= 1
        elif score[i - 1, d + 1] == s and d < width:
            i, d = i - 1, d + 1
        else:
            if low <= j < high and text[j] == template[i - 1] and s > score[i - 1, d]:
                pairs.append((i - 1, j))
            i -= 1
    return pairs[::-1]


def notices(template: np.ndarray, text: np.ndarray, hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Alignments that reach ``COVERAGE`` and don't overlap, the best first. ``hits`` are (text - template, text word) of shared fingerprints. What an alignment leaves of
    a band's part of the text is aligned again, as long as it holds a hit."""
    hits = sorted(hits)
    shifts = np.array([s for s, _ in hits])
    cuts = [0, *(np.flatnonzero(np.diff(shifts) > BAND) + 1).tolist(), len(hits)]
    heap: list[tuple] = []
    taken: list[tuple[int, int]] = []  # ascending

    def add(shift, band, places, low, high):
        if high - low < COVERAGE * len(template) or bisect_left(places, low) >= bisect_right(places, high - GRAM):
            return
        pairs = aligned(template, text, shift, band, low, high)
        if pairs and len(pairs) >= COVERAGE * len(template):
            heapq.heappush(heap, (-len(pairs), pairs[-1][1] - pairs[0][1], pairs[0][1], shift, band, places, low, high, pairs))

    for b, e in zip(cuts, cuts[1:]):
        for lo in range(int(shifts[b]), int(shifts[e - 1]) + 1, 4 * BAND):  # long chains of shifts in bands that overlap
            hi = min(int(shifts[e - 1]), lo + 4 * BAND)
            shift, band = (lo + hi) // 2, (hi - lo) // 2 + BAND
            places = sorted(p for _, p in hits[b + int(np.searchsorted(shifts[b:e], lo)) : b + int(np.searchsorted(shifts[b:e], hi, "right"))])
            add(shift, band, places, max(0, shift - band), min(len(text), shift + band + len(template) + 1))
    found = []
    while heap:
        *_, shift, band, places, low, high, pairs = heapq.heappop(heap)
        a, z = pairs[0][1], pairs[-1][1] + 1
        k = bisect_left(taken, (a, z))
        over = next(((s, e) for s, e in taken[max(0, k - 1) : k + 1] if a < e and s < z), None)
        if over is None:
            taken.insert(k, (a, z))
            found.append(pairs)
            over = a, z
        add(shift, band, places, low, over[0])
        add(shift, band, places, over[1], high)
    return found


def strongest(found: list[tuple[int, float, int, int]]) -> list[int]:
    """The indices of the matches (words matched, coverage, start, end) that stay: one goes if half of its span lies in that of a better one that stays. Better is
    more words, then more coverage, then the earlier index. Matches of one template don't overlap, so few are open at a time."""
    rank = sorted(range(len(found)), key=lambda i: (-found[i][0], -found[i][1], i))
    order = {i: k for k, i in enumerate(rank)}
    rivals: list[list[int]] = [[] for _ in found]
    open_: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: found[i][2]):
        start, end = found[i][2:]
        open_ = [j for j in open_ if found[j][3] > start]
        for j in open_:
            best, worst = sorted((i, j), key=order.__getitem__)
            if 2 * (min(end, found[j][3]) - start) >= found[worst][3] - found[worst][2]:
                rivals[worst].append(best)
        open_.append(i)
    stays = [False] * len(found)
    for i in rank:
        stays[i] = not any(stays[j] for j in rivals[i])
    return [i for i, s in enumerate(stays) if s]


class Index:
    """Inverted index of template fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, texts = list(templates), list(templates.values())
        hashes, _, _, first = words(*utf8(pa.array(texts, pa.string())))
        if len(hashes) > MOST_WORDS:
            raise ValueError("too many templates")
        self.words = [hashes[a:b] for a, b in zip(first, first[1:])]
        value, whole = grams(hashes, first)
        keep = np.zeros(len(value), bool)
        keep[winnowed(value, whole)] = True
        short = np.repeat(np.diff(first) <= SHORT, np.diff(first))
        places = defaultdict(list)
        for i in np.flatnonzero((keep | short) & whole):
            t = int(np.searchsorted(first, i, "right")) - 1
            places[int(value[i])].append((t, int(i - first[t])))
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(k)] for k in self.keys]
        self.short = np.isin(self.keys, value[short & whole])
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[self.keys >> np.uint64(44)] = True

    def scan(self, column: pa.Array) -> list[tuple]:
        data, offsets = utf8(column)
        hashes, starts, ends, first = words(data, offsets)
        if not len(hashes) or not len(self.keys):
            return []
        value, whole = grams(hashes, first)
        near = np.flatnonzero(self.bloom[value >> np.uint64(44)] & whole)
        place = np.minimum(np.searchsorted(self.keys, value[near]), len(self.keys) - 1)
        ok = self.keys[place] == value[near]
        near, place = near[ok], place[ok]
        if not len(near):
            return []
        text = np.searchsorted(first, near, "right") - 1
        # winnow those texts only that have a hash of the index at all
        chosen = np.zeros(len(value), bool)
        for t in np.unique(text).tolist():
            a, b = int(first[t]), int(first[t + 1])
            chosen[a + winnowed(value[a:b], whole[a:b])] = True
        by = defaultdict(list)
        for i, p, t in zip(near.tolist(), place.tolist(), text.tolist()):
            if chosen[i] or self.short[p]:
                for k, j in self.places[p]:
                    by[t, k].append((i - first[t] - j, i - int(first[t])))
        found: dict[int, list] = defaultdict(list)
        for (t, k), hits in sorted(by.items()):
            template, own = self.words[k], hashes[first[t] : first[t + 1]]
            found[t] += [(k, pairs) for pairs in notices(template, own, [(int(shift), i) for shift, i in hits])]
        rows = []
        for t, matches in found.items():
            at = int(first[t])
            byte = lambda lo, hi: (int(starts[at + lo] - offsets[t]), int(ends[at + hi - 1] - offsets[t]))
            for x in strongest([(len(pairs), len(pairs) / len(self.words[k]), pairs[0][1], pairs[-1][1] + 1) for k, pairs in matches]):
                k, pairs = matches[x]
                runs: list[list[int]] = []
                for i, j in pairs:
                    if runs and runs[-1][1] == j and runs[-1][2] == i:
                        runs[-1][1:] = [j + 1, i + 1]
                    else:
                        runs.append([j, j + 1, i + 1])
                rows.append((t, self.names[k], len(pairs) / len(self.words[k]), *byte(pairs[0][1], pairs[-1][1] + 1), [dict(zip(("start", "end"), byte(a, z))) for a, z, _ in runs]))
        return rows


def find_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(key, license, coverage, start, end, runs): a row for each notice found; offsets in bytes of the lower-cased text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL(RESULT).fields])
    out = to_arrow_schema(schema)
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(chosen)
        for batch in batches:
            for block in blocks(batch, STEP):
                if got := index.scan(block.column(1)):
                    keys = block.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([g[j] for g in got], out.field(j).type) for j in range(1, 6)]], schema=out)
        give_back()

    found = docs.mapInArrow(run, schema)
    return found if key.lower() in {f.name for f in schema.fields} else found.withColumnRenamed("key", key)


def op4(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "start", "end", F.size("runs").cast("long").alias("n_runs"))
