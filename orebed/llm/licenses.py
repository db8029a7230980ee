"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_of
from .shingles import WORD, _FACTORS, mixed, word_hashes

#: License notices, as published by their stewards. Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


#: What a matched word is worth in an alignment, against 1 for a change.
MATCH = 3
#: The license of a long notice whose telling words are others.
UNKNOWN = "unknown"
#: Templates of fewer words are short forms: all that names a license in them must be there.
SHORT = 20
#: Words of short forms that name no license. Fixed values.
GENERIC = {"a", "an", "and", "available", "distributed", "is", "licence", "license", "licensed", "of", "provided", "released", "terms", "the", "this", "under", "v", "version", "work", "0"}
#: A license's name: the capitalised words right before "License".
NAMED = re.compile(r"((?:[A-Z][\w.-]*\s+)+)Licen[sc]e\b")


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word grams."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h * _FACTORS[i % len(_FACTORS)] + words[i : len(words) - k + 1 + i])
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the last smallest hash in each window of grams: two texts that share window + k - 1 words share a place's hash."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    if window == 1:
        return np.arange(len(h))
    if window == 2:
        chosen = np.zeros(len(h), bool)
        later = h[1:] <= h[:-1]
        chosen[1:] |= later
        chosen[:-1] |= ~later
        return np.flatnonzero(chosen)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def fingerprint_of(length: int, min_coverage: float) -> tuple[int, int]:
    """(k, window): how a template of so many words must be winnowed.

    If at most a share of 1 - min_coverage of its words is changed or lost,
    the others stand in at most one run more than there are such words, so
    that one run has at least the mean length. A run of k + window - 1 words
    holds a fingerprint for certain.
    """
    changed = int((1 - min_coverage) * length + 1e-9)
    run = max(1, -(-(length - changed) // (changed + 1)))
    return (3, 2) if run >= 4 else (min(run, 3), 1)


def _at_least(n: int) -> int:
    """How many of n telling words must match: all of a few, four in five of more."""
    return n if n <= 5 else -(-4 * n // 5)


def telling_words(name: str, text: str, templates: Mapping[str, list[str]], min_coverage: float = 0.8) -> tuple[list[tuple[list[int], int]], list[int]]:
    """What in a template tells its license: groups (places of words, how many of them must match), and places whose next word must follow at once.

    In a short form every word but the generic ones tells, its numbers all of
    them. Elsewhere names before "License" tell, and where a template of
    another license has so much in common that its text would be reported:
    the words that it lacks or has others for, and places where it has more.
    """
    words, groups, joined = WORD.findall(text.lower()), [], set()
    if len(words) < SHORT:
        named = [i for i, w in enumerate(words) if w not in GENERIC]
        groups += [[i for i in named if not words[i].isdigit()], [i for i in named if words[i].isdigit()]]
        joined |= {i for i in named if i + 1 in named or words[i + 1 : i + 2] in (["license"], ["licence"])}
        return [(g, _at_least(len(g))) for g in groups if g], sorted(joined)
    starts = [m.start() for m in WORD.finditer(text)]
    for m in NAMED.finditer(text) if len(starts) == len(words) else ():
        run = [i for i in range(bisect.bisect_left(starts, m.start(1)), bisect.bisect_left(starts, m.end(1))) if words[i] not in GENERIC]
        groups.append(run)
        joined |= {i for i in run if i + 1 in run}
    have = Counter(words)
    for other, texts in templates.items():
        for rival in [WORD.findall(t.lower()) for t in texts if other != name]:
            if (have & Counter(rival)).total() < min_coverage * len(words):
                continue
            steps = SequenceMatcher(None, words, rival, autojunk=False).get_opcodes()
            if sum(b - a for kind, a, b, _, _ in steps if kind == "equal") >= min_coverage * len(words):
                groups.append([i for kind, a, b, _, _ in steps if kind in ("replace", "delete") for i in range(a, b)])
                joined |= {a - 1 for kind, a, _, _, _ in steps if kind == "insert" and 0 < a < len(words)}
    return [(g, _at_least(len(g))) for g in groups if g], sorted(joined)


class TemplateIndex:
    """An inverted index from winnowed fingerprints to (template, place in it), one for each kind of fingerprint."""

    def __init__(self, templates: Mapping[str, list[str]], min_coverage: float = 0.8):
        self.names, self.words, self.codes, self.telling = [], [], [], []
        posts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for name, texts in templates.items():
            for text in texts:
                w = word_hashes(text)
                if not len(w):
                    continue
                kind = fingerprint_of(len(w), min_coverage)
                h = grams(w, kind[0])
                posts.setdefault(kind, []).extend((int(h[p]), len(self.names), int(p)) for p in winnow(h, kind[1]))
                self.names.append(name)
                self.words.append(w)
                values, code = np.unique(w, return_inverse=True)
                self.codes.append((values, code, np.bincount(code)))
                self.telling.append(telling_words(name, text, templates, min_coverage))
        self.kinds = {}
        for kind, rows in posts.items():
            rows.sort()
            self.kinds[kind] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, shift, place): where a template may begin in the text, and the place of the fingerprint that says so; a cut template may begin before the text."""
        found = set()
        for (k, window), (hashes, template, place) in self.kinds.items():
            h = grams(words, k)
            at = winnow(h, window)
            lo = np.searchsorted(hashes, h[at], "left")
            known = hashes[np.minimum(lo, len(hashes) - 1)] == h[at]
            at, lo = at[known], lo[known]
            hi = np.searchsorted(hashes, h[at], "right")
            for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                found.update((int(template[i]), p - int(place[i]), p) for i in range(a, b))
        return sorted(found)

    def told(self, template: int, places: np.ndarray, same: np.ndarray) -> bool:
        """Whether an alignment has the words that tell the template's license, without others between them."""
        groups, joined = self.telling[template]
        return all(same[g].sum() >= need for g, need in groups) and all(places[i] >= 0 and places[i + 1] == places[i] + 1 for i in joined)

    def coded(self, template: int, words: np.ndarray) -> np.ndarray:
        """The text's words as the template's codes, -1 for others."""
        values = self.codes[template][0]
        at = np.minimum(np.searchsorted(values, words), len(values) - 1)
        return np.where(values[at] == words, at, -1)


def align(code: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int, np.ndarray, np.ndarray] | None:
    """(score, matched words, first, last + 1 in the text, places, same) of the best alignment within `band` words of the diagonal `shift`.

    places are the text's words that stand for the template's, -1 for lost ones; same tells which of them match.

    Local in the text, with MATCH for a match and -1 for a change, a lack or
    an insertion, so that a matched word carries over some changed ones. Row i of the table is template word i; cell j of a row is text
    word shift + i + j - band.
    """
    m, width = len(code), 2 * band + 1
    padded = np.full(m + width, -1, np.int64)
    lo = shift - band
    a, b = max(lo, 0), min(lo + m + width, len(text))
    if a >= b:
        return None
    padded[a - lo : b - lo] = text[a:b]
    score = np.zeros((m + 1, width + 2), np.int32)
    steps = np.arange(width, dtype=np.int32)
    for i in range(m):
        hit = np.where(padded[i : i + width] == code[i], MATCH, -1)
        prev = score[i]
        row = np.maximum(np.maximum(prev[1:-1] + hit, prev[2:] - 1), 0)
        # Words inserted in the text run along the row: a running maximum of score + place.
        row = np.maximum.accumulate(row + steps) - steps
        score[i + 1, 1:-1] = row
    i, j = np.unravel_index(int(score[:, 1:-1].argmax()), (m + 1, width))
    top = int(score[i, j + 1])
    if top <= 0:
        return None
    matched, first, last = 0, 0, int(lo + i - 1 + j) + 1
    places, matches = np.full(m, -1), np.zeros(m, bool)
    while i > 0 and score[i, j + 1] > 0:
        s = score[i, j + 1]
        same = padded[i - 1 + j] == code[i - 1]
        if s == score[i - 1, j + 1] + (MATCH if same else -1):
            matched += int(same)
            first = int(lo + i - 1 + j)
            i -= 1
            places[i], matches[i] = first, same
        elif j + 1 < width and s == score[i - 1, j + 2] - 1:
            i, j = i - 1, j + 1
        elif j > 0 and s == score[i, j] - 1:
            j -= 1
        else:
            break
    return top, matched, first, last, places, matches


def mentions(index: TemplateIndex, template: int, words: np.ndarray, places: list[tuple[int, int]], min_coverage: float, band: int) -> list[tuple[int, int, int, int, bool]]:
    """(score, matched, first, last + 1, told) of all mentions of one template, from its candidates (shift, place) in order; told: with the words that tell its license.

    Around each fingerprint the best alignment is taken, its words are
    masked, and the rest is aligned again until nothing is left that reaches
    min_coverage: mentions may stand next to each other. A fingerprint within
    a mention already found asks for nothing new, and a band that does not
    hold enough of the template's words is not aligned.
    """
    _, code, have = index.codes[template]
    text = index.coded(template, words)
    m, band = len(code), min(band, len(code))
    need = max(1, int(np.ceil(min_coverage * m - 1e-9)))
    out, tried = [], set()
    for shift, place in places:
        while text[place] >= 0 and shift not in tried:
            window = text[max(shift - band, 0) : shift + m + band + 1]
            if np.minimum(np.bincount(window[window >= 0], minlength=len(have)), have).sum() < need:
                break
            got = align(code, text, shift, band)
            if got is None or got[1] < need:
                tried.add(shift)
                break
            out.append((*got[:4], index.told(template, got[4], got[5])))
            text[got[2] : got[3]] = -1
            tried.clear()
    return out


def find_licenses(text: str, index: TemplateIndex, min_coverage: float, band: int) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and last + 1 character) of each mention, in the order of the text."""
    words = word_hashes(text)
    wanted: dict[int, list[tuple[int, int]]] = {}
    for template, shift, place in index.candidates(words):
        wanted.setdefault(template, []).append((shift, place))
    best = []
    for template, places in wanted.items():
        for score, matched, first, last, told in mentions(index, template, words, places, min_coverage, band):
            if told or len(index.words[template]) >= SHORT:
                best.append((not told, -score, -matched / len(index.words[template]), first, last, index.names[template] if told else UNKNOWN, matched))
    if not best:
        return []
    # lower() may change the number of characters: spans are taken from the text itself where it does not.
    spans = [m.span() for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else text)]
    out: list[tuple[str, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for _, _, coverage, first, last, name, matched in sorted(best):
        i = bisect.bisect_left(taken, (first, last))
        if (i and taken[i - 1][1] > first) or (i < len(taken) and taken[i][0] < last):
            continue
        taken.insert(i, (first, last))
        out.append((name, round(-coverage, 6), matched, spans[min(first, len(spans) - 1)][0], spans[min(last, len(spans)) - 1][1]))
    return sorted(out, key=lambda o: (o[3], o[4], o[0]))


def read_templates(folder: str) -> dict[str, list[str]]:
    """Whole license texts as templates, one for each file of a folder on the driver, named by the file without its suffix."""
    return {p.stem if p.suffix == ".txt" else p.name: [p.read_text(encoding="utf-8", errors="replace")] for p in sorted(Path(folder).iterdir()) if p.is_file()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, min_coverage: float = 0.8, band: int = 16) -> DataFrame:
    """A row for each mention of a license: id, license, coverage, matched_words, span_start, span_end.

    coverage is the share of the template's words that the alignment matches;
    the span is in characters of the text, from the first matched word to the
    last. Words that tell a license from others must match and stand together:
    a short form with another name, number or an addition to the name has no
    row, and a whole notice with others is of license "unknown". All mentions count, however near to each other they stand. Of
    overlapping ones a known one counts before an unknown one, then the one with the highest alignment score (matches less
    changes), then the one with the highest coverage, the first, and
    the least name. A template that is changed within min_coverage shares a
    fingerprint with the text for certain unless words were put in between as
    well; insertions, losses and changes up to `band` words are bridged. Null
    and empty texts have no rows; repeated rows repeat their mentions; an
    empty table gives no rows; other columns are ignored.

    The templates and their index go to all workers: they are a parameter,
    not data, and do not grow with the input. Each text is scanned alone.
    """
    ship(docs.sparkSession)
    index = TemplateIndex({name: list(texts) for name, texts in templates.items()}, min_coverage)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in slices(batches):
            rows_of, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in find_licenses(text, index, min_coverage, band):
                    rows_of.append(i)
                    found.append(hit)
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_of, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "license", "coverage", "matched_words", "span_start", "span_end"])

    out = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, matched_words int, span_start int, span_end int")
    return out.withColumnRenamed("id", id_col)
