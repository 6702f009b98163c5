"""Operator 2: licence passages by matching statistics on a generalised suffix automaton.

One automaton is built over the words of all licence templates. A text streams through it word by word; the
matching statistic at a word is the length of the longest run of words that ends there and stands in a template, and
the suffix links above the state reached hold the longest run of every other template. A template's own maximal runs of
at least ``least`` words, whether or not another template carries them on, are traced to where they stand in it, and
runs in rising template order are chained into spans, which tolerate changed names and dates between runs. A template
whose chain covers enough of it labels the text. Beside this, fixed short phrases label a text wherever their
words stand consecutively. Time and memory grow in proportion to a text.

Edge cases: a null or empty text has no words, no span, score 0; repeated and tied rows are judged alike, one
output row for each input row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that label a text wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Whole short licences, and opening, grant or notice passages and lines of common ones, with the label of each.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-whole": (
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-3-whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-whole": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense-whole": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law."
    ),
    "boost-whole": (
        "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Bytes that are no part of a word become blanks, A-Z become a-z; bytes of other characters stay.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """The smallest automaton of all word runs in several sequences, each state with the places it stands for."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self._grow(state, word)
                self.places[state].append((k, at))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):  # a suffix ends wherever the longer run ends
            if self.link[state] > 0:
                self.places[self.link[state]].extend(self.places[state])

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.step) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for exactly ``state``'s longest run and ``word``; made by a split if it is part of a larger one."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(dict(self.step[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _grow(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def runs(self, words: list[int], at: int, least: int) -> Iterator[tuple[int, int, int]]:
        """Maximal runs (end, length, state) in a stretch of known words that starts at word ``at`` of the text."""
        state = held = 0
        for k, word in enumerate(words):
            if word in self.step[state]:
                state, held = self.step[state][word], held + 1
                continue
            if held >= least:
                yield at + k, held, state
            while state > 0 and word not in self.step[state]:
                state = self.link[state]
                held = self.length[state]
            state, held = (self.step[state][word], held + 1) if word in self.step[state] else (0, 0)
        if held >= least:
            yield at + len(words), held, state

    def carriers(self, least: list[int]) -> list[list[tuple[int, int, int]]]:
        """For each state (template, length, state): of every template with a run of ``least[template]`` words among the
        suffixes of the state's longest run, that run's length (0: as long as what was matched) and state."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.step]
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            above = self.link[state]
            mine = {k for k, _ in self.places[state] if self.length[state] >= least[k]}
            found[state] = [(k, 0, state) for k in sorted(mine)] + [(k, n or self.length[above], s) for k, n, s in found[above] if k not in mine]
        return found

    def runs_by_template(self, words: list[int], at: int, least: list[int], carriers: list[list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, int]]:
        """(template, end, length, state) of every template's own maximal runs in a stretch that starts at word ``at``."""
        state = held = 0
        open_runs: dict[int, tuple[int, int]] = {}
        for k, word in enumerate(words):
            while state > 0 and word not in self.step[state]:
                state = self.link[state]
                held = self.length[state]
            state, held = (self.step[state][word], held + 1) if word in self.step[state] else (0, 0)
            if carriers[state] or open_runs:
                now = {t: (n or held, s) for t, n, s in carriers[state] if (n or held) >= least[t]}
                for t, (n, s) in open_runs.items():
                    if t not in now or now[t][0] != n + 1:
                        yield t, at + k, n, s
                open_runs = now
        for t, (n, s) in open_runs.items():
            yield t, at + len(words), n, s


class Scanner:
    """The automaton, word numbers and template lengths for a set of templates and phrases."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int, gap: int, cover: float):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.numbers = {w: k for k, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.automaton = Automaton([[self.numbers[w] for w in s] for s in sequences])
        self.phrases = [(words_of(phrase), label) for phrase, label in phrases]
        self.least, self.gap, self.cover = least, gap, cover
        self.least_of = [min(least, n) for n in self.sizes]
        self.shortest = min([least, *self.sizes])
        self.carriers = self.automaton.carriers(self.least_of)
        own: list[dict[int, list[int]]] = [{} for _ in self.automaton.places]
        for state, places in enumerate(self.automaton.places):
            for template, last in places:
                own[state].setdefault(template, []).append(last)
        self.lasts = own

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of every place where a phrase's words stand consecutively."""
        found = []
        for phrase, label in self.phrases:
            rarest = max(phrase, key=len)
            offset, at = phrase.index(rarest), -1
            try:
                while True:
                    at = words.index(rarest, at + 1)
                    start = at - offset
                    if start >= 0 and words[start : start + len(phrase)] == phrase:
                        found.append((start, start + len(phrase), label))
            except ValueError:
                continue
        return found

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(start, end, label, covered share of the template) of the best chain of each template that is covered enough."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        known = [k for k, w in enumerate(words) if w in self.numbers]
        at = 0
        while at < len(known):
            stop = at + 1
            while stop < len(known) and known[stop] == known[stop - 1] + 1:
                stop += 1
            if stop - at >= self.shortest:
                stretch = [self.numbers[words[k]] for k in known[at:stop]]
                for template, end, n, state in self.automaton.runs_by_template(stretch, known[at], self.least_of, self.carriers):
                    runs.setdefault(template, []).extend((end - n, last + 1 - n, n) for last in self.lasts[state][template])
            at = stop
        found = []
        for template, pieces in runs.items():
            found += self.chain(template, sorted(pieces))
        return sorted(found)

    def chain(self, template: int, pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, float]]:
        """Chains by one sweep in text order. A run carries on the oldest open chain that it lies behind in text and template,
        at most ``gap`` words on in the text, or else opens one; chains further behind are closed, so only those of the
        last ``gap`` words are ever looked at. Of closed chains that cover enough, those that begin within an
        earlier one are left out."""
        size, closed, going = self.sizes[template], [], []
        for s, p, m in pieces:
            if going and any(s - c[1] > self.gap for c in going):
                closed += [c for c in going if s - c[1] > self.gap]
                going = [c for c in going if s - c[1] <= self.gap]
            for c in going:  # start, end, place behind the end, words covered
                if s >= c[1] and p >= c[2] and p - c[2] <= size:
                    c[1:] = s + m, p + m, c[3] + m
                    break
            else:
                going.append([s, s + m, p + m, m])
        last = 0
        for start, end, _, covered in sorted(closed + going, key=lambda c: (c[0], -c[3])):
            if covered >= self.cover * size and start >= last:
                last = end
                yield start, end, self.labels[template], covered / size


@lru_cache(maxsize=4)
def scanner(*parameters) -> Scanner:
    return Scanner(*parameters)


RESULT = "doc_id long, n_words long, places array<struct<start:int,end:int,label:string>>, spans array<struct<start:int,end:int,label:string,covered:double>>"


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: int = 5, gap: int = 12, cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, phrase places and covered template spans (word positions, end exclusive) of each document."""
    parameters = (tuple((templates or TEMPLATES).items()), tuple((phrases or PHRASES).items()), least, gap, cover)
    struct_places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
    struct_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("covered", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*parameters)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append([dict(zip(("start", "end", "label"), x, strict=True)) for x in own.places(words)])
                spans.append([dict(zip(("start", "end", "label", "covered"), x, strict=True)) for x in own.spans(words)])
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, struct_places), pa.array(spans, struct_spans)], names=["doc_id", "n_words", "places", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, RESULT)


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: counts, first and last place, labels and a score, from the scan's places and spans."""
    marks = F.concat(F.transform("places", lambda p: p["start"]), F.transform("spans", lambda s: s["start"]))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"]))))
    at = F.transform("places", lambda p: p["start"])
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(score, F.when(F.size("places") > 0, 0.5).otherwise(0.0))).alias("score"),
        F.size(F.array_distinct(marks)).cast("long").alias("n_marks"), "spans",
    )
