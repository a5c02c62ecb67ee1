"""5. Licence scans with a generalised suffix automaton.

The automaton holds all substrings of all licence templates, as tokens. A file's tokens stream through it and
give matching statistics: at each place the longest match that ends there. Matches of ``MIN_MATCH``
tokens or more that cannot be longer are chained, for each template, in the order of both text and template; a
chain gives its covered spans and the share of the template that they cover. Of chains that share text the greater counts, and what they
leave is chained again, so a notice that stands twice is found twice. A chain gives its label if it covers ``MIN_COVER`` of the template, or all of a
short one, since short notices differ by a word.
The automaton is of fixed size and is built once in each worker; there is no shuffle.

Defined results: null text is empty; a text without words has null places, no label and score 0; very long texts are scanned whole, in time that grows with their length;
among equal chains the earlier one counts; repeated rows give a row each; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _shared as S

MIN_MATCH = 4
#: Tokens that may stand between two matches of a chain.
MAX_GAP = 40
#: Share of a template that a chain must cover for its label.
MIN_COVER = 0.6

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Tokens of a template that counts as short.
SHORT = 16

# Texts and notices of public licences, and three short lines as the supplied documents have them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "released under the MIT license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "licensed under the Apache license, version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "this work is licensed under the GNU general public license, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]
# The elements of Creative Commons licences, by their codes and names.
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
TEMPLATES += [(f"cc-{code.lower()}", text) for code, name in CC.items() for text in (f"licensed under CC {code} 4.0", f"licensed under a Creative Commons {name} 4.0 International License", f"licensed under the Creative Commons {name} 4.0 International License")]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Runs of digits, lower-cased letters and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Match(NamedTuple):
    start: int  # in the text
    length: int
    at: int  # in the template


class Chain(NamedTuple):
    template: int
    cover: float
    spans: list[tuple[int, int]]  # of text tokens, end exclusive


class Automaton:
    """Generalised suffix automaton; states hold, for each template, the end of an occurrence."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [{}]
        for t, words in enumerate(templates):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, end)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            for t, end in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, end)

    def _state(self, length: int, like: int | None = None) -> int:
        self.len.append(length)
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.ends.append({})
        return len(self.len) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for w after p, of its own length."""
        if self.len[q] == self.len[p] + 1:
            return q
        short = self._state(self.len[p] + 1, like=q)
        self.link[q] = short
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w, self.next[p][w])
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """For each place the state and the length of the longest match that ends there."""
        s = n = 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            yield s, n


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.labels = [label for label, _ in templates]
        cut = [tokens(text) for _, text in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.number = {w: k for k, w in enumerate(dict.fromkeys([w for x in [*cut, *(p for p, _ in self.phrases)] for w in x]), 1)}
        self.sizes = [len(x) for x in cut]
        self.automaton = Automaton([[self.number[w] for w in x] for x in cut])
        self.min_match, self.max_gap, self.min_cover = min(min_match, *self.sizes), max_gap, min_cover
        #: Tokens that a chain has to cover for its label.
        self.least = [n if n < SHORT else self.min_cover * n for n in self.sizes]
        self.begins = np.zeros(len(self.number) + 1, bool)
        for p, _ in self.phrases:
            self.begins[self.number[p[0]]] = True

    def phrase_places(self, ids: np.ndarray) -> list[tuple[int, int, str]]:
        """Start, end and label of each phrase."""
        out = []
        for at in np.flatnonzero(self.begins[ids]).tolist():
            for words, label in self.phrases:
                if ids[at : at + len(words)].tolist() == [self.number[w] for w in words]:
                    out.append((at, at + len(words), label))
        return out

    def matches(self, ids: np.ndarray) -> dict[int, list[Match]]:
        """For each template the matches that nothing extends, in the order of the text."""
        found: dict[int, list[Match]] = {}
        edges = np.flatnonzero(np.diff(np.r_[False, ids > 0, False]))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start < self.min_match:
                continue
            before = (0, 0)
            for k, now in enumerate([*self.automaton.statistics(ids[start:stop].tolist()), (0, 0)]):
                s, n = before
                if n >= self.min_match and now[1] <= n:
                    for t, end in self.automaton.ends[s].items():
                        found.setdefault(t, []).append(Match(start + k - n, n, end - n))
                before = now
        return found

    def chains(self, template: int, matches: list[Match]) -> list[Chain]:
        """Chains that share no text, greatest first, among equals the earlier; what they leave is chained again until no match is left that covers enough."""
        found: list[Chain] = []
        while matches:
            taken: list[tuple[int, int]] = []
            best, back = self._scores(matches)
            for k in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
                if found and best[k] < self.least[template]:
                    break
                path = []
                at = k
                while at >= 0:
                    path.append(matches[at])
                    at = back[at]
                start, stop = path[-1].start, path[0].start + path[0].length
                place = bisect.bisect_left(taken, (stop, 0))
                if place and taken[place - 1][1] > start:
                    continue
                taken.insert(place, (start, stop))
                found.append(Chain(template, min(1.0, best[k] / self.sizes[template]), [(m.start, m.start + m.length) for m in reversed(path)]))
            if max(best) < self.least[template]:
                break
            begins = np.array([a for a, _ in taken])
            ends = np.array([b for _, b in taken])
            free = lambda m: (k := int(np.searchsorted(ends, m.start, "right"))) == len(ends) or begins[k] >= m.start + m.length
            matches = [m for m in matches if free(m)]
        return found

    def _scores(self, matches: list[Match]) -> tuple[list[int], list[int]]:
        """The most tokens that a chain which ends with each match covers, and the match before. It looks back over matches within the gap only, so a file of many notices costs in proportion."""
        best: list[int] = []
        back: list[int] = []
        low = 0
        for k, m in enumerate(matches):
            while matches[low].start + matches[low].length + self.max_gap < m.start:
                low += 1
            score, via = m.length, -1
            for j in range(low, k):
                p = matches[j]
                if p.at >= m.at:
                    continue
                over = max(0, p.start + p.length - m.start, p.at + p.length - m.at)
                if over < m.length and best[j] + m.length - over > score:
                    score, via = best[j] + m.length - over, j
            best.append(score)
            back.append(via)
        return best, back

    def scan(self, text: str) -> dict:
        words = tokens(text)
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        base = self.phrase_places(ids) if len(ids) else []
        chains = [c for t, m in self.matches(ids).items() for c in self.chains(t, m)] if len(ids) else []
        held = sorted((c for c in chains if c.cover * self.sizes[c.template] >= self.least[c.template]), key=lambda c: (c.spans, c.template))
        own = {label for _, _, label in base}
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min((a for a, _, _ in base), default=None), "last_word": max((a for a, _, _ in base), default=None),
            "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {self.labels[c.template] for c in held})), "score": max((c.cover for c in chains), default=0.0),
            "spans": [{"label": self.labels[c.template], "start": a, "stop": b, "cover": c.cover} for c in held for a, b in c.spans],
        }


_SCANNERS: dict[int, Scanner] = {}
COLUMNS = "doc_id bigint, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, stop: int, cover: double>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS, a row for each row of df; spans are the covered template spans, in words of the text."""
    S.ship(df.sparkSession)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("cover", pa.float64())]))
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.setdefault(0, Scanner()) if not _SCANNERS else _SCANNERS[0]
        for batch in batches:
            rows = [scanner.scan(t) for t in S.texts(batch)]
            yield pa.record_batch([batch.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind in fields)], ["doc_id", *(n for n, _ in fields)])

    return S.plain(df, id_col, text_col).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(S.tidy(run), COLUMNS)
