"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained to spans.

Each text streams through the automaton of all templates once: at every token it knows the longest suffix that stands
somewhere in a template. Maximal matches of at least LEAST tokens are linked, in order and with bounded gaps, into
chains over one template; the share of the template that a chain covers is its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Bytes of words: digits, lower-case letters, everything beyond ASCII; A-Z become lower case, the rest are breaks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Tokens of a match that counts; tokens that a chain may skip; share of a template that gives its label.
LEAST, GAP, COVER = 5, 24, 0.8
#: Label and words of each base phrase.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Label and wording of published licences and notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((f"cc-{x}", f"Licensed under CC {x.upper()} {v}") for x in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")),
    *((f"cc-{x}", f"This work is licensed under the Creative Commons {name} {v} International License.") for x, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")) for v in ("4.0",)),
]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of the templates' token ids, with where each state's strings end."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.words: dict[bytes, int] = {}
        self.size = []
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, (_, text) in enumerate(templates):
            ids = [self.words.setdefault(w, len(self.words)) for w in tokens(text)]
            self.size.append(len(ids))
            last = 0
            for at, c in enumerate(ids):
                last = self._add(last, c)
                self.ends[last].add((k, at))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new], self.link[new] = dict(self.next[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def matches(self, ids: list[int], offset: int) -> list[tuple[int, int, int]]:
        """(first token, length, state) of the maximal matches among ids, which are all in the vocabulary."""
        out, state, n = [], 0, 0
        for i, c in enumerate(ids):
            if c not in self.next[state] and n >= LEAST:
                out.append((offset + i - n, n, state))
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
        if n >= LEAST:
            out.append((offset + len(ids) - n, n, state))
        return out

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first token, end, share of the template) of the best chain that ends with each match."""
        out = []
        recent: dict[int, list[tuple[int, int, int, int, int]]] = {}  # template -> (end, template end, covered, first, start)
        for start, n, state in found:
            for k, at in sorted(self.ends[state]):
                covered, first, begin = n, start, at - n + 1
                held = [x for x in recent.get(k, ()) if x[0] >= start - GAP]
                for end, t_end, c, f, _ in held:
                    # tokens that two matches share, in the text or in the template, count once
                    shared = max(0, end - start, t_end - begin)
                    if shared < n and t_end <= at and begin - t_end <= GAP and c + n - shared > covered:
                        covered, first = c + n - shared, f
                held.append((start + n, at + 1, covered, first, start))
                recent[k] = held
                out.append((k, first, start + n, min(1.0, covered / self.size[k])))
        return [(self.labels[k], a, b, s) for k, a, b, s in out]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.automaton = Automaton(templates)
        vocabulary = dict(self.automaton.words)
        self.phrases = [(label, [vocabulary.setdefault(w, len(vocabulary)) for w in tokens(words)]) for label, words in PHRASES]
        self.known = len(self.automaton.words)
        self.get = lambda w, get=vocabulary.get: get(w, -1)

    def scan(self, text: str | None) -> tuple:
        """n_words, starts and labels of base phrases, chains."""
        words = tokens(text)
        ids = np.fromiter(map(self.get, words), np.int32, len(words))
        places, labels = [], set()
        for label, phrase in self.phrases:
            hit = np.flatnonzero(ids == phrase[-1]) - (len(phrase) - 1)
            hit = hit[hit >= 0]
            for k, p in enumerate(phrase[:-1]):
                hit = hit[ids[hit + k] == p]
            if len(hit):
                labels.add(label)
                places += hit.tolist()
        inside = np.concatenate([[False], (ids >= 0) & (ids < self.known), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        found = []
        for a, b in edges[edges[:, 1] - edges[:, 0] >= LEAST].tolist():
            found += self.automaton.matches(ids[a:b].tolist(), a)
        return len(words), places, labels, self.automaton.chains(found)


_SCANNERS: dict[int, Scanner] = {}


def scanner(templates: list[tuple[str, str]]) -> Scanner:
    key = hash(tuple(templates))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(templates)
    return _SCANNERS[key]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


#: Templates that a worker holds; a table of more is refused.
MOST = 20_000


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id with the columns of SCHEMA: base phrases, labels with those of covered templates, their spans in words.

    templates: a table of label and text, at most MOST rows; TEMPLATES if none is given. Rows without either play no part.

    A null or empty text has no words and score 0. Each row is scanned whole and alone: repeated rows are alike, an
    empty table gives an empty result, other columns of docs play no part.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    known = TEMPLATES
    if templates is not None:
        known = [tuple(r) for r in templates.select("label", "text").where("label is not null and text is not null").distinct().orderBy("label", "text").limit(MOST + 1).collect()]
        if len(known) > MOST:
            raise ValueError(f"more than {MOST} templates")
    sent = docs.sparkSession.sparkContext.broadcast(known)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(sent.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, places, base, chains = s.scan(text)
                spans = [{"label": x, "start": a, "end": b, "cover": c} for x, a, b, c in chains if c >= COVER]
                labels = base | {x["label"] for x in spans}
                score = 1.0 if base else max([0.0, *(c for *_, c in chains)])
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
