"""License scans: a generalised suffix automaton over the words of license templates.

All templates go into one automaton over words. A text streams through it and each word gets its matching
statistic, the length of the longest run of words ending there that occurs in some template. Long matches of one
template are chained, in order in text and template, into covered spans, as many as the text has notices; a template
whose words are covered to a sufficient part is a label. Phrases of few words are base labels: they hold wherever their
words stand consecutively.

Words outside the templates' vocabulary lead back to the root, so only runs of vocabulary words are streamed;
runs are found for a whole batch at once.

Defined results: a null or wordless text has no words, labels or places; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R, textcodes as X

#: Base phrases and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices and texts of public licenses and their labels (fixed values).
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the bsd license": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
    to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
    EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
    IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
    License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
    distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""": "apache-2",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
    Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
    have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""": "gpl-3",
    """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
    Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""": "lgpl",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
    at https://mozilla.org/MPL/2.0/.""": "mpl-2",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
    source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
    PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
    ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
    this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
    RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE.""": "isc",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
    software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
    the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""": "zlib",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
    either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""": "unlicense",
}
#: Matches shorter than this many words start no span; a label needs this part of a template covered.
LEAST_MATCH = 3
LEAST_COVERED = 0.75

_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"


class SuffixAutomaton:
    """A generalised suffix automaton over integer sequences, with an end place (sequence, position) for each state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: every (sequence, end) at which the state's longest run ends
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((k, at + 1))
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(e)) for e in self.ends]

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(dict(moves))
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest run plus word, split off where the move leads to a longer one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(state, matched length) after each word."""
        state, length, out = 0, 0, []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            out.append((state, length))
        return out

    def state_of(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        sequences = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for t in [*phrases, *templates]]
        self.labels = [*phrases.values(), *templates.values()]
        self.base = len(phrases)
        words = sorted({w for s in sequences for w in s})
        hashes = X.words(*_packed(words), "alnum", fold=True).hash
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        number = {words[o]: k for k, o in enumerate(order)}
        self.sequences = [[number[w] for w in s] for s in sequences]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        # phrases that end in each state: those on its chain of suffix links, with the match long enough
        own: dict[int, list[int]] = {}
        for k in range(self.base):
            own.setdefault(self.automaton.state_of(self.sequences[k]), []).append(k)
        self.phrases_at: list[list[int]] = [[] for _ in self.automaton.length]
        for s in sorted(range(1, len(self.phrases_at)), key=lambda s: self.automaton.length[s]):
            self.phrases_at[s] = self.phrases_at[max(0, self.automaton.link[s])] + own.get(s, [])
        self.least = min([LEAST_MATCH, *self.sizes[: self.base]])

    def run(self, words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places (phrase, start) and maximal matches (template, template start, start, length) of a run of vocabulary words."""
        got = self.automaton.statistics(words)
        places, matches = [], []
        for at, (state, length) in enumerate(got):
            for k in self.phrases_at[state]:
                if self.sizes[k] <= length:
                    places.append((k, at + 1 - self.sizes[k]))
            longest = at + 1 == len(got) or got[at + 1][1] <= length
            if longest and length >= LEAST_MATCH:
                matches += [(k, end - length, at + 1 - length, length) for k, end in self.automaton.ends[state] if k >= self.base]
        return places, matches

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, covered part, start, end): of each template the chains of matches, in order in both, that do not overlap.

        Chains with more of the template covered go first, then shorter ones.
        """
        own: dict[int, list[tuple[int, int, int]]] = {}
        for k, t, start, n in matches:
            own.setdefault(k, []).append((start, t, n))
        out = []
        for k, parts in sorted(own.items()):
            parts.sort()
            best: list[tuple[int, int, int]] = []  # covered words, start and end in the text, of the chain that ends with each match
            for i, (start, t, n) in enumerate(parts):
                top = (n, start)
                for j in range(i - 1, -1, -1):
                    s0, t0, n0 = parts[j]
                    if start - s0 > 2 * self.sizes[k]:
                        break
                    if s0 + n0 <= start and t0 + n0 <= t:
                        top = max(top, (best[j][0] + n, best[j][1]))
                best.append((*top, start + n))
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted(best, key=lambda b: (-b[0], b[2] - b[1], b[1])):
                at = bisect.bisect_left(taken, (start, end))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (start, end))
                out.append((k, min(1.0, covered / self.sizes[k]), start, end))
        return out


def _packed(words: list[str]):
    array = pa.array(words, pa.string())
    return R.text_bytes(array)


@functools.lru_cache(maxsize=2)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def _scan(phrases: dict[str, str], templates: dict[str, str], least_covered: float):
    key = (tuple(phrases.items()), tuple(templates.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scanner(*key)
        for part in R.pieces_of(batches):
            data, offsets = R.text_bytes(part.column(1))
            w = X.words(data, offsets, "alnum", fold=True)
            number = X.lookup(own.vocabulary, w.hash)
            known = number >= 0
            start, end = X.spans(known, w.first)
            long = end - start >= own.least
            found: dict[int, tuple[list, list]] = {}
            for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
                doc = int(w.doc[a])
                shift = a - int(w.first[doc])
                places, matches = own.run(number[a:b].tolist())
                held = found.setdefault(doc, ([], []))
                held[0].extend((k, at + shift) for k, at in places)
                held[1].extend((k, t, at + shift, n) for k, t, at, n in matches)
            rows = []
            n_words = np.diff(w.first)
            for d, doc_id in enumerate(part.column(0).to_pylist()):
                places, matches = found.get(d, ((), ()))
                base = sorted({own.labels[k] for k, _ in places})
                chains = own.chains(matches) if matches else []
                spans = [{"label": own.labels[k], "start": at, "end": at + own.sizes[k]} for k, at in places]
                spans += [{"label": own.labels[k], "start": a, "end": b} for k, part_, a, b in chains if part_ >= least_covered]
                labels = sorted({s["label"] for s in spans})
                score = 1.0 if places else max((c[1] for c in chains), default=0.0)
                at = [p[1] for p in places]
                rows.append((doc_id, int(n_words[d]), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score, spans))
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), span)
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, least_covered: float = LEAST_COVERED) -> DataFrame:
    """Counts, places, labels, score and spans (in words) for every row of ``docs``."""
    R.ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, least_covered), _OUT)
