"""Licence texts in documents, by patience alignment of words.

Long words that stand once in a template are its keys, one more of them than an accepted match may lack. Each key in
the stream of a text's words says where the template would begin; the window around that place, wider by what a
match may lack or add, is aligned. Line ends play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.patience import align

COVERAGE = 0.8
#: Words that a match may have between those of the template, as a share of them.
ADDED = 0.3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in b"." or 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))

# Short notices and standard texts of public licences.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause-notice": "Distributed under the BSD 3-Clause License.",
    "Copyright-notice": "Copyright. All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-condition": """Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of a-z (A-Z folded), 0-9, inner dots and characters beyond ASCII."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return [w for w in (x.strip(b".") for x in folded.split()) if w]


class Template:
    """A template's words, and the keys that say where it would begin."""

    def __init__(self, name: str, text: str) -> None:
        self.name = name
        self.words = words_of(text)
        self.counts = Counter(self.words)
        size = len(self.words)
        self.least = math.ceil(COVERAGE * size - 1e-9)
        # A match lacks at most size - least words, so that one of the keys is in it; it may be as far off as the
        # words that it lacks or has besides.
        self.width = size + math.ceil(ADDED * size)
        self.slack = self.width - self.least
        once = sorted((w for w, n in self.counts.items() if n == 1), key=lambda w: (-len(w), w))
        needed = size - self.least + 1
        chosen = set(once[:needed]) if len(once) >= needed else set(self.words)
        self.keys: dict[bytes, list[int]] = {}
        for k, word in enumerate(self.words):
            if word in chosen:
                self.keys.setdefault(word, []).append(k)

    def _covered(self, words: list[bytes], begin: int, end: int) -> list[tuple[int, int]]:
        """Pairs of words and the template's, if they cover enough of it within ``width`` words; else none."""
        here = words[begin:end]
        if not self._may_cover(here):
            return []
        # Words far from the others are chance: the span is the densest that still covers enough.
        return [(begin + i, j) for i, j in _densest(align(here, self.words), self.least, self.width)]

    def match(self, words: list[bytes], places: list[tuple[int, bytes]] | None = None) -> list[tuple[float, int, int]]:
        """``(coverage, first word, end word)`` of the best match, and of the best in what is left before and after it, and so on."""
        if places is None:
            places = [(i, w) for i, w in enumerate(words) if w in self.keys]
        chosen, open_parts = [], [(0, len(words), [p for p in places if p[1] in self.keys])]
        while open_parts:
            begin, end, here = open_parts.pop()
            found = self._candidates(words[begin:end], [(p - begin, w) for p, w in here]) if here else set()
            if not found:
                continue
            coverage, a, b = min(found, key=lambda m: (-m[0], m[2] - m[1], m[1]))
            a, b = a + begin, b + begin
            chosen.append((coverage, a, b))
            open_parts += [(begin, a, [x for x in here if x[0] < a]), (b, end, [x for x in here if x[0] >= b])]
        return sorted(chosen, key=lambda m: m[1])

    def _candidates(self, words: list[bytes], places: list[tuple[int, bytes]]) -> set[tuple[float, int, int]]:
        out: set[tuple[float, int, int]] = set()
        for p, word in places:
            for k in self.keys[word]:
                if any(a <= p < b for _, a, b in out):
                    break
                begin, end = max(0, p - k - self.slack), p - k + len(self.words) + self.slack
                if not self._may_cover(words[begin:end]):
                    continue
                pairs = self._covered(words, begin, end)
                if pairs and not pairs[0][0] <= p <= pairs[-1][0]:
                    # Another match is in the window as well, so that this key needs narrower ones.
                    out.add(self._found(pairs))
                    pairs = []
                if not pairs:
                    pairs = max((self._covered(words, i, i + self.width) for i in range(max(0, p - self.width + 1), p + 1)),
                                key=lambda x: (len(x), x[0][0] - x[-1][0] if x else 0))
                if pairs:
                    out.add(self._found(pairs))
        return out

    def _may_cover(self, here: list[bytes]) -> bool:
        """No alignment covers more than the template's words that occur in the window."""
        return sum(min(n, self.counts[w]) for w, n in Counter(here).items() if w in self.counts) >= self.least

    def _found(self, pairs: list[tuple[int, int]]) -> tuple[float, int, int]:
        return len(pairs) / len(self.words), pairs[0][0], pairs[-1][0] + 1


def _densest(pairs: list[tuple[int, int]], least: int, width: int) -> list[tuple[int, int]]:
    """The most pairs that lie within ``width`` words, if there are ``least``; the first of equal ones."""
    best: list[tuple[int, int]] = []
    begin = 0
    for end in range(len(pairs)):
        while pairs[end][0] - pairs[begin][0] >= width:
            begin += 1
        if end + 1 - begin > max(len(best), least - 1):
            best = pairs[begin:end + 1]
    return best


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences that each whole text has, found if an alignment covers 0.8 of the template's words.

    Returns ``id_col, n_words, n_matches, licenses`` (names, sorted, joined by commas), ``best``
    (the name of the largest coverage; of equals the longer template, then the first name),
    ``coverage`` (0 if none) and ``spans`` (first word and end word of each match, merged). A match may have words
    between those of the template, up to 0.3 of its length; matches of a template do not overlap. Null and
    empty texts have none; rows that repeat are scanned alike; further columns are ignored. The
    templates are few and fixed, and go to every task; pass others, whole licences too, as ``templates``.
    """
    known = [Template(n, t) for n, t in sorted((templates or TEMPLATES).items())]
    keys = frozenset().union(*(t.keys for t in known))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                n = len(words)
                places = [(i, w) for i, w in enumerate(words) if w in keys]
                matches = [(coverage, len(t.words), t.name, a, b) for t in known for coverage, a, b in t.match(words, places)] if places else []
                best = min(matches, key=lambda m: (-m[0], -m[1], m[2]), default=(0.0, 0, None))
                spans: list[int] = []
                for _, _, _, a, b in sorted(matches, key=lambda m: m[3:]):
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b)
                    else:
                        spans += [a, b]
                out.append((n, len(matches), ",".join(sorted({m[2] for m in matches})), best[2], best[0], spans))
            frame = pd.DataFrame(out, columns=["n_words", "n_matches", "licenses", "best", "coverage", "spans"])
            frame.insert(0, id_col, batch["id"].to_numpy())
            yield frame

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, n_words bigint, n_matches bigint, licenses string, best string, "
                                   "coverage double, spans array<bigint>")
