"""Licence scans with a positional rare-token index.

Licence texts ("templates": whole short licences, the notices of long ones, SPDX lines) are
indexed by word and position. Of a document's licence words those with the highest inverse
document frequency over the templates are looked up first: a template is a candidate if the rarest
word of its mandatory key phrase is there. Then the postings of the phrase's other words are
intersected by relative position, from rare to frequent, which leaves the places where the phrase
stands word by word; no place is missed, since each holds every word of the phrase. Around
such a place the template's remaining words are looked up in the document's own postings: a word
counts if it stands within ``drift`` words of where the template has it, so insertions, gaps and
changed names do no harm. A template whose share of weight reaches ``least`` gives its label.

Defined cases: a null text is the empty text: no words, no labels, score 0. Rows are
independent, so repeated rows give equal results. Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import columns, prepare

LEAST = 0.6
#: Words by which a template's word may be away from its place beside the key phrase.
DRIFT = 8
#: Phrases whose places are counted, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Public licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software. 3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU{kind} General Public License as published by the Free Software
Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU{kind} General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so"""
_CC = "This work is licensed under a Creative Commons {words} {n} International License"
_CC_KINDS = {
    "cc-by-nc-sa": "Attribution NonCommercial ShareAlike", "cc-by-nc-nd": "Attribution NonCommercial NoDerivatives", "cc-by-nc": "Attribution NonCommercial", "cc-by-sa": "Attribution ShareAlike",
    "cc-by-nd": "Attribution NoDerivatives", "cc-by": "Attribution",
}
_SPDX = {
    "mit": "MIT", "apache-2": "Apache-2.0", "gpl-2": "GPL-2.0", "gpl-3": "GPL-3.0", "lgpl": "LGPL", "agpl": "AGPL-3.0", "mpl-2": "MPL-2.0", "epl": "EPL-2.0", "bsd-2": "BSD-2-Clause", "bsd-3": "BSD-3-Clause",
    "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "bsl-1": "BSL-1.0", "cc0": "CC0-1.0", "cc-by": "CC-BY-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by-nc": "CC-BY-NC-4.0",
}
#: (label, text or notice, mandatory key phrase within it).
TEMPLATES = [
    ("mit", _MIT, "free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License", "the MIT License"),
    ("bsd-2", f"{_BSD_2} {_BSD_END}", "source and binary forms, with or without modification"),
    ("bsd-3", f"{_BSD_2} {_BSD_3} {_BSD_END}", "to endorse or promote products derived from this software"),
    ("isc", _ISC, "copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("zlib", _ZLIB, "origin of this software must not be misrepresented"),
    ("apache-2", _APACHE, "Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "the Apache License, Version 2"),
    ("gpl-2", _GPL.format(kind="", n=2), "either version 2 of the License"),
    ("gpl-3", _GPL.format(kind="", n=3), "either version 3 of the License"),
    ("lgpl", _GPL.format(kind=" Lesser", n=3), "GNU Lesser General Public License"),
    ("agpl", _GPL.format(kind=" Affero", n=3), "GNU Affero General Public License"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", "GNU General Public License version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3"),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "General Public License Version 2 June 1991"),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU General Public License Version 3 29 June 2007"),
    ("lgpl", "Licensed under the GNU Lesser General Public License", "GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License", "GNU Affero General Public License"),
    ("mpl-2", _MPL, "the Mozilla Public License"),
    ("epl", _EPL, "the Eclipse Public License"),
    ("unlicense", _UNLICENSE, "free and unencumbered software"),
    ("bsl-1", _BSL, "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "Released under CC0 1.0 Universal", "CC0 1.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "copyright and related or neighboring rights"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc-by", "Licensed under CC BY 4.0", "CC BY 4.0"),
    *((label, _CC.format(words=words, n="4.0"), f"Creative Commons {words} 4.0 International") for label, words in _CC_KINDS.items()),
    *((label, f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}") for label, name in _SPDX.items()),
]

#: A word is a run of these: digits, small letters and anything beyond ASCII.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Index:
    """Postings of all words of all templates, by word: (template, position)."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.texts = [(label, words_of(body), words_of(key), False) for label, body, key in templates]
        self.texts += [(label, words_of(phrase), words_of(phrase), True) for phrase, label in base]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, body, _, _) in enumerate(self.texts):
            for p, w in enumerate(body):
                self.postings[w].append((t, p))
        in_texts = Counter(w for _, body, _, _ in self.texts for w in set(body))
        self.idf = {w: math.log(1 + len(self.texts) / n) for w, n in in_texts.items()}
        self.key_at, self.by_rarity, self.weight, self.at_rarest = [], [], [], defaultdict(list)
        for t, (_, body, key, _) in enumerate(self.texts):
            self.key_at.append(next(i for i in range(len(body)) if body[i : i + len(key)] == key))
            order = sorted(range(len(key)), key=lambda i: (-self.idf[key[i]], i))
            self.by_rarity.append(order)
            self.at_rarest[key[order[0]]].append(t)
            self.weight.append(sum(self.idf[w] for w in body))

    def find(self, words: list[bytes], least: float = LEAST, drift: int = DRIFT):
        """(places, labels, score): places of base phrases as (first word, label); all labels; the best share of a template."""
        anchors = self.at_rarest
        found = {w for w in words if w in anchors}
        if not found:
            return [], [], 0.0
        own: dict[bytes, list[int]] = {}

        def at(word: bytes) -> list[int]:
            """The document's postings of a licence word; all are made when the first is asked for."""
            if not own:
                for i, w in enumerate(words):
                    if w in self.postings:
                        own.setdefault(w, []).append(i)
            return own.get(word, [])

        places, labels, score = [], set(), 0.0
        for rarest in sorted(found, key=lambda w: (-self.idf[w], w)):
            for t in anchors[rarest]:
                label, body, key, is_base = self.texts[t]
                first, *others = self.by_rarity[t]
                starts = [i - first for i in at(rarest)]
                for k in others:
                    if not starts:
                        break
                    held = set(at(key[k]))
                    starts = [s for s in starts if s + k in held]
                if is_base:
                    places += [(s, label) for s in starts]
                for s in starts:
                    share = 1.0 if is_base else self._share(t, s - self.key_at[t], at, drift)
                    if share >= least:
                        labels.add(label)
                        score = max(score, share)
        return sorted(places), sorted(labels), score

    def _share(self, t: int, begin: int, at, drift: int) -> float:
        """The weight of the template's words that stand within ``drift`` of their place, as a share of all."""
        hit = 0.0
        for p, w in enumerate(self.texts[t][1]):
            own = at(w)
            i = bisect_left(own, begin + p - drift)
            if i < len(own) and own[i] <= begin + p + drift:
                hit += self.idf[w]
        return min(1.0, hit / self.weight[t])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE, least: float = LEAST, drift: int = DRIFT) -> DataFrame:
    """(doc_id, n_words, places array<struct<word, label>>, labels array<string>, score)."""
    prepare(docs.sparkSession)
    index = Index(templates, base)
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def run(batches):
        for batch in batches:
            n, places, labels, score = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = index.find(words, least, drift)
                n.append(len(words))
                places.append([{"word": w, "label": x} for w, x in found[0]])
                labels.append(found[1])
                score.append(found[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "places", "labels", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, places array<struct<word: long, label: string>>, labels array<string>, score double"
    return docs.select(*(c.alias(n) for c, n in zip(columns([id_col, text_col]), ["doc_id", "text"], strict=True))).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda x: x["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
