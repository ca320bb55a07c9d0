"""Licence scans by a positional rare-token index.

The templates below are licence notices and whole licence texts. Their words are indexed with their positions. A corpus pass counts
in how many files each template word occurs. The index holds, for each of the rarest words of the templates, its postings
(template, position): a file looks up which of those words it has, and each posting votes for (template, position in file -
position in template). Only a template whose rare words could carry enough is looked at further, only alignments that have enough
votes, and of those the ones with a mandatory phrase of the template near them, word for word, are scored in full.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm.common import pick

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Fixed values: (label, notice, mandatory phrases, one of which must stand there).
TEMPLATES = [
    ("agpl", "licensed under the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("apache", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the License you may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["www apache org licenses"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
    ("epl", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "licensed under the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license", "gnu library general public license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction", ["permission is hereby granted free of charge"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "This software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["provided as is without any express or implied warranty"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ["the above copyright notice and this permission notice shall be included", "permission is hereby granted free of charge"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ["with or without fee is hereby granted"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", ["altered source versions must be plainly marked", "provided as is without any express or implied warranty"]),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""", ["to any person or organization obtaining a copy", "machine executable object code generated by a source language processor"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""", ["free and unencumbered software", "an overt act of relinquishment in perpetuity"]),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ["apache license", "www apache org licenses"]),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""", ["gnu general public license"]),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", ["gnu lesser general public license", "gnu library general public license"]),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", ["gnu affero general public license"]),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ["mozilla public license"]),
]

#: Bytes to words: A-Z to lower case; \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F separate (after lower-casing).
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: How far an alignment may shift, least share of a template's weight.
SLACK, LEAST = 3, 0.55


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _phrase(text: str) -> tuple[bytes, ...]:
    return tuple(words_of(text))


_TEMPLATES = [(label, _phrase(text), [_phrase(p) for p in phrases]) for label, text, phrases in TEMPLATES]
_BASE = [(_phrase(p), label) for p, label in BASE.items()]
#: Every template and phrase word; bounded by the templates.
VOCABULARY = frozenset(w for _, words, phrases in _TEMPLATES for ws in (words, *phrases) for w in ws) | {w for p, _ in _BASE for w in p}


def document_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """In how many rows of docs (doc_id, text) each template word stands, and under b"" the number of rows.

    Each task sums its own counts first; the result has at most as many rows as the templates have words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(VOCABULARY.intersection(words_of(text)))
                counts[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


class Scanner:
    def __init__(self, frequencies: dict[bytes, int]) -> None:
        n = max(1, frequencies.get(b"", 0))
        self.weight = {w: math.log((n + 1) / (frequencies.get(w, 0) + 1)) + 1e-6 for w in VOCABULARY}
        self.total = [sum(self.weight[w] for w in words) for _, words, _ in _TEMPLATES]
        #: The index: rare words with their postings (template, position). Of each template it holds the rarest words, enough that what the others weigh together (rest) is too low without them.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rest: list[float] = []
        for t, ((_, words, _), total) in enumerate(zip(_TEMPLATES, self.total, strict=True)):
            rest = total
            for k, w in sorted(enumerate(words), key=lambda e: (-self.weight[e[1]], e[0])):
                if rest < LEAST * total * (1 - 1e-9):
                    break
                self.postings[w].append((t, k))
                rest -= self.weight[w]
            self.rest.append(rest)
        #: Of each template: its mandatory phrases with the place of their rarest word.
        self.phrases = [[(p, max(range(len(p)), key=lambda j, p=p: self.weight[p[j]])) for p in phrases] for _, _, phrases in _TEMPLATES]

    def _alignments(self, words: list[bytes], at: dict[bytes, list[int]]) -> Iterator[tuple[int, list[int]]]:
        """(template, shifts) of every template that the file may hold: all its alignments that have votes enough and a mandatory phrase near, those with most votes first."""
        met: dict[int, list[tuple[bytes, int]]] = defaultdict(list)  # of each template, its indexed words that the file has, by their postings
        for w in at.keys() & self.postings.keys():
            for t, k in self.postings[w]:
                met[t].append((w, k))
        for t in sorted(met):
            least = (LEAST - 1e-9) * self.total[t] - self.rest[t]
            if sum(self.weight[w] for w, _ in met[t]) < least:
                continue
            votes: dict[int, float] = defaultdict(float)
            for w, k in met[t]:
                for shift in {i - k + d for i in at[w] for d in range(-SLACK, SLACK + 1)}:
                    votes[shift] += self.weight[w]
            enough = [shift for shift, vote in sorted(votes.items(), key=lambda v: (-v[1], v[0])) if vote >= least]
            if enough and (starts := self._phrase_starts(t, words, at)):
                size = len(_TEMPLATES[t][1])
                near = [s for s in enough if (j := bisect_left(starts, s - SLACK)) < len(starts) and starts[j] < s + size + SLACK]
                if near:
                    yield t, near

    def _phrase_starts(self, t: int, words: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Where a mandatory phrase of template t stands, word for word."""
        return sorted({i - j for phrase, j in self.phrases[t] for i in at.get(phrase[j], ()) if i >= j and tuple(words[i - j : i - j + len(phrase)]) == phrase})

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in VOCABULARY:
                at[w].append(i)
        base, places = set(), []
        for phrase, label in _BASE:
            found = [i for i in at.get(phrase[0], ()) if tuple(words[i : i + len(phrase)]) == phrase]
            if found:
                base.add(label)
                places += found
        labels, score = set(base), 0.0
        known = False
        for t, shifts in self._alignments(words, at):
            label, template, _ = _TEMPLATES[t]
            best = 0.0
            for shift in shifts:
                hit = sum(self.weight[w] for k, w in enumerate(template) if w in at and w in words[max(0, shift + k - SLACK) : max(0, shift + k + SLACK + 1)])
                best = max(best, hit / self.total[t])
                if best >= 1:
                    break
            if best >= LEAST:
                known = True
                labels.add(label)
                score = max(score, best)
        if base and not known:
            score = max(score, 0.5)  # a phrase alone, outside any known notice
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 6)


def licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of df.

    Null texts count as empty; no places give null first_word and last_word and empty labels. Repeated rows each get a row.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    frequencies = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(frequencies)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
