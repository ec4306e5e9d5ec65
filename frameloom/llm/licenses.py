"""Licence scans: normalised passages against templates by the Dice coefficient over word bigrams.

Words are runs of ASCII letters and digits, lower-cased. A passage is any run of words, wherever lines break, so a
licence inside a paragraph of prose is found as well. Its Dice coefficient with a template is
2 |A and B| / (|A| + |B|) over sets of bigrams. Two bounds prune without
loss: a passage that reaches the threshold t has between t/(2-t) and (2-t)/t times the template's
bigrams (size), and shares at least t/(2-t) of them (overlap), so a document sharing fewer drops the
template at once. The best passage starts and ends with a bigram of the template, as cutting others off raises
the coefficient; only such runs are tried, and from a start only the first places of different bigrams, no more than the
size bound allows. Time grows in proportion to the text, repeated notices included.

Documents are independent: no shuffle, and the templates are a fixed list sent with the task. Defined
cases: null and empty texts hold no licence; a text of any length is searched whole; repeated rows
give repeated results; of passages that tie the first and shortest is reported; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameloom.llm.common import need

THRESHOLD = 0.8

#: Templates: notices and short licences (fixed values; public licence texts).
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

#: Notices and texts that differ from one above by a name, a number or a clause (fixed values; public licence texts).
TEMPLATES |= {
    "AGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General"),
    "LGPL-3.0-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General"),
    "GPL-2.0-notice": TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"),
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED", 1),
    "0BSD": TEMPLATES["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
}

WORD = re.compile(r"[a-z0-9]+")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Templates:
    """Bigrams of the templates, and the templates that hold each."""

    def __init__(self, texts: dict[str, str], threshold: float) -> None:
        self.t = threshold
        self.sets = {k: b for k, v in texts.items() if (b := bigrams(WORD.findall(v.lower())))}
        self.every: dict[tuple[str, str], list[str]] = {}
        for k, b in self.sets.items():
            for x in b:
                self.every.setdefault(x, []).append(k)
        low = threshold / (2 - threshold)
        self.least = {k: low * len(b) - 1e-9 for k, b in self.sets.items()}
        self.most = {k: len(b) / low + 1e-9 for k, b in self.sets.items()}

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first line, last line) of the best passage for each template that reaches the threshold."""
        words = WORD.findall(text.lower())
        shared = self.every.keys() & set(zip(words, words[1:], strict=False))
        if not shared:
            return []
        hits: dict[str, int] = {}
        for x in shared:
            for k in self.every[x]:
                hits[k] = hits.get(k, 0) + 1
        names = [k for k, n in hits.items() if n >= self.least[k]]
        return self._passages(text, words, names) if names else []

    def _passages(self, text: str, words: list[str], names: list[str]) -> list[tuple[str, float, int, int]]:
        pairs = list(zip(words, words[1:], strict=False))
        out = [(k, *best) for k in names if (best := self._best(pairs, k))]
        if not out:
            return []
        low = text.lower()
        starts = [m.start() for m in WORD.finditer(low)]
        line = lambda w: low.count("\n", 0, starts[w])
        return sorted((k, d, line(a), line(b)) for k, d, a, b in out)

    def _best(self, pairs: list[tuple[str, str]], name: str) -> tuple[float, int, int] | None:
        """(coefficient, first word, last word) of the best passage for a template.

        Starts are tried from the last to the first. Behind a start only the first place of each different bigram matters, as
        others change nothing, and these places in order are a list in which each bigram met moves to the front. At most `most` of them
        are looked at, so time grows with the text and the template, however often the text repeats.
        """
        want, most, n = self.sets[name], self.most[name], len(self.sets[name])
        best: tuple[float, int, int] | None = None
        ahead: OrderedDict[tuple[str, str], int] = OrderedDict()  # the nearest bigram last
        for a in range(len(pairs) - 1, -1, -1):
            ahead[pairs[a]] = a
            ahead.move_to_end(pairs[a])
            if pairs[a] not in want:
                continue
            goal = max(self.t, best[0] if best else 0.0)
            have = both = 0
            mine: tuple[float, int, int] | None = None
            for x in reversed(ahead):
                have += 1
                if have > most:
                    break
                if x in want:
                    both += 1
                    dice = 2 * both / (have + n)
                    if dice >= self.t and (mine is None or dice > mine[0]):
                        mine = (dice, a, ahead[x] + 1)
                elif 2 * n / (have + n - both + n) < goal - 1e-12:
                    break  # not even with all that is missing
            # Of passages that tie the first stays, and it is tried last.
            if mine and (best is None or mine[0] >= best[0]):
                best = mine
        return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, license_id, dice, first_line, last_line (0-based, where its first and last word stand): the best passage of each licence in each document."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    rows = need(docs, *keys, text)
    table = dict(templates if templates is not None else TEMPLATES)
    names = ["license_id", "dice", "first_line", "last_line"]
    types = [pa.string(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(table, threshold)
        for batch in batches:
            found = [(i, *x) for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()) if t for x in known.scan(t)]
            index, *columns = zip(*found, strict=True) if found else [()] * 5
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)).take(at) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*keys, *names])

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("license_id", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())])
    return rows.mapInArrow(run, schema)
