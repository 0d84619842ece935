"""License scans by conditional compression.

The words about each mark of a licence (CANDIDATE), over line ends and comment
signs, are cut into overlapping blocks. A block is compressed plainly and with
each template as a raw zstandard dictionary; templates are ranked by how much
smaller the block becomes. The ranking rejects none: every template is aligned
with the block's words, and each place in a text goes to the template that
agrees best in wording, the higher ranked of equals. All places are returned.
Candidates are found by a built-in expression, so texts without one never reach
Python.

Defined results: null and empty texts have no block; an empty table gives no
row; repeated rows get equal results; of places of equal score the one of the
template that saves more goes first, then the earlier template; a text of any
length is cut into blocks, none left out; a column named licenses is replaced;
a notice's line is that of its first word, ``missing`` counts the
template's words that it lacks, ``extra`` other words between its own; words
more than GAP apart for each kept word are not of one notice; other columns
pass through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Usual notices and whole texts of public licences, and identifiers.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format(name="", version="2")),
    ("GPL-3.0", _GNU.format(name="", version="3")),
    ("LGPL-2.1", _GNU.format(name="Lesser ", version="2.1")),
    ("LGPL-3.0", _GNU.format(name="Lesser ", version="3")),
    ("AGPL-3.0", _GNU.format(name="Affero ", version="3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "BSL-1.0", "Zlib", "Unlicense", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "GPL-2.0-only", "GPL-2.0-or-later",
        "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MIT OR Apache-2.0",
    )),
)
CANDIDATE = r"(?i)licen[cs]|permission[^a-z0-9]+(?:is[^a-z0-9]+hereby|to[^a-z0-9]+use|is[^a-z0-9]+granted)|redistribution[^a-z0-9]+and[^a-z0-9]+use|public[^a-z0-9]+domain"
WORD = re.compile(r"[a-z0-9.+-]*[a-z0-9]")
#: Words that tell a licence from others; with those that hold digits, a notice must have all of its template's, and one of EITHER.
NAMING, EITHER = frozenset("apache mit lesser affero by by-sa by-nc".split()), frozenset({"gnu", "general"})
#: Share of a template's words that a notice must have.
COVER = 0.8
#: Words of a block; blocks overlap by half, so any notice of half as many words lies whole in one: each template with a tenth of other words.
SIZE = max(96, 2 * math.ceil(1.1 * max(len(WORD.findall(t.lower())) for _, t in TEMPLATES)))
#: Other words that a kept word outweighs in an alignment.
GAP = 8


class Scanner:
    def __init__(self, templates=TEMPLATES):
        self.templates = []
        for name, t in templates:
            want = WORD.findall(t.lower())
            at = {w: np.flatnonzero([x == w for x in want]) for w in want}
            must = {w for w in want if w in NAMING or any(c.isdigit() for c in w)}
            named = np.array([w in must for w in want], np.int64)
            either = np.array([w in EITHER for w in want], np.int64)
            self.templates.append((name, len(want), at, (named, either), must))
        self.plain = zstandard.ZstdCompressor(level=19)
        self.given = [
            zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict((t + " " * max(0, 8 - len(t))).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, t in templates
        ]

    def saved(self, block: str, k: int | None = None) -> list[float]:
        """Share of a block that each template, or the k-th, saves as a dictionary."""
        data = block.encode("utf-8", "replace")
        size = len(self.plain.compress(data))
        return [(size - len(c.compress(data))) / size for c in (self.given if k is None else [self.given[k]])]

    def align(self, k: int, words: list) -> tuple[int, int, int, int] | None:
        """(kept less missing and extra, first, end, kept) of the best place of a template among words; None stands for words that are taken."""
        _, n, at, (named, either), _ = self.templates[k]
        need, all_named, some = COVER * n, int(named.sum()), int(either.any())
        # best alignment so far of the template's words up to j: score and first word as one number (the score grows by i, so that
        # what is not met again loses one a word), and how many words, naming words and words of EITHER it keeps
        key = np.full(n + 1, -1, np.int64)
        kept, names, eithers, first = (np.zeros(n + 1, np.int64) for _ in range(4))
        place = np.arange(n + 1)
        best = None
        for i, w in enumerate(words):
            if w is None:
                key[:] = -1
                continue
            js = at.get(w)
            if js is None:
                continue
            score = (key[js] >> 20) - (i - 1)
            on = score > 0
            to = js + 1
            start = np.where(on, first[js], i)
            got = (np.where(on, score, 0) + GAP + i << 20) + start
            new = [np.where(on, x[js], 0) + d for x, d in ((kept, 1), (names, named[js]), (eithers, either[js]))]
            full = np.flatnonzero((new[0] >= need) & (new[1] == all_named) & (new[2] >= some))
            for f in full:
                value = (int(2 * new[0][f] - n - (i + 1 - start[f] - new[0][f])), int(start[f]), i + 1, int(new[0][f]))
                if best is None or value[0] > best[0]:
                    best = value
            better = got > key[to]
            if not better.any():
                continue
            to = to[better]
            key[to] = got[better]
            kept[to], names[to], eithers[to], first[to] = (x[better] for x in (*new, start))
            top = np.maximum.accumulate(key)
            came = np.maximum.accumulate(np.where(key == top, place, 0))
            key, kept, names, eithers, first = top, kept[came], names[came], eithers[came], first[came]
        return best

    def block(self, words: list, text: str) -> list[tuple[int, int, int, int]]:
        """(template, first, end, kept) of all places in a block; words that are taken are None."""
        held = {w for w in words if w}
        likely = [k for k, (_, n, at, _, must) in enumerate(self.templates) if must <= held and sum(len(j) for w, j in at.items() if w in held) >= COVER * n]
        if not likely:
            return []
        words, out = list(words), []
        saved = dict(zip(likely, (self.saved(text, k)[0] for k in likely), strict=True))
        likely.sort(key=lambda k: (-saved[k], k))
        places = {k: self.align(k, words) for k in likely}
        while True:
            found = [(place, k) for k, place in places.items() if place]
            if not found:
                return out
            (_, first, end, kept), k = max(found, key=lambda x: x[0][0])
            out.append((k, first, end, kept))
            words[first:end] = [None] * (end - first)
            for place, other in found:  # only places that the words taken touch change
                if place[1] < end and place[2] > first:
                    places[other] = self.align(other, words)

    def notices(self, text: str) -> list[dict]:
        """All notices of a text by place."""
        text = text.lower()
        spans = [m.span() for m in WORD.finditer(text)]
        starts = [s for s, _ in spans]
        words: list = [text[s:e] for s, e in spans]
        regions: list[list[int]] = []
        for m in re.finditer(CANDIDATE, text):
            c = bisect_right(starts, m.start()) - 1
            lo, hi = max(0, c - SIZE // 2), min(len(words), c + SIZE // 2)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        out = []
        for lo, hi in regions:
            for b in range(lo, max(lo + 1, hi - SIZE // 2), SIZE // 2):
                e = min(b + SIZE, hi)
                for k, first, end, kept in self.block(words[b:e], text[spans[b][0] : spans[e - 1][1]]):
                    first, end = first + b, end + b
                    if e < hi and first >= b + SIZE // 2:
                        continue  # whole in the next block
                    out.append((first, end, k, kept))
                    words[first:end] = [None] * (end - first)
        notices = []
        for first, end, k, kept in sorted(out):
            name, n = self.templates[k][:2]
            (at, _), (_, to) = spans[first], spans[end - 1]
            notices.append({"line": text.count("\n", 0, at), "license": name, "saved": self.saved(text[at:to], k)[0], "missing": n - kept, "extra": end - first - kept})
        return notices


_SCANNER = Scanner()


def confirmed(text: str) -> list[dict]:
    return _SCANNER.notices(text)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with licenses: array of (line, license, saved, missing, extra) in the order of lines."""

    @F.pandas_udf("array<struct<line:int,license:string,saved:double,missing:int,extra:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([confirmed(t) if isinstance(t, str) else [] for t in texts], dtype=object)

    some = docs.withColumn("__el_t", F.when(F.col(text_col).rlike(CANDIDATE), F.col(text_col)))
    return some.withColumn("licenses", found(F.col("__el_t"))).drop("__el_t")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["line"], x["license"], x["missing"], x["extra"])), ",")
    return docs.select("doc_id", F.size("licenses").cast("long").alias("n_blocks"), F.array_join(names, ",").alias("licenses"), spans.alias("blocks"))
