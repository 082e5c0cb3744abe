"""License scans by the Dice coefficient over word bigrams.

A text's blocks - the whole text, its paragraphs and its lines - and all its
windows of a template's size are normalised to words and compared with licence
templates: twice the shared bigrams over all bigrams of both. A block of n
bigrams can reach the least score only against templates of a size close to n,
so templates are kept by size and only those within the bounds are compared,
and of them only those that share a bigram. Windows are tried only where a text
holds enough of a template's bigrams, and begin where it holds one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Licence notices as their stewards word them, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "LicenseRef-all-rights-reserved": ["All rights reserved."],
}

_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
_COPYRIGHT = re.compile(r"(?:copyright\s+(?:\(c\)|\u00a9|\d{4})|(?:\(c\)|\u00a9)\s*\d{4})[^\n]*?(?=all rights reserved|\n|\Z)")
_PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")


def normalise(text: str) -> list[str]:
    """Lower-case words; copyright statements with a sign or a year, up to the
    end of their line or to a reservation of rights, and layout do not count."""
    low = text.lower()
    return _WORD.findall(_COPYRIGHT.sub(" ", low) if "copyright" in low or "(c)" in low or "\u00a9" in low else low)


def bigrams(words: list[str]) -> Counter:
    """Word bigrams with their counts; a single word is paired with nothing."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


@dataclass
class Templates:
    """Licence texts by number of bigrams, with the templates that hold each bigram."""

    texts: dict[str, list[str]] = field(default_factory=lambda: TEMPLATES)
    least: float = LEAST
    #: Whether windows of the templates' sizes are compared besides blocks.
    windows: bool = False

    def __post_init__(self) -> None:
        entries = sorted(((sum((g := bigrams(normalise(t))).values()), name, g) for name, ts in self.texts.items() for t in ts), key=lambda e: e[:2])
        self.entries = [e for e in entries if e[0]]
        self.sizes = [e[0] for e in self.entries]
        self.holding: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, grams) in enumerate(self.entries):
            for g in grams:
                self.holding.setdefault(g, []).append(i)
        self.words = {w for g in self.holding for w in g}
        # 2 min(n, m) / (n + m) >= least bounds the sizes that can match at all.
        ratio = self.least / (2 - self.least)
        self.shortest = math.ceil(self.sizes[0] * ratio - 1e-9) if self.sizes else 1
        self.longest = math.floor(self.sizes[-1] / ratio + 1e-9) if self.sizes and ratio else 0
        self.ratio = ratio

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The most similar template at or above the least score; of equals the first by name."""
        n = max(1, len(words) - 1) if words else 0
        if not self.shortest <= n <= self.longest:
            return None
        lo = bisect_left(self.sizes, math.ceil(n * self.ratio - 1e-9))
        hi = bisect_right(self.sizes, math.floor(n / self.ratio + 1e-9))
        if lo >= hi:
            return None
        grams = bigrams(words)
        near = {i for g in grams if g in self.holding for i in self.holding[g] if lo <= i < hi}
        scored = [(dice(grams, self.entries[i][2]), self.entries[i][1]) for i in near]
        scored = [s for s in scored if s[0] >= self.least - 1e-12]
        return min(scored, key=lambda s: (-s[0], s[1])) if scored else None

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """(licence, score) of the best block of each licence, best first."""
        found: dict[str, float] = {}
        if not text:
            return []
        lines = text.split("\n")
        # A line too long for any template only matters inside larger blocks, which are longer still.
        for block in {text, *_PARAGRAPH.split(text), *lines} if len(lines) > 1 else {text}:
            words = self._words_within(block)
            if words is not None and (hit := self.best(words)):
                found[hit[1]] = max(found.get(hit[1], 0.0), hit[0])
        if self.windows:
            for name, score in self._in_windows(normalise(text)):
                found[name] = max(found.get(name, 0.0), score)
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def _in_windows(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """Each template's best score over the windows of its size that reach the least score."""
        met: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for at, gram in enumerate(zip(words, words[1:])):
            for i in self.holding.get(gram, ()):
                met.setdefault(i, []).append((at, gram))
        for i, hits in met.items():
            size, name, grams = self.entries[i]
            # Windows at the end of a text may be shorter than the template.
            if len(hits) < math.ceil(size * self.ratio - 1e-9):
                continue
            best, shared, held, end = 0.0, 0, Counter(), 0
            for at, gram in hits:
                while end < len(hits) and hits[end][0] < at + size:
                    held[hits[end][1]] += 1
                    shared += held[hits[end][1]] <= grams[hits[end][1]]
                    end += 1
                best = max(best, 2 * shared / (size + min(size, len(words) - 1 - at)))
                shared -= held[gram] <= grams[gram]
                held[gram] -= 1
            if best >= self.least - 1e-12:
                yield name, best

    def _words_within(self, block: str) -> list[str] | None:
        """Words of a block, or None as soon as it is known to be too long or too strange."""
        words, strange = [], 0
        # Each word that no template has spoils a bigram, and a match of n bigrams
        # leaves at most n * (1 - least * (1 + ratio) / 2) of them unshared.
        allowed = (1 - self.least * (1 + self.ratio) / 2) * self.longest + 1e-9
        low = block.lower()
        if "copyright" in low or "(c)" in low or "\u00a9" in low:
            low = _COPYRIGHT.sub(" ", low)
        for m in _WORD.finditer(low):
            words.append(m[0])
            strange += m[0] not in self.words
            if len(words) > self.longest + 1 or strange > allowed:
                return None
        return words


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, templates: Templates | None = None) -> DataFrame:
    """The columns of `keep` with license, score, n_licenses and licenses.

    `license` and `score` name the best match, null where none reaches the
    least score; `licenses` lists all as name=score. Null and empty texts have
    none. One row out for each row in; kept columns must not be named like the
    outputs.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    known = templates or Templates(windows=True)
    schema = df.select(*cols, F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("n_licenses"), F.lit("").alias("licenses")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.scan(x.as_py()) for x in batch.column(len(keep))]
            made = [
                pa.array([f[0][0] if f else None for f in found], pa.string()),
                pa.array([f[0][1] if f else None for f in found], pa.float64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(f"{n}={s:.6f}" for n, s in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], schema.names)

    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
