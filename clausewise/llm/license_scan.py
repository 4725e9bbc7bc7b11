"""License scans: passages of a text compared with licence templates by the Dice coefficient over word bigrams.

Normalised text is its runs of letters and digits in lower case. A template with ``a`` bigrams can reach a Dice
coefficient of ``threshold`` (t) only with passages of a * t / (2 - t) to a * (2 - t) / t bigrams, and only if at least
t * a / (2 - t) of its bigrams occur: templates with fewer hits in a text are pruned, and passages grow from hit to hit
within the upper bound only. Of overlapping finds the best one stands (ties: the longer, then the earlier, then the
template's name), so one text may carry several licences. Texts are scanned whole.

The templates are a fixed list, broadcast with the function; documents are independent rows, so there is no exchange.

Defined results: a null or empty text has no finds. Repeated rows are scanned alike. An empty table gives an empty table.
Extra columns never matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
TOKEN = re.compile(r"[^\W_]+")

# Licence notices and texts, by identifier and form.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/released": "Released under the Apache License, Version 2.0.",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause/notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause/notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0/header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0/notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0/notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0/sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
TEMPLATES |= {f"{name}-3.0/header": TEMPLATES["GPL-3.0/header"].replace("GNU General", f"GNU {word} General") for name, word in (("AGPL", "Affero"), ("LGPL", "Lesser"))}


def normalise(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD):
        self.t = threshold
        self.names: list[str] = []
        self.grams: list[Counter] = []
        self.sizes: list[int] = []
        self.index: dict[tuple[str, str], list[int]] = {}
        for name, text in sorted((TEMPLATES if templates is None else templates).items()):
            words = normalise(text)
            grams = Counter(zip(words, words[1:], strict=False))
            if not grams:
                raise ValueError(f"template {name} has no word bigram")
            for g in grams:
                self.index.setdefault(g, []).append(len(self.names))
            self.names.append(name)
            self.grams.append(grams)
            self.sizes.append(sum(grams.values()))

    def _passages(self, k: int, hits: list[tuple[int, tuple[str, str]]]) -> list[tuple[float, int, int]]:
        """(Dice, first bigram, bigrams) of passages that begin and end at hits and reach the threshold."""
        grams, a, t = self.grams[k], self.sizes[k], self.t
        low, high = a * t / (2 - t), a * (2 - t) / t
        out = []
        for i, (begin, _) in enumerate(hits):
            if i + low > len(hits) + 1e-9:
                break
            seen: Counter = Counter()
            both = 0
            best = (0.0, 0)
            for at, g in hits[i:]:
                b = at - begin + 1
                if b > high + 1e-9:
                    break
                seen[g] += 1
                both += seen[g] <= grams[g]
                if both >= low - 1e-9:
                    best = max(best, (2 * both / (a + b), b))
            if best[0] >= t - 1e-12:
                out.append((best[0], begin, best[1]))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first word, words) of the finds, in text order."""
        words = normalise(text or "")
        index = self.index
        hits: dict[int, list] = {}
        for at, g in enumerate(zip(words, words[1:], strict=False)):
            if g in index:
                for k in index[g]:
                    hits.setdefault(k, []).append((at, g))
        found = []
        for k, own in hits.items():
            if len(own) >= self.sizes[k] * self.t / (2 - self.t) - 1e-9:
                found += [(-d, -b, at, self.names[k]) for d, at, b in self._passages(k, own)]
        taken: list[tuple[int, int]] = []
        out = []
        for d, b, at, name in sorted(found):
            if all(at - b < x or at > y for x, y in taken):
                taken.append((at, at - b))
                out.append((name, -d, at, -b + 1))
        return sorted(out, key=lambda x: x[2])


FINDS = "array<struct<template:string,dice:double,start:int,end:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, finds: template, Dice coefficient and character span (start, end) of each passage, in text order."""
    scanner = Scanner(templates, threshold)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = scanner.scan(text)
                if found:
                    # lower case may change a text's length, so spans come from the folded characters one by one
                    spans = [m.span() for m in TOKEN.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in text))]
                    found = [{"template": n, "dice": d, "start": spans[min(at, len(spans) - 1)][0], "end": spans[min(at + w, len(spans)) - 1][1]} for n, d, at, w in found]
                rows.append(found)
            yield pd.DataFrame({"id": pdf["id"], "finds": rows})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, finds {FINDS}")
