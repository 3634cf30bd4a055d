"""License scan: Dice coefficient over word bigrams against license templates.

Text is normalised to lower-case words without marks. Licenses are looked for within reach of the words that license notices have (the anchors).
There, the stretches are compared with the templates whose number of bigrams can reach the threshold at all: Dice d of sizes a and b needs
b (d / (2 - d)) <= a <= b ((2 - d) / d). The window as long as the template that has the highest coefficient, trimmed or
grown by a word at a time while that helps, is reported where it reaches the threshold.

What lies before and after a window is looked through anew, so every copy of a notice is found. A window within another of the same license (a notice in
the whole text) gives way to it; others that overlap are taken by the highest coefficient, of equal ones the longest, then the first by name. What a
window that is not taken leaves free is looked through again.

Results: a null or empty text has no licenses; all windows are reported that are taken; long texts are looked through whole; repeated rows are each
reported; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import id_and_text, map_batches, texts_of

THRESHOLD = 0.8
#: Longest stretch, in words, that is compared at once; longer ones are worked off in overlapping parts.
PART = 4096

#: Notices by which public licenses are commonly applied, and the whole texts of the short ones, under their SPDX names. Those of long ones come from files: see `read_texts`.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Proprietary": ("All rights reserved.",),
}
ANCHORS = frozenset("license licensed licenses licence licensing sublicense copyright redistribution redistributions permission gnu apache mozilla reserved unencumbered waived".split())
_HINTS = ("licen", "copyright", "redistribution", "permission", "gnu", "apache", "mozilla", "reserved", "unencumbered", "waived")
_WORD = re.compile(r"\w+(?:\.\w+)*")
Gram = tuple[str, str]


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words and where each stands. Only ASCII letters are lower-cased, so places stay those of the text."""
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        self.name, self.words = name, words_of(text)[0]
        self.n = len(self.words)
        self.grams = Counter(zip(self.words, self.words[1:]))
        self.size = max(0, self.n - 1)
        self.least, self.most = self.size * threshold / (2 - threshold), self.size * (2 - threshold) / threshold
        self.anchors = ANCHORS & {*self.words} or frozenset(self.words)


def read_texts(paths: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """The templates, with whole license texts beside them. paths: files of the driver by SPDX name, such as the folder of common licenses that a system keeps; their texts go to the tasks."""
    found = dict(TEMPLATES)
    for name, path in paths.items():
        with open(path, encoding="utf-8", errors="replace") as file:
            found[name] = (*found.get(name, ()), file.read())
    return found


@functools.lru_cache(maxsize=4)
def templates_of(threshold: float, own: tuple[tuple[str, tuple[str, ...]], ...] | None = None) -> list[Template]:
    out = [Template(name, text, threshold) for name, texts in (own or tuple(TEMPLATES.items())) for text in texts]
    return [t for t in out if t.size > 0]


def best_window(words: list[str], template: Template, threshold: float) -> tuple[float, int, int] | None:
    """(coefficient, first word, end) of the best window of a stretch: that as long as the template, then trimmed or grown by a word at a time while this helps."""
    n = len(words)
    if n - 1 < template.least:
        return None
    width = min(template.n, n)
    grams = [g if g in template.grams else None for g in zip(words, words[1:])]
    # a window of a bigrams at the threshold shares threshold * (a + size) / 2 of them at least, and a is `least` at least
    if 2 * sum(g is not None for g in grams) < threshold * (template.least + template.size) - 1e-9:
        return None
    inside, shared, best = Counter(), 0, (0.0, 0, 0)

    def enter(g: Gram | None) -> int:
        if g is None:
            return 0
        inside[g] += 1
        return int(inside[g] <= template.grams[g])

    def leave(g: Gram | None) -> int:
        if g is None:
            return 0
        inside[g] -= 1
        return -int(inside[g] < template.grams[g])

    for i in range(len(grams)):
        shared += enter(grams[i])
        if i >= width - 1:
            shared += leave(grams[i - width + 1])
        if i >= width - 2 and (d := 2 * shared / (width - 1 + template.size)) > best[0]:
            best = (d, i - width + 2, i + 2)
    d, start, end = best
    if not d:
        return None

    def value(a: int, z: int) -> float:
        return dice(Counter(zip(words[a:z], words[a + 1 : z])), template.grams) if z - a > 1 else 0.0

    better = True
    while better:
        better = False
        for a, z in ((start + 1, end), (start, end - 1), (start - 1, end), (start, end + 1)):
            if 0 <= a < z <= n and (v := value(a, z)) > d + 1e-12:
                d, start, end, better = v, a, z, True
    return (d, start, end) if d >= threshold else None


def all_windows(words: list[str], template: Template, threshold: float) -> list[tuple[float, int, int]]:
    """The best window of a stretch, then those of what lies before and after it, and so on: none overlap."""
    out, todo = [], [(0, len(words))]
    while todo:
        a, z = todo.pop()
        if template.anchors.isdisjoint(words[a:z]) or not (w := best_window(words[a:z], template, threshold)):
            continue
        d, s, e = w
        out.append((d, a + s, a + e))
        todo += [(a, a + s), (a + e, z)]
    return out


def stretches(hits: list[int], reach: int, n: int) -> list[tuple[int, int]]:
    """Parts of 0..n within `reach` of a hit; what is longer than PART is cut into parts that overlap by twice the reach."""
    out: list[list[int]] = []
    for h in hits:
        a, z = max(0, h - reach), min(n, h + reach + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    step = max(PART, 4 * reach)
    return [(at, min(z, at + step)) for a, z in out for at in range(a, max(a + 1, z - 2 * reach), step - 2 * reach)]


def licenses_of(text: str, threshold: float = THRESHOLD, own: tuple | None = None) -> list[tuple[str, float, int, int]]:
    """(name, coefficient, start, end) in code points of each license found, by start and name."""
    templates = templates_of(threshold, own)
    if all(t.anchors <= ANCHORS for t in templates):
        low = text.lower()
        if not any(h in low for h in _HINTS):
            return []
    words, places = words_of(text)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    taken: list[tuple[str, float, int, int]] = []
    queue = [(t, a, z) for t in templates for a, z in stretches(sorted(i for x in t.anchors for i in at.get(x, ())), int(t.most) + 2, len(words))]
    while queue:
        found = {(t.name, d, a + s, a + e): t for t, a, z in queue for d, s, e in all_windows(words[a:z], t, threshold)}
        queue, lost, inside = [], [], _inside(found)
        for x in sorted(found, key=lambda x: (-x[1], x[2] - x[3], x[0], x[2])):
            if x not in inside and all(x[2] >= y[3] or y[2] >= x[3] for y in taken):
                taken.append(x)
            else:
                lost.append(x)
        # a window that lost to another may have hidden one beside it: its template looks through what is free around it
        for x in lost:
            t = found[x]
            queue += [(t, a, z) for a, z in _free(taken, x[2] - int(t.most) - 2, x[3] + int(t.most) + 2, len(words)) if z - a > t.least]
        queue = list(dict.fromkeys(queue))
    return sorted(((n, d, places[s][0], places[e - 1][1]) for n, d, s, e in taken), key=lambda x: (x[2], x[0]))


def _inside(windows: Iterable[tuple[str, float, int, int]]) -> set[tuple[str, float, int, int]]:
    """Those that lie within a longer one of the same license."""
    out, reach = set(), {}
    for x in sorted(windows, key=lambda x: (x[2], -x[3])):
        start, end = reach.get(x[0], (0, -1))
        if x[3] <= end and (x[2], x[3]) != (start, end):
            out.add(x)
        elif x[3] > end:
            reach[x[0]] = x[2], x[3]
    return out


def _free(taken: list[tuple[str, float, int, int]], a: int, z: int, n: int) -> list[tuple[int, int]]:
    """What no window that is taken holds of a..z."""
    out, at = [], max(0, a)
    for _, _, s, e in sorted(taken, key=lambda x: x[2]):
        if e > at and s < min(z, n):
            out.append((at, s))
            at = e
    return [(s, e) for s, e in [*out, (at, min(z, n))] if e > s]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, own: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, licenses array<struct<license, dice, start, end>>: one row per document, an empty list where there is none."""
    templates = tuple(own.items()) if own else None
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"license": n, "dice": d, "start": s, "end": e} for n, d, s, e in licenses_of(t, threshold, templates)] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "licenses"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, licenses array<struct<license:string,dice:double,start:int,end:int>>")


def report(found: DataFrame) -> DataFrame:
    """A row for each license of each document that has one."""
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.license", "x.dice", "x.start", "x.end")
