"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are words (letters A-Z in lower case, digits and all beyond ASCII) and five-word shingles. For each template
length w, windows of w + step - 1 words start every step = max(1, w / 4) words, so every stretch of w words lies inside a
window. If a window holds 0.8 of a template's shingles, its Jaccard similarity to it is 0.5 or more, and with
``BANDS`` bands of ``ROWS`` MinHashes each, the two share a band with a probability of at least
1 - (1 - 0.5**2)**32 > 0.9998 (over the choice of hash functions). What is retrieved is verified on the words themselves.

A window without any template shingle has similarity 0 and cannot share a band, so it is passed over unhashed; this
keeps the scan to one look-up per shingle. One narrow pass; the templates are broadcast in blocks of at most ``BLOCK_BYTES`` of text, and each text is
held against every block.

``TEMPLATES`` holds the texts of short licenses, the standard notices and opening passages of long ones and usual one-line statements; the full texts of
long licenses can be given as ``templates``. A text that holds a longer license with a shorter one's wording in it (three clauses and two) matches both.

Defined results: null and empty texts and those of fewer than five words match nothing; repeated rows are scanned one by one; null ids
are kept; texts of any length are read whole; no templates give no matches; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import LOWER, joined, mix, read, settled, steps, texts, word_hashes, word_runs

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2
BLOCK_BYTES = 16 << 20

# Notices by which texts state their license.
_BSD_BODY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."


def _gnu(what: str, name: str, version: str, either: str = ";") -> str:
    return f"{what} is free software{either} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"


TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": _gnu("This program", "GNU Affero General Public License", "3"),
    "AGPL-3.0-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-distributed": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "Apache-2.0-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Artistic-2.0": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": _BSD_BODY + _BSD_END,
    "BSD-3-Clause": "licensed under the 3-Clause BSD License",
    "BSD-3-Clause-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-3-Clause-text": _BSD_BODY + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "EPL-2.0-text": "The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this Agreement",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": _gnu("This program", "GNU General Public License", "3", ":"),
    "GPL-preamble": "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program",
    "GPL-warranty": _GNU_REST.format("General Public License"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": _gnu("This library", "GNU Lesser General Public License", "3"),
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-project": "This project is licensed under the terms of the MIT license",
    "MIT-text": _MIT_BODY + _MIT_END,
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-warranty": _MIT_END,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "PublicDomain": "This work has been released into the public domain",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Unlicense-text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def geometry(n_words: int) -> tuple[int, int]:
    """(window, step) in words for templates of ``n_words``."""
    step = max(1, n_words // 4)
    return n_words + step - 1, step


def _shingles(word: np.ndarray) -> np.ndarray:
    n = len(word) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0xC6A4A7935BD1E995) + word[j : j + n]
    return mix(h)


def contained(template: list[bytes], window: list[bytes]) -> float:
    """The share of the template's shingles that the window has, on the words themselves."""
    own = {tuple(template[i : i + SHINGLE]) for i in range(len(template) - SHINGLE + 1)}
    there = {tuple(window[i : i + SHINGLE]) for i in range(len(window) - SHINGLE + 1)}
    return len(own & there) / len(own) if own else 0.0


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: words_of(text.encode()) for name, text in templates.items()}
        self.words = {name: w for name, w in sorted(self.words.items()) if len(w) >= SHINGLE}
        draw = np.random.Generator(np.random.PCG64(7))
        self.factors = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.classes: dict[int, dict[tuple[int, int], list[str]]] = {}
        every = []
        for name, words in self.words.items():
            buf = np.frombuffer(b" ".join(words) + b" ", np.uint8)
            hashes = _shingles(word_hashes(buf, *word_runs(buf)))
            every.append(hashes)
            bands = self.classes.setdefault(len(words), {})
            for key in self.bands(hashes):
                bands.setdefault(key, []).append(name)
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def bands(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        least = (mix(hashes[:, None] * self.factors + self.shifts)).min(0).reshape(BANDS, ROWS)
        keys = least[:, 0]
        for r in range(1, ROWS):
            keys = mix(keys * np.uint64(31) + least[:, r])
        return list(enumerate(keys.tolist()))

    def find(self, words: list[bytes], hashes: np.ndarray, hits: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first word, end, containment) in one text; ``hits`` are the places of its template shingles."""
        found = []
        for length, bands in self.classes.items():
            size, step = geometry(length)
            last = max(0, len(words) - length)
            starts = {s * step for h in hits.tolist() for s in range(max(0, -(-(h + SHINGLE - size) // step)), h // step + 1)}
            for start in sorted(s for s in starts if s <= last):
                own = hashes[start : max(start + 1, min(start + size, len(words)) - SHINGLE + 1)]
                names = {n for key in self.bands(own) for n in bands.get(key, ())}
                for name in sorted(names):
                    share = contained(self.words[name], words[start : start + size])
                    if share >= CONTAINMENT:
                        found.append((name, start, min(start + size, len(words)), share))
        return merged(found)


def merged(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Overlapping windows of one template as one match: where they all overlap, and the largest share."""
    out: list[tuple[str, int, int, float]] = []
    for name, a, b, share in sorted(found):
        if out and out[-1][0] == name and a < out[-1][2]:
            out[-1] = (name, max(a, out[-1][1]), min(b, out[-1][2]), max(share, out[-1][3]))
        else:
            out.append((name, a, b, share))
    return sorted(out, key=lambda m: (m[1], m[0]))


def template_blocks(templates: dict[str, str], size: int = BLOCK_BYTES) -> list[TemplateIndex]:
    """Indexes of at most ``size`` bytes of templates each (one longer template excepted)."""
    blocks, total = [{}], 0
    for name, text in sorted(templates.items()):
        if blocks[-1] and total + len(text) > size:
            blocks.append({})
            total = 0
        blocks[-1][name] = text
        total += len(text)
    return [TemplateIndex(b) for b in blocks]


MATCHES = "doc_id long, n_words long, matches array<struct<license:string,start:int,stop:int,containment:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, matches) of every row; places are words."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(x) for x in template_blocks(TEMPLATES if templates is None else templates, block_bytes)]
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64())]))

    def scan(batches):
        for batch in batches:
            values = texts(batch.column(1))
            n_words, matches = [], []
            for begin, end in steps(values):
                buf, row_ends = joined(values, begin, end)
                low = LOWER[buf]
                starts, ends = word_runs(low, _BREAK)
                first = np.searchsorted(starts, np.concatenate([[0], row_ends]))
                hashes = _shingles(word_hashes(low, starts, ends))
                found: dict[int, list] = {}
                for block in shared:
                    index = block.value
                    near = np.flatnonzero(index.bitmap[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                    near = near[np.isin(hashes[near], index.known)]
                    row = np.searchsorted(first, near, "right") - 1
                    inside = near + SHINGLE <= first[row + 1]
                    near, row = near[inside], row[inside]
                    cuts = np.flatnonzero(np.diff(row)) + 1
                    for hits in np.split(near, cuts) if len(near) else ():
                        r = int(np.searchsorted(first, hits[0], "right")) - 1
                        a, b = int(first[r]), int(first[r + 1])
                        words = [low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                        found.setdefault(r, []).extend(index.find(words, hashes[a : b - SHINGLE + 1], hits - a))
                n_words += np.diff(first).tolist()
                matches += [[dict(zip(("license", "start", "stop", "containment"), m, strict=True)) for m in sorted(found.get(r, ()), key=lambda m: (m[1], m[0]))] for r in range(end - begin)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(settled(scan), MATCHES)


def op5_licenses(spark, sf_dir):
    found = scan_licenses(read(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"]))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
