"""License scans: MinHash bands over windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_words, mix, text_slices

#: Notices of public licenses, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Whole texts of short public licenses, by SPDX identifier.
FULL_TEXTS = [
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
]
#: What license_scan() looks for if nothing else is said.
TEMPLATES = [*NOTICES, *FULL_TEXTS]
#: Words of a shingle (the shortest notices have five words), share of a template's shingles that a match must hold.
WORDS, CONTAINED = 3, 0.8
#: Chance that a window around a match collides with its template in some band, at least.
SURE = 0.999
#: Shingles of the shortest blocks; a window is two blocks, and blocks double from class to class.
BLOCK = 4

_SAME = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def shingles(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in order, and how many each has. Words are runs of letters, digits and other than ASCII
    characters, A-Z lower-cased."""
    split = [t.translate(_SAME).split() if t else [] for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    w = hash_words([x for s in split for x in s])
    h = w.copy()
    for j in range(1, words):
        m = max(0, len(w) - j)
        h[:m] = mix(h[:m] + np.uint64(j)) + w[j:]
    owner = np.repeat(np.arange(len(split)), counts)
    last = np.cumsum(counts)[owner] if len(owner) else owner
    keep = np.arange(len(w)) + words <= last
    return h[keep], np.maximum(0, counts - words + 1)


def bands_needed(contained: float = CONTAINED, sure: float = SURE) -> int:
    """One hash a band: a template of over half a block, held to the share contained in a window of two blocks, has a Jaccard similarity
    of contained / (5 - contained) at least, which is the chance of a collision in each band."""
    least = contained / (5 - contained)
    return math.ceil(math.log(1 - sure) / math.log(1 - least))


@dataclass(frozen=True)
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    sizes: list[int]
    words: int
    contained: float
    bands: int

    @classmethod
    def of(cls, notices: list[tuple[str, str]], words: int = WORDS, contained: float = CONTAINED) -> Templates:
        flat, counts = shingles([t.encode() for _, t in notices], words)
        parts = np.split(flat, np.cumsum(counts)[:-1])
        if min(map(len, parts), default=1) < 1:
            raise ValueError(f"a template has fewer than {words} words")
        return cls([n for n, _ in notices], [np.unique(p) for p in parts], [len(p) for p in parts], words, contained, bands_needed(contained))

    def salt(self, band: int) -> np.uint64:
        return mix(np.array([band + 1], np.uint64))[0]

    @cached_property
    def keys(self) -> list[dict[tuple[int, int], list[int]]]:
        """For each class of block lengths: (band, least hash) to templates."""
        found: list[dict] = []
        for k, (s, n) in enumerate(zip(self.sets, self.sizes, strict=True)):
            c = max(0, math.ceil(math.log2(n / BLOCK)))
            while len(found) <= c:
                found.append({})
            for band in range(self.bands):
                found[c].setdefault((band, int(mix(s ^ self.salt(band)).min())), []).append(k)
        return found

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, float, int]]:
        """text, template, share of the template's shingles, first word: the best window for each text and template."""
        flat, counts = shingles(texts, self.words)
        if not len(flat):
            return
        ends = np.cumsum(counts)
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(counts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        base = (ends - counts)[owner] + nth * BLOCK
        keys, candidates = self.keys, set()
        for band in range(self.bands):
            low = np.minimum.reduceat(mix(flat ^ self.salt(band)), base)
            o, at = owner, nth
            for c, table in enumerate(keys):
                nxt = low.copy()
                same = np.flatnonzero(o[1:] == o[:-1])
                nxt[same] = np.minimum(low[same], low[same + 1])
                wanted = [h for b, h in table if b == band]
                if wanted:
                    for i in np.flatnonzero(np.isin(nxt, np.array(wanted, np.uint64))).tolist():
                        candidates.update((int(o[i]), k, c, int(at[i])) for k in table[band, int(nxt[i])])
                even = np.flatnonzero(at % 2 == 0)  # blocks of the next class
                low, o, at = nxt[even], o[even], at[even] // 2
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for i, k, c, b in sorted(candidates):
            size = BLOCK << c
            lo = int(ends[i] - counts[i]) + b * size
            part = flat[lo : min(lo + 2 * size, int(ends[i]))]
            hit = np.flatnonzero(np.isin(part, self.sets[k]))
            share = len(np.unique(part[hit])) / len(self.sets[k])
            if share >= self.contained and share > best.get((i, k), (0.0, 0))[0]:
                best[i, k] = share, b * size + int(hit[0])
        for (i, k), (share, word) in sorted(best.items()):
            yield i, k, share, word


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] = TEMPLATES, words: int = WORDS, contained: float = CONTAINED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, template, license, containment, word: a row for each template (its number in notices) that a document holds to the share contained.

    A text's shingles are cut into blocks; two neighbouring blocks make a window, so windows overlap by half and any stretch as long as a
    block lies in one. Blocks are as long as a template (a power of two of them), for each class of template lengths. A window and a
    template that agree in the least hash of a band are compared by their shingles; bands are as many as find a match with probability
    SURE; those that collide are verified by their shingles, so a match is missed with a chance of 1 - SURE at most and none is made up. word is
    the first word in the best window that begins a shingle of the template; of windows equally good the first counts.

    Whole texts are scanned where they are, nothing is shuffled. Nulls, empty texts and texts of fewer than words words hold nothing.
    Repeated rows and null doc_ids are each scanned; other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    t = Templates.of(notices, words, contained)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b.column(1)):
                found = list(t.scan(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo + i] for i, *_ in found], pa.int64()), pa.array([k for _, k, *_ in found], pa.int32()), pa.array([t.names[k] for _, k, *_ in found], pa.string()), pa.array([s for *_, s, _ in found], pa.float64()), pa.array([w for *_, w in found], pa.int64())],
                    names=["doc_id", "template", "license", "containment", "word"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, template int, license string, containment double, word long")
