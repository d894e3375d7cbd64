"""License scans by MinHash bands over overlapping windows.

Texts and templates become five-word shingles. Templates are put into classes by their number of
shingles, each class C a power of two. For a class, windows of 3C/2 shingles begin every C/2, so
that one of them holds any run of C shingles whole. A window that contains 0.8 of a template has a
Jaccard similarity of 1/4 at least to it, so with 48 bands of one MinHash each it is retrieved with
probability 1 - (3/4)^48 > 0.999998; for templates of one shingle, windows are single shingles and
retrieval is certain. The bands are an index: a window's MinHash is looked up among the sorted ones
of the class's templates, so the work hardly grows with their number; and the minima of a class's
windows come from those of the class below. Retrieved windows are only candidates: the words in and
around them, merged, are searched for the template's shingles, by their words. Where these stand is
cut into successive places: runs in the template's order that hold 0.8 of it first, then what is left
between those, so that moved or repeated passages count as well. A place may have C other shingles
between two of its own.

Templates are whole license texts, the notices that licenses ask for, and any others that are handed
in. One of fewer than five words is one shingle of its own length. Null and empty texts have no
shingles and give no rows; a text gives one row for each place of each template, and templates that
are parts of one another each their own. Repeated rows repeat their matches. Texts of any length are
worked through in pieces that overlap by a window. An empty table gives an empty result. Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from skein.llm import common

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 48
#: Notices that licenses ask for, and the texts of short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
    writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
    or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "BSD grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
    License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
    with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
    OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
    ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
    the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
    PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
    LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
    SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
    THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
    documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
    as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
    means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
    software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
    We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
    law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
    LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE.""",
}
#: Shingles that are worked on at once.
PIECE = 8192
#: Bits of a key by which it is looked for first.
FIRST_BITS = 18
_SHIFT = np.uint64(64 - FIRST_BITS)
_TRIM = b".,;:!?\"'()[]"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """Lower-case words without the marks around them; words of marks alone stay as they are."""
    return [w.strip(_TRIM) or w for w in text.encode("utf-8", "replace").translate(_LOWER).split()]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()
_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, (BANDS + SHINGLE,), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of width words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed += each[i : i + n] * _FACTORS[BANDS + i]
    return mixed ^ (mixed >> np.uint64(29))


class Template:
    def __init__(self, name: str, text: str):
        words = words_of(text)
        self.name = name
        if not words:
            raise ValueError(f"{name}: a template has a word at least")
        self.width = min(SHINGLE, len(words))
        #: Where each shingle stands in the template.
        self.shingles: dict[tuple, list[int]] = {}
        for i in range(len(words) - self.width + 1):
            self.shingles.setdefault(tuple(words[i : i + self.width]), []).append(i)
        self.size = len(self.shingles)
        self.group = 1 << (self.size - 1).bit_length()
        self.signature = (shingles_of(words, self.width)[None, :] * _FACTORS[:BANDS, None]).min(axis=1)


class Index:
    """By width, from small to large, the classes: their templates, and what each band's MinHashes lead to."""

    def __init__(self, known: list[Template]):
        self.known = known
        self.largest = max(t.group for t in known)
        self.classes: dict[int, dict[int, tuple[list[Template], np.ndarray, np.ndarray, np.ndarray]]] = {}
        for width, group in sorted({(t.width, t.group) for t in known}):
            own = [t for t in known if (t.width, t.group) == (width, group)]
            keys = self._keys(np.stack([t.signature for t in own], axis=1)[: 1 if group == 1 else BANDS])
            order = np.argsort(keys, kind="stable")
            # Most values aren't among the keys: their first bits say so at once.
            first = np.zeros(1 << FIRST_BITS, bool)
            first[keys >> _SHIFT] = True
            self.classes.setdefault(width, {})[group] = own, keys[order], order % len(own), first

    @staticmethod
    def _keys(hashes: np.ndarray) -> np.ndarray:
        """One number for band and MinHash; those of different bands that should be equal only make a candidate more."""
        return (hashes + np.arange(len(hashes), dtype=np.uint64)[:, None] * _FACTORS[-1]).ravel()

    def met(self, width: int, group: int, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(window, number of the template) wherever a band agrees; hashes: bands x windows."""
        _, keys, numbers, first = self.classes[width][group]
        values = self._keys(hashes)
        maybe = np.flatnonzero(first[values >> _SHIFT])
        out = set()
        for i, k in zip(maybe.tolist(), np.searchsorted(keys, values[maybe]).tolist()):
            while k < len(keys) and keys[k] == values[i]:  # templates that share a MinHash
                out.add((i % hashes.shape[1], int(numbers[k])))
                k += 1
        return out


@lru_cache(maxsize=4)
def templates(texts: tuple[tuple[str, str], ...]) -> Index:
    return Index([Template(*t) for t in texts])


def _windows(hashes: np.ndarray, groups: list[int]):
    """Of each class, smallest first: the class, MinHashes (bands x windows) of its windows, their step and length.

    The minima of steps are made once, for the smallest class; those of a larger one are minima of them.
    """
    if groups[0] == 1:
        yield 1, hashes[None, :] * _FACTORS[:1, None], 1, 1
        groups = groups[1:]
    if not groups:
        return
    step, most = 1, np.iinfo(np.uint64).max
    blocks = hashes[None, :] * _FACTORS[:BANDS, None]
    for group in groups:
        while step < group // 2:
            if blocks.shape[1] % 2:
                blocks = np.concatenate([blocks, np.full((BANDS, 1), most, np.uint64)], axis=1)
            blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            step *= 2
        wide = np.concatenate([blocks, np.full((BANDS, 2), most, np.uint64)], axis=1)
        yield group, np.minimum(np.minimum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:]), step, 3 * step


def _places(hits: list[tuple[int, tuple]], t: Template) -> list[tuple[int, int, float]]:
    """Successive places of a template: first word, word after the last, containment; hits are (word, shingle)."""
    need = CONTAINMENT * t.size

    def place(some):
        return some[0][0], some[-1][0] + t.width, len({s for _, s in some}) / t.size

    def anyhow(some):
        """Places in any order: the earliest end, the latest start of it, then what is new behind it."""
        out, lo, k, counts = [], 0, 0, {}
        while k < len(some):
            counts[some[k][1]] = counts.get(some[k][1], 0) + 1
            k += 1
            if len(counts) < need:
                continue
            while counts[some[lo][1]] > 1:
                counts[some[lo][1]] -= 1
                lo += 1
            while k < len(some) and some[k][1] not in counts:
                counts[some[k][1]] = 1
                k += 1
            out.append(place(some[lo:k]))
            lo, counts = k, {}
        return out

    def apart(some):
        cut = [0, *(i for i in range(1, len(some)) if some[i][0] - some[i - 1][0] > t.group + t.width), len(some)]
        return [some[i:j] for i, j in zip(cut, cut[1:]) if i < j]

    out = []
    for near in apart(hits):
        left, run, last = [], [], -1
        for hit in [*near, None]:
            later = [i for i in t.shingles[hit[1]] if i > last] if hit else []
            if run and not later:
                if len({s for _, s in run}) >= need:
                    for some in apart(left):
                        out += anyhow(some)
                    out.append(place(run))
                    left = []
                else:
                    left += run
                run = []
            if hit:
                run.append(hit)
                last = later[0] if later else t.shingles[hit[1]][0]
        for some in apart(left):
            out += anyhow(some)
    return out


def matches(text: str, index: Index) -> list[tuple[str, int, int, float]]:
    """(template, first word, word after the last, containment), by template and place."""
    words = words_of(text)
    met: dict[str, list[tuple[int, int]]] = {}
    jump = max(PIECE, 2 * index.largest)
    lengths = {}
    for width, classes in index.classes.items():
        every = shingles_of(words, width)
        lengths[width] = len(every)
        for lo in range(0, len(every), jump):
            piece = every[lo : lo + jump + 2 * index.largest]
            for group, hashes, step, length in _windows(piece, list(classes)):
                for w, number in index.met(width, group, hashes):
                    at = lo + w * step
                    around = 0 if group == 1 else length
                    met.setdefault(classes[group][0][number].name, []).append((at - around, at + length + around))
    out = []
    for t in sorted((t for t in index.known if t.name in met), key=lambda t: t.name):
        hits, done = [], 0
        for start, stop in sorted(met[t.name]):
            for i in range(max(start, done), min(stop, lengths[t.width])):
                s = tuple(words[i : i + t.width])
                if s in t.shingles:
                    hits.append((i, s))
            done = max(done, stop)
        out += [(t.name, *p) for p in _places(hits, t)]
    return out


def _scanned(texts: tuple[tuple[str, str], ...]):
    def run(batches):
        known = templates(texts)
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = matches(text, known)
                rows += got
                at += [i] * len(got)
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "license", "first_word", "end_word", "containment"])

    return run


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, end_word (exclusive), containment: a row for each place; staged."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    return common.mapped(rows, _scanned(tuple((texts or TEMPLATES).items())), f"doc_id {kind}, license string, first_word bigint, end_word bigint, containment double", "licenses")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return scan(common.table(spark, sf_dir, "documents"))
