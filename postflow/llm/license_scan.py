"""Licence scans: units of text compared to licence templates by the Dice coefficient over their word bigrams.

Units are the sentences, the lines, the paragraphs (lines between blank ones) and the whole of a text. Words are lower-cased and lose
outer punctuation. For a unit X and a template T, dice = 2 |X & T| / (|X| + |T|); as |X & T| is at most the smaller size, only templates
with t/(2-t) |T| <= |X| <= (2-t)/t |T| are compared, and units without any bigram of any template are dropped first.

Defined cases: a null text, and one without two words, matches nothing; of equal scores the template that sorts first wins, then the
earliest and shortest unit; null ids are kept; repeated rows, and rows with one id and other texts, are scanned each by its own text;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, U64, cores, mix64, per_row, ranges, segment_hash, sentence_breaks, slices, utf8, words

#: Licences: notices and whole texts of short ones as their stewards word them, and (short) forms as documents write them. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (notice)": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 (short)": "Licensed under the GNU General Public License, version 3 or later.",
    "ISC (text)": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT (notice)": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT (text)": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause (text)": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib (text)": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense (text)": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
        "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
OUT = "doc_id bigint, n_units bigint, license string, dice double, start bigint, end bigint, matches array<struct<license:string,dice:double,start:bigint,end:bigint>>"


def bigrams(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Buffer, offsets, word starts, ends, rows, and the hash of each word and the next of its row (the last: 0)."""
    buf, offs = utf8(column)
    starts, ends, row, _ = words(buf, offs)
    h = segment_hash(LOWER[buf], *cores(buf, starts, ends))
    pair = np.zeros(len(h), U64)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            pair[:-1] = np.where(row[1:] == row[:-1], mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) | U64(1), U64(0))
    return buf, offs, starts, ends, row, pair


def units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each unit, distinct."""
    if not len(ends):
        z = np.zeros(0, np.int64)
        return z, z
    lines = per_row(buf == 10, ends, np.r_[starts[1:], ends[-1]])
    final = np.r_[row[1:] != row[:-1], True]
    found = []
    for last in (sentence_breaks(buf, starts, ends, row), final | (lines > 0), final | (lines > 1), final):
        at = np.flatnonzero(last)
        found.append(np.stack([np.r_[0, at[:-1] + 1], at], 1))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: how many units match a template, the best match (name, dice, byte offsets), null without one, and all of them, best first."""
    names = sorted(templates)

    def template_sets() -> list[np.ndarray]:
        pair, row = (lambda x: (x[5], x[4]))(bigrams(pa.array([templates[k] for k in names], pa.string())))
        return [np.unique(pair[(row == i) & (pair != 0)]) for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = template_sets()
        known = np.unique(np.concatenate([*sets, np.zeros(0, U64)]))
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs, starts, ends, row, pair = bigrams(part.column("text"))
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = (known[at] == pair) & (pair != 0) if len(known) else np.zeros(len(pair), bool)
                a, b = units(buf, starts, ends, row)
                some = np.flatnonzero(per_row(hit, a, b) > 0)
                a, b = a[some], b[some]
                # distinct bigrams of each unit: pairs that start before its last word
                size = b - a
                of, val = np.repeat(np.arange(len(a)), size), pair[ranges(a, size)]
                order = np.lexsort((val, of))
                of, val = of[order], val[order]
                new = np.r_[True, (of[1:] != of[:-1]) | (val[1:] != val[:-1])][: len(of)]
                of, val = of[new], val[new]
                n = np.bincount(of, minlength=len(a))
                best, name = np.zeros(len(a)), np.full(len(a), -1)
                for k, own in enumerate(sets):
                    m = len(own)
                    fits = (n * (2 - threshold) >= threshold * m) & (n * threshold <= (2 - threshold) * m) & (n > 0)
                    if not m or not fits.any():
                        continue
                    place = np.minimum(np.searchsorted(own, val), m - 1)
                    both = np.bincount(of, (own[place] == val) & fits[of], len(a))
                    dice = np.where(fits, 2 * both / np.maximum(n + m, 1), 0.0)
                    better = dice > best
                    best, name = np.where(better, dice, best), np.where(better, k, name)
                ok = np.flatnonzero(best >= threshold)
                doc = row[a[ok]]
                order = np.lexsort((b[ok], a[ok], name[ok], -best[ok], doc))
                ok, doc = ok[order], doc[order]
                head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
                pick = np.full(part.num_rows, -1)
                pick[doc[head]] = ok[head]
                hits = [None if p < 0 else int(p) for p in pick]
                origin = offs[:-1]
                cut = np.r_[0, np.cumsum(np.bincount(doc, minlength=part.num_rows))].astype(np.int32)
                every = [pa.array([names[k] for k in name[ok]], pa.string()), pa.array(best[ok]), pa.array(starts[a[ok]] - origin[doc], pa.int64()), pa.array(ends[b[ok]] - origin[doc], pa.int64())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_units": pa.array(np.bincount(doc, minlength=part.num_rows)),
                        "license": pa.array([None if p is None else names[name[p]] for p in hits], pa.string()),
                        "dice": pa.array([None if p is None else float(best[p]) for p in hits], pa.float64()),
                        "start": pa.array([None if p is None else int(starts[a[p]] - origin[i]) for i, p in enumerate(hits)], pa.int64()),
                        "end": pa.array([None if p is None else int(ends[b[p]] - origin[i]) for i, p in enumerate(hits)], pa.int64()),
                        "matches": pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(every, names=["license", "dice", "start", "end"])),
                    }
                )

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, OUT)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("dice", F.round("dice", 6)).withColumn("matches", F.transform("matches", lambda x: x.withField("dice", F.round(x["dice"], 6))))
