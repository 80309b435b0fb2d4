"""License scans: which license texts a document contains, by DataFrame functions alone.

Templates and documents become words (a-z and 0-9 in lower case; all else separates). Templates of like length form a
class with windows of its own: ``span`` words and a step of a quarter, so each occurrence of a template lies whole in
one window. MinHash bands of one row each retrieve the templates of a window; their number follows from the least
Jaccard similarity that a sufficient match can have in its window, so that it is missed with a probability under
``miss``. Exact containment of the template's shingles in the window then decides.

Before the bands a lossless sieve: words of each template, the longest first, that lie in more of its shingles than a
match may lack. A document or window without any of these words holds no match.

Nulls: null texts hold nothing; templates without a word or an id are not used. Templates shorter than a shingle are one
shingle of all their words. Repeated documents each give their rows (a row per id and template); an empty table or no
templates give no rows. Texts of any length are read whole; of windows that match equally well the result is the same.
Templates are collected to make the sieve, about ``most`` in a pass, counted first; more go in further passes over the
documents, so that neither a broadcast nor a plan grows with their number.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, written

SHINGLE = 5
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_SHALL_NOT = "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
#: Names and usual wordings of public license notices; complete short licenses, headers of long ones,
#: one-line grants and tags.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    *((f"SPDX-{x}", f"SPDX-License-Identifier: {x}") for x in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0")),
    (
        "MIT-full",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause-full", f"{_CONDITIONS} This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. {_SHALL_NOT}"),
    ("BSD-3-Clause-third", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (
        "Apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-header", _GNU.format("", "3")),
    ("GPL-2.0-header", _GNU.format("", "2")),
    ("LGPL-header", _GNU.format("Lesser ", "2.1")),
    ("AGPL-header", _GNU.format("Affero ", "3")),
    ("GPL-no-warranty", _NO_WARRANTY.format("")),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("BSL-1.0-header", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text.cast("string")), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` words."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    return F.when(F.size(words) >= size, F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, size))))).otherwise(F.array().cast("array<string>"))


def bands_of(shingles: Column, bands: int) -> Column:
    """The minwise hash of the shingles under each of ``bands`` seeds."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, j))))


def classes(lengths: dict[int, int]) -> dict[int, int]:
    """The class (largest length, a step of a quarter apart) of each template length in words."""
    out, top = {}, 0
    for n in sorted(lengths, reverse=True):
        if not top or n < min(top, SHINGLE) or n < 0.8 * top:
            top = n
        out[n] = top
    return out


def band_count(least: int, window: int, containment: float, miss: float) -> int:
    """Bands so that a match of a template with ``least`` shingles, in a window with ``window`` of them, is missed with
    a probability of at most ``miss``."""
    shared = math.ceil(containment * least - 1e-9)
    similarity = shared / (window + least - shared)
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def sieve_words(shingles: list[str], containment: float, known: frozenset[str] = frozenset()) -> set[str]:
    """Words so that any sufficient share of the shingles has one of them; those ``known`` from other templates first."""
    left, chosen = [s.split(" ") for s in shingles], set()
    spare = len(shingles) - math.ceil(containment * len(shingles) - 1e-9)
    for word in sorted({w for s in left for w in s}, key=lambda w: (w not in known, -len(w), w)):
        if len(shingles) - len(left) > spare:
            break
        chosen.add(word)
        left = [s for s in left if word not in s]
    return chosen


def sieve_by(templates: list[list[str]], containment: float) -> list[set[str]]:
    """The sieve words of each template, shared where one serves several: the shortest templates choose first."""
    known, out = set(), {}
    for k in sorted(range(len(templates)), key=lambda k: (len(templates[k]), templates[k])):
        out[k] = sieve_words(templates[k], containment, frozenset(known))
        known |= out[k]
    return [out[k] for k in range(len(templates))]


def license_scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", template: str = "template_id", template_text: str = "text", containment: float = 0.75, miss: float = 1e-5, most: int = 200) -> DataFrame:
    """(doc_id, template_id, n_shared, n_shingles, containment) of each template that a window of the document holds:
    the most shingles shared in one window, those of the template, and their ratio."""
    result = "doc_id long, template_id string, n_shared int, n_shingles int, containment double"
    spark = docs.sparkSession
    known = templates.select(F.col(quoted(template)).cast("string").alias("template_id"), words_of(F.col(quoted(template_text))).alias("w")).where("template_id is not null and size(w) > 0")
    known = known.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE))).withColumn("shingles", shingles_of(F.col("w"), F.col("k")))
    if most < 1:
        raise ValueError("a pass takes a template at least")
    count = known.count()
    # windows follow from the lengths of all templates, so that the result does not depend on the passes
    top = classes({r.n: 1 for r in known.select(F.size("w").alias("n")).distinct().collect()})
    parts = 1 if count <= most else math.ceil(1.5 * count / most)
    found = None
    for part in range(parts if count else 0):
        rows = (known if parts == 1 else known.where(F.pmod(F.xxhash64("template_id", "shingles"), F.lit(parts)) == part)).collect()
        if rows:
            some = _matches(docs, rows, top, key, text, containment, miss)
            found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], result)
    best = found.groupBy("doc_id", "template_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.select("doc_id", "template_id", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def _matches(docs: DataFrame, rows: list, top: dict[int, int], key: str, text: str, containment: float, miss: float) -> DataFrame:
    """(doc_id, template_id, n_shared, n_shingles) of the windows that hold one of these templates."""
    spark = docs.sparkSession
    sieves = sieve_by([r.shingles for r in rows], containment)
    keys = sorted(set().union(*sieves))

    low = F.lower(F.col(quoted(text)).cast("string"))
    # the lambda's variable is the lower-case text, made once for all words
    sieve = F.exists(F.array(low), lambda t: functools.reduce(operator.or_, (F.contains(t, F.lit(k)) for k in keys)))
    near = written(docs.where(sieve).select(F.col(quoted(key)).cast("long").alias("doc_id"), words_of(F.col(quoted(text))).alias("w")), "sieved")
    found = None
    for size in sorted({top[len(r.w)] for r in rows}):
        own = [r for r in rows if top[len(r.w)] == size]
        words = F.array(*map(F.lit, sorted(set().union(*(s for r, s in zip(rows, sieves, strict=True) if top[len(r.w)] == size)))))
        k, step = own[0].k, max(1, size // 4)
        span = size + step
        bands = band_count(min(len(r.shingles) for r in own), span - k + 1, containment, miss)
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(k - 1), F.lit(1)), F.lit(step))
        windows = near.where(F.arrays_overlap("w", words)).select("doc_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, span))).alias("v"))
        windows = windows.where(F.arrays_overlap("v", words))
        windows = windows.select("doc_id", shingles_of(F.col("v"), k).alias("seen")).where(F.size("seen") > 0)
        windows = windows.withColumn("bands", bands_of(F.col("seen"), bands))
        mine = spark.createDataFrame([(r.template_id, r.shingles) for r in own], "template_id string, shingles array<string>")
        index = mine.select("template_id", "shingles", F.posexplode(bands_of(F.col("shingles"), bands)).alias("band", "value"))
        # a template and its bands are a few values each, and there are about ``most`` of them
        met = windows.select("doc_id", "seen", F.posexplode("bands").alias("band", "value")).join(F.broadcast(index), ["band", "value"])
        shared = met.select("doc_id", "template_id", F.size(F.array_intersect("seen", "shingles")).alias("n_shared"), F.size("shingles").alias("n_shingles"))
        part = shared.where(F.col("n_shared") >= F.lit(containment) * F.col("n_shingles"))
        found = part if found is None else found.union(part)
    return found
