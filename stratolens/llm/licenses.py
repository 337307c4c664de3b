"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment decides; DataFrame functions alone.

Words are runs of a-z and 0-9 of the lower-cased text, shingles are pairs of neighbouring words. A template of n shingles is
looked for in windows of the least power of two W with n <= 3/4 W (8 at least), which begin every W/4 shingles, so every
occurrence lies within one window. A window that holds the least share of a template's shingles has at least the similarity
need / (W + n - need) with it; from the least of these, bands() takes as many one-row bands as make the chance that such a
pair shares none at most MISS. A retrieved template matches where the window really holds LEAST of its distinct shingles.

Two exact tests spare windows before they are hashed, and most of them: a match holds one of any n - need + 1 shingles of its
template, so its text holds one of the words that stand for the template's n - need + 1 least common pairs; and its window holds
`need` shingles that templates have at all. tests/llm measure what the bands retrieve by themselves.

Templates are notices and whole licenses, or any others: templates_of reads a folder of text files. Texts of more than BLOCK
characters are cut into blocks of so many words that know the words that follow, so rows stay bounded; blanks, other scripts
and long words between a template's words don't matter. The result tells notices (a sentence or two) from full texts by the
template's name.

Null, empty and one-word texts match nothing and give no row. Repeated rows are one: the result has a row for each
identifier, text and license. Nulls are a value of the identifier like others. Texts that hold a template at several places
get its best window, and the first place. Columns of other names are left out, so names can't clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

LEAST, MISS, BLOCK = 0.8, 1e-6, 200_000
# Notices by SPDX identifier, then whole licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to""",
    "BSL-1.0-full": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-header-full": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header-full": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0-header-full": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Words that are common in any text; pairs of other words go first when a template's rare pairs are chosen.
_COMMON = frozenset("the a of to in and or is are for by with this under you it any use work can be free not license licensed version source software released".split())


def templates_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of text files, named by them: a catalogue, small enough for the driver."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("name"), "value").collect()
    return {r["name"]: r["value"] for r in rows if len(_pairs(r["value"]))}


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _pairs(text: str) -> list[tuple[str, str]]:
    w = _words(text)
    return list(dict.fromkeys(zip(w, w[1:])))


def need(n: int) -> int:
    return math.ceil(LEAST * n - 1e-9)


def width(n: int) -> int:
    return max(8, 1 << math.ceil(math.log2(4 * n / 3)))


def bands(templates: dict[str, str] = TEMPLATES) -> int:
    """One-row bands with which a matching pair meets in none with a chance of MISS at most."""
    sizes = [len(_pairs(t)) for t in templates.values()]
    similarity = min(need(n) / (width(n) + n - need(n)) for n in sizes)
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def anchors(templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Words of which every matching text has one."""
    out = set()
    for t in templates.values():
        pairs = _pairs(t)
        rarity = lambda p: max((w not in _COMMON, len(w)) for w in p)
        for p in sorted(pairs, key=rarity, reverse=True)[: len(pairs) - need(len(pairs)) + 1]:
            out.add(max(p, key=lambda w: (w not in _COMMON, len(w))))
    return sorted(out)


def _word_column(lower: Column) -> Column:
    return F.filter(F.split(F.coalesce(lower, F.lit("")), "[^a-z0-9]+"), lambda w: w != "")


def _pair_column(words: Column) -> Column:
    at = F.when(F.size(words) >= 2, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1)))


def _minima(shingles: Column, n: int) -> Column:
    hashed = lambda j: lambda s: F.xxhash64(s, F.lit(j))
    return F.array(*[F.array_min(F.transform(shingles, hashed(j))) for j in range(n)])


def _blocks(docs: DataFrame, id_col: str, text_col: str, reach: int, block: int) -> DataFrame:
    """doc_id, digest, first (word), own (words), words: each text, or blocks of it with the `reach` words that follow them."""
    is_long = F.length(text_col) > block
    rows = lambda some: docs.filter(some).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.lower(text_col).alias("low"))
    short = rows(~is_long).select("doc_id", "digest", F.lit(0).cast("long").alias("first"), _word_column(F.col("low")).alias("words"))
    short = short.select("doc_id", "digest", "first", F.size("words").alias("own"), "words")
    long = rows(is_long).dropDuplicates(["doc_id", "digest"])
    long = long.select("doc_id", "digest", F.posexplode(F.regexp_extract_all("low", F.lit(f"(?s).{{1,{block}}}[a-z0-9]*"), 0)).alias("n", "part"))
    long = long.select("doc_id", "digest", "n", _word_column(F.col("part")).alias("words")).filter(F.size("words") > 0)
    before = F.sum(F.size("words")).over(Window.partitionBy("doc_id", "digest").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    # Cut anew by the words' numbers, so that a block has its `reach` words however little its characters hold.
    long = long.withColumn("from", F.coalesce(before, F.lit(0)).cast("long")).withColumn("to", F.col("from") + F.size("words"))
    some, n = max(1, block // 8), F.col("no") * max(1, block // 8)
    long = long.withColumn("no", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("from") - reach) / some)), F.floor((F.col("to") - 1) / some))))
    begin, end = F.greatest(F.col("from"), n), F.least(F.col("to"), n + some + reach)
    part = F.struct("n", F.slice("words", (begin - F.col("from") + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int")).alias("words"))
    long = long.groupBy("doc_id", "digest", "no").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("words", F.flatten("parts.words"))
    return short.unionByName(long.select("doc_id", "digest", n.alias("first"), F.least(F.lit(some), F.size("words")).alias("own"), "words"))


def _windows(texts: DataFrame, templates: dict[str, str], n_bands: int) -> DataFrame:
    """texts (doc_id, digest, first, own, words) -> (doc_id, digest, width, start, at, pairs, minima): the windows that begin in a text's own words and hold enough shingles of templates, with their bands."""
    every = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted({p for t in templates.values() for p in _pairs(t)})])
    least: dict[int, int] = {}
    for t in templates.values():
        n = len(_pairs(t))
        least[width(n)] = min(need(n), least.get(width(n), n))
    rows = texts.select("doc_id", "digest", "first", "own", _pair_column(F.col("words")).alias("pairs"))
    rows = rows.withColumn("has", F.array_intersect("pairs", every)).filter(F.size("has") >= min(least.values()))
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains("has", F.get("pairs", i)))
    widths = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).alias("least")) for w, n in sorted(least.items())])
    rows = rows.withColumn("hits", hits).withColumn("w", F.explode(F.filter(widths, lambda w: w["least"] <= F.size("has"))))
    step, last = (F.col("w.width") / 4).cast("long"), F.col("first") + F.col("own") - 1
    # Window numbers count from the text's first word; the block has those that begin in its own words.
    ends = lambda i: F.sequence(F.greatest(F.ceil(F.col("first") / step), F.ceil((F.col("first") + i - F.col("w.width") + 1) / step)), F.floor(F.least(last, F.col("first") + i) / step))
    some = F.filter("hits", lambda i: F.greatest(F.ceil(F.col("first") / step), F.ceil((F.col("first") + i - F.col("w.width") + 1) / step)) <= F.floor(F.least(last, F.col("first") + i) / step))
    windows = rows.withColumn("start", F.explode(F.array_distinct(F.flatten(F.transform(some, ends))))).withColumn("start", F.col("start") * step)
    windows = windows.select("doc_id", "digest", F.col("w.width").alias("width"), F.col("w.least").alias("least"), "start", "has", F.slice("pairs", (F.col("start") - F.col("first") + 1).cast("int"), F.col("w.width")).alias("pairs"))
    windows = windows.filter(F.size(F.array_intersect("pairs", "has")) >= F.col("least"))
    return windows.select("doc_id", "digest", "width", "start", "pairs", _minima(F.col("pairs"), n_bands).alias("minima"))


def _retrieved(windows: DataFrame, templates: dict[str, str], n_bands: int) -> DataFrame:
    """Windows with the templates of their width that share a band with them: license, has."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("t"), F.lit(width(len(_pairs(t)))).alias("t_width")) for k, t in templates.items()])
    known = windows.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.license", "r.t_width", F.array_distinct(_pair_column(_word_column(F.lower("r.t")))).alias("t_pairs"))
    known = F.broadcast(known.select("*", _minima(F.col("t_pairs"), n_bands).alias("t_minima")))  # a row a template
    meet = F.exists(F.zip_with("minima", "t_minima", lambda x, y: x == y), lambda x: x)
    return windows.join(known, (F.col("width") == F.col("t_width")) & meet)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, block: int = BLOCK) -> DataFrame:
    """doc_id, license, containment (the best window's), first_word (of the first matching window's first template word, from 0), windows (that match)."""
    n_bands = bands(templates)
    texts = _blocks(docs, id_col, text_col, max(width(len(_pairs(t))) for t in templates.values()) + 1, block)
    texts = texts.filter(F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors(templates)])))
    # Written and read back: filters on what follows would else be pushed below, with the words computed anew for every pair.
    texts = stored(texts, "license-texts")
    met = _retrieved(_windows(texts, templates, n_bands), templates, n_bands)
    share = F.size(F.array_intersect("pairs", "t_pairs")) / F.size("t_pairs")
    place = F.col("start") + F.array_min(F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains("t_pairs", F.get("pairs", i))))
    found = met.select("doc_id", "digest", "license", "start", share.alias("share"), place.alias("place")).filter(F.col("share") >= LEAST)
    found = found.dropDuplicates(["doc_id", "digest", "license", "start"])  # repeated rows
    out = found.groupBy("doc_id", "digest", "license").agg(F.max("share").alias("containment"), F.min("place").cast("long").alias("first_word"), F.count("*").alias("windows"))
    return out.drop("digest")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """All texts against all templates: a row for each document, text and license that it holds. Edge cases: see the module."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = f"""
WITH t(license, w) AS (VALUES {", ".join(f"('{k}', {_words(t)!r})" for k, t in TEMPLATES.items())}),
h AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS has FROM t),
k AS (SELECT *, len(has) AS n, CAST(greatest(8, power(2, ceil(log2(4 * len(has) / 3)))) AS BIGINT) AS width FROM h),
d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, text, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS pairs FROM d),
c AS (SELECT * FROM s, k WHERE len(list_intersect(pairs, has)) >= {LEAST} * n),
v AS (SELECT doc_id, text, license, has, n, width, unnest(range(0, len(pairs), width // 4)) AS start, pairs FROM c),
x AS (SELECT doc_id, text, license, start, has, n, pairs[start + 1 : start + width] AS win FROM v),
y AS (SELECT doc_id, text, license, start, len(list_intersect(list_distinct(win), has)) / n AS share,
             start + list_min(list_filter(range(0, len(win)), lambda i: list_contains(has, win[i + 1]))) AS place FROM x)
SELECT doc_id, license, max(share) AS containment, min(place) AS first_word, count(*) AS windows FROM y WHERE share >= {LEAST} GROUP BY doc_id, text, license
"""
