"""License scan with DataFrame functions only: MinHash bands over text windows, then containment.

Templates and texts are lower-case words (letters and digits), in shingles of five. For a template
of m shingles, windows of w = 2 * 2^ceil(log2 m) shingles are laid every w / 4, so one of them holds
all of any occurrence. As w < 4 m, at a containment of c the Jaccard index of that window and the
template is more than c m / (4 m + m - c m), 0.19 for c = 0.8. ``bands`` have one row each, so the chance
that none agrees is below (1 - 0.19) ^ 40 = 0.022 % there, and below 1e-9 for a whole template. A retrieved
template is verified: the share of its shingles in the window has to reach ``containment``.

Windows without any template shingle cannot agree in a band; they are left out beforehand, which
loses nothing. All tables here are made from the templates alone, and so have a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

# Notices and grants as their licences publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GNU-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(text: Column) -> Column:
    """Hashes of five consecutive words of a text, in order; fewer words have none."""
    none = F.expr("cast(array() as array<bigint>)")

    def of(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
        return F.when(F.size(words) >= 5, hashes).otherwise(none)

    return _let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), of)


def _minima(shingles: Column, bands: int) -> Column:
    """One key for each band: the least of the band's hashes, with the band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))))


def _window_check(width: int, bands: int, containment: float, lookup: Column, own: Column, sets: Column, empty: Column) -> Callable[[Column], Column]:
    """From the start of a window to the templates that it retrieves and that are verified in it."""

    def check(start: Column) -> Column:
        def verified(window: Column) -> Column:
            ids = F.array_distinct(F.flatten(F.filter(F.transform(_minima(window, bands), lambda key: F.try_element_at(lookup, key)), lambda x: x.isNotNull())))
            share = lambda t: F.size(F.array_intersect(F.get(sets, t), window)) / F.size(F.get(sets, t))
            told = F.transform(ids, lambda t: F.struct(t.alias("t"), share(t).alias("containment"), start.alias("begin"), (start + F.size(window) + 4).alias("end")))
            return F.filter(told, lambda x: x["containment"] >= containment)

        window = F.slice("s", start + 1, F.lit(width))
        return F.when(F.arrays_overlap(window, own), _let(window, verified)).otherwise(empty)

    return check


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, bands: int = 40, containment: float = 0.8) -> DataFrame:
    """``doc_id`` and ``matches``: for each template found, its ``license``, the largest
    ``containment``, and the first window's ``begin`` and ``end`` in words.

    One row per input row: repeated rows each have theirs. Null and empty texts, and those of fewer than
    five words, have no match. Of windows with the same containment the first is told. Templates that
    are parts of each other are each found. A text's time grows with its length.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, template string")
    known = known.select("license", F.array_distinct(_shingles(F.col("template"))).alias("s")).where("size(s) > 0")
    rows = [(r["license"], r["s"], r["keys"]) for r in known.withColumn("keys", _minima(F.col("s"), bands)).collect()]  # the templates
    all_shingles = F.array(*(F.lit(x) for x in sorted({x for _, s, _ in rows for x in s})))
    by_width: dict[int, list[int]] = {}
    for k, (_, s, _) in enumerate(rows):
        by_width.setdefault(max(4, 2 * 2 ** (len(s) - 1).bit_length()), []).append(k)
    names = F.array(*(F.lit(r[0]) for r in rows))
    sets = F.array(*(F.array(*map(F.lit, r[1])) for r in rows))
    shingled = texts(docs, id_col, text_col).select("doc_id", _shingles(F.coalesce("text", F.lit(""))).alias("s"))
    shingled = shingled.withColumn("some", F.arrays_overlap("s", all_shingles))
    empty = F.expr("cast(array() as array<struct<t:int,containment:double,begin:int,end:int>>)")
    found = [empty]
    for width, members in sorted(by_width.items()):
        table: dict[int, list[int]] = {}
        for k in members:
            for key in rows[k][2]:
                table.setdefault(key, []).append(k)
        lookup = F.create_map(*(x for key, ks in sorted(table.items()) for x in (F.lit(key), F.array(*map(F.lit, ks)))))
        own = F.array(*(F.lit(x) for x in sorted({x for k in members for x in rows[k][1]})))
        starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(width // 4))

        found.append(F.flatten(F.transform(starts, _window_check(width, bands, containment, lookup, own, sets, empty))))
    every = shingled.select("doc_id", F.when(F.col("some"), F.concat(*found)).otherwise(empty).alias("m"))
    best = lambda t: F.array_max(F.transform(F.filter("m", lambda x: x["t"] == t), lambda x: F.struct(x["containment"], (-x["begin"]).alias("b"), x["end"].alias("e"))))
    matches = F.transform(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["t"]))), lambda t: F.struct(F.get(names, t).alias("license"), best(t)["containment"].alias("containment"), (-best(t)["b"]).alias("begin"), best(t)["e"].alias("end")))
    return every.select("doc_id", matches.alias("matches"))
