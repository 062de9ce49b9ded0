"""Operator 7: license scans by the Dice coefficient over word bigrams. DataFrame functions only.

A text is normalised (lower case, runs of anything but letters and digits become one blank) and
compared to license templates as a whole, by paragraph (blank lines between) and by line. Two
bigram sets A and B have the coefficient 2 |A and B| / (|A| + |B|), which can reach ``t`` only if
|A| lies between t / (2 - t) and (2 - t) / t times |B|: templates outside these size bounds are
pruned before any intersection is made, and so are segments that no template can match. A
segment counts for its best template, the first of TEMPLATES at a tie.

A notice may also stand in a longer text over several paragraphs, wrapped lines or sentences. So
each text is also cut into units at line ends and after sentences, and runs of consecutive units
are scored for every template that has enough of its bigrams in the text outside segments already
matched by a template of at least its size. Of overlapping runs the one with most bigrams in
common counts. A notice that begins or ends inside a sentence is seen only as far as that sentence
with it reaches the threshold.

The bound also says that a segment must have a share t / (2 - t) of a template's bigrams. For each
template some marker words are taken that stand in more than the rest of its bigrams: a text
without any marker word of any template cannot match and is done with after one look at its words.

Nothing is shuffled or grouped: each row is answered from its own text, whatever its source.

Defined cases: a null or empty text has no segments and no license; repeated rows are scanned each
for itself; equal segments of a text count once; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

THRESHOLD = 0.8
Templates = tuple[tuple[str, str], ...]
#: Public license notices and texts, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
)


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(templates: Templates = TEMPLATES) -> list[tuple[str, list[str]]]:
    found = []
    for name, text in templates:
        w = _words(text)
        found.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return found


def markers(threshold: float, templates: Templates = TEMPLATES) -> list[str]:
    """Words of which every matching text has at least one; the longest words, then those of the fewest templates, are taken first."""
    found: set[str] = set()
    everywhere = [{w for g in grams for w in g.split(" ")} for _, grams in template_bigrams(templates)]
    for _, grams in template_bigrams(templates):
        pairs = [set(g.split(" ")) for g in grams]
        may_lack = int((1 - threshold / (2 - threshold)) * len(pairs) + 1e-9)
        mine: set[str] = set()
        for word in sorted(set().union(*pairs), key=lambda w: (-len(w), sum(w in t for t in everywhere), w)):
            if sum(bool(p & mine) for p in pairs) > may_lack:
                break
            mine.add(word)
        found |= mine
    return sorted(found)


def _with_runs(d: DataFrame, all_t: str, sizes: list[int], low: float, high: float, fits: str, dice: str, threshold: float) -> DataFrame:
    """``d`` with the matching runs of units added to ``_m``, the matching segments."""
    pairs = lambda w: f"transform(sequence(0, size({w}) - 2), i -> concat({w}[i], ' ', {w}[i + 1]))"
    units = r"filter(transform(split(_t, r'\n|(?<=[.!?])[ \t\r]+'), x -> trim(regexp_replace(lower(x), r'[^\p{L}\p{N}]+', ' '))), x -> x <> '')"
    d = d.withColumn("_u", F.expr(f"CASE WHEN _maybe THEN {units} ELSE CAST(array() AS array<string>) END"))
    d = d.withColumn("_w", F.expr("filter(split(array_join(_u, ' '), ' '), x -> x <> '')"))
    d = d.withColumn("_fg", F.expr(f"CASE WHEN size(_w) > 1 THEN array_distinct({pairs('_w')}) ELSE CAST(array() AS array<string>) END"))
    # words of matched segments become bars, so that positions stay; two blanks let equal neighbours go too
    n = f"array({', '.join(map(str, sizes))})"
    wide = "concat(' ', replace(m.x, ' ', '  '), ' ')"
    clear = f"aggregate(filter(_m, m -> {n}[-m.i] >= t.n), concat(' ', array_join(_w, '  '), ' '), (a, m) -> replace(a, {wide}, regexp_replace({wide}, '[^ ]+', '|')))"
    enough = f"size(array_intersect(t.b, {{}})) >= {low!r} * t.n"
    d = d.withColumn("_c", F.expr(f"transform(filter(array({all_t}), t -> {enough.format('_fg')}), t -> struct(t.i AS i, t.name AS name, t.n AS n, t.l AS l, t.b AS b, split(trim({clear}), ' +') AS w))"))
    d = d.withColumn("_c", F.expr(f"filter(transform(_c, t -> struct(t.i AS i, t.name AS name, t.n AS n, t.l AS l, t.b AS b, {pairs('t.w')} AS g)), t -> {enough.format('t.g')})"))
    d = d.withColumn("_at", F.expr("CASE WHEN size(_c) > 0 THEN aggregate(_u, array(0), (a, x) -> concat(a, array(element_at(a, -1) + size(split(x, ' '))))) ELSE array(0) END"))
    ends = f"filter(slice(_at, k + 2, CAST(ceil({high!r} * t.l) AS int) + 1), e -> e - s > {low!r} * t.n AND e - s <= {high!r} * t.l + 1)"
    spans = f"flatten(transform(slice(_at, 1, size(_u)), (s, k) -> transform({ends}, e -> struct(s AS s, e AS e, array_distinct(slice(t.g, s + 1, e - s - 1)) AS g))))"
    scored = f"transform(array(r.g), g -> IF({fits}, {dice}, 0D))[0]"
    found = f"flatten(transform(_c, t -> filter(transform({spans}, r -> struct(size(array_intersect(t.b, r.g)) AS both, {scored} AS dice, -t.i AS i, -r.s AS s, r.e AS e, t.name AS name)), r -> r.dice >= {threshold!r})))"
    d = d.withColumn("_r", F.expr(f"sort_array({found}, false)"))
    kind = "array<struct<both:int,dice:double,i:int,s:int,e:int,name:string>>"
    apart = f"aggregate(_r, CAST(array() AS {kind}), (a, r) -> IF(exists(a, y -> -y.s < r.e AND -r.s < y.e), a, concat(a, array(r))))"
    return d.withColumn("_m", F.expr(f"concat(_m, array_distinct(transform({apart}, r -> struct(r.dice AS dice, r.i AS i, r.name AS name, array_join(slice(_w, -r.s + 1, r.e + r.s), ' ') AS x))))"))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> DataFrame:
    """``(doc_id, licenses, best_license, best_dice, n_segments)`` for each row of ``docs``.

    ``licenses``: names found, sorted, comma-joined; ``best_dice``: of the best segment, 6 digits
    (null where there is none); ``n_segments``: distinct segments and runs that matched.
    ``templates``: names and texts; whole licenses may be given too.
    """
    kept = [(n, b) for n, b in template_bigrams(templates) if b]
    length = [len(_words(text)) for (_, text), (_, b) in zip(templates, template_bigrams(templates), strict=True) if b]
    # the bounds with a little room, as a coefficient may be the threshold itself
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    all_t = ", ".join(f"struct({i} AS i, '{n}' AS name, {len(b)} AS n, {length[i]} AS l, array({', '.join(repr(x) for x in b)}) AS b)" for i, (n, b) in enumerate(kept))
    fewest, most = low * min(len(b) for _, b in kept), high * max(len(b) for _, b in kept)
    fits = f"NOT (size(g) < {low!r} * t.n OR size(g) > {high!r} * t.n)"
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    words = r"split(trim(regexp_replace(lower(_t), r'[^\p{L}\p{N}]+', ' ')), ' ')"
    d = d.withColumn("_maybe", F.expr(f"arrays_overlap({words}, array({', '.join(map(repr, markers(threshold, templates)))}))"))
    raw = r"array_distinct(concat(array(_t), split(_t, r'\n[ \t\r]*\n'), split(_t, r'\n')))"
    plain = r"transform(" + raw + r", x -> trim(regexp_replace(lower(x), r'[^\p{L}\p{N}]+', ' ')))"
    # a segment of w words has at most w - 1 bigrams; blanks count its words without splitting it
    d = d.withColumn("_s", F.expr(f"CASE WHEN _maybe THEN array_distinct(filter({plain}, x -> length(x) - length(replace(x, ' ', '')) >= {fewest!r})) ELSE CAST(array() AS array<string>) END"))
    grams = "transform(transform(_s, x -> split(x, ' ')), w -> array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))))"
    d = d.withColumn("_g", F.expr(f"filter(zip_with(_s, {grams}, (x, g) -> struct(x AS x, g AS g)), s -> size(s.g) >= {fewest!r} AND size(s.g) <= {most!r})"))
    dice = "2D * size(array_intersect(t.b, g)) / (t.n + size(g))"
    scored = f"transform(filter(array({all_t}), t -> {fits}), t -> struct({dice} AS dice, -t.i AS i, t.name AS name))"
    best = f"transform(_g, s -> element_at(transform(array(s.g), g -> element_at(transform(array(array_max({scored})), m -> struct(m.dice AS dice, m.i AS i, m.name AS name, s.x AS x)), 1)), 1))"
    d = d.withColumn("_m", F.expr(f"filter({best}, m -> m.dice >= {threshold!r})"))
    d = _with_runs(d, all_t, [len(b) for _, b in kept], low, high, fits, dice, threshold)
    return d.select(
        "doc_id", F.expr("array_join(array_sort(array_distinct(transform(_m, m -> m.name))), ',')").alias("licenses"),
        F.expr("array_max(_m).name").alias("best_license"), F.expr("round(array_max(_m).dice, 6)").alias("best_dice"), F.size("_m").cast("long").alias("n_segments"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    most = int((2 - THRESHOLD) / THRESHOLD * max(len(b) for _, b in template_bigrams())) + 1  # bigrams of a segment that can match
    rows = ", ".join(f"({i}, '{n}', [{', '.join(repr(x) for x in b)}])" for i, (n, b) in enumerate(template_bigrams()))
    return rf"""
    WITH t AS (SELECT * FROM (VALUES {rows}) AS v(i, name, b)),
    s AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) x FROM (
      SELECT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\n[ \t\r]*\n'), regexp_split_to_array(text, '\n'))) x FROM documents)),
    w AS (SELECT doc_id, x, string_split(x, ' ') w FROM s),
    g AS (SELECT doc_id, x, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g FROM w WHERE len(w) > 1),
    m AS (SELECT doc_id, x, i, name, 2.0::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) dice FROM g, t WHERE len(g) <= {most}),
    b AS (SELECT doc_id, x, max_by(name, (dice, -i)) name, max((dice, -i)) o, max(dice) dice FROM m WHERE dice >= 0.8 GROUP BY 1, 2),
    r AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT name)), ',') licenses, max_by(name, o) best_license, round(max(dice), 6) best_dice, count(*)::BIGINT n FROM b GROUP BY 1)
    SELECT doc_id, coalesce(licenses, '') licenses, best_license, best_dice, coalesce(n, 0)::BIGINT n_segments FROM documents LEFT JOIN r USING (doc_id)"""


QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": _sql()}
