"""License scans with DataFrame functions only.

Texts and templates become lower-case words (runs of letters and digits) and 5-word shingles; a
template of fewer words is one shingle as wide as itself. For a template of m shingles, windows of
2m shingles start every m over every text, so that each of its places lies whole in some window.

A window and a template have BANDS MinHash bands of one row each: band b is the least of the hashes of
their shingles under the b-th hash function. They are a candidate pair if a band is equal. The pairs are
found by an equi-join on band keys: a window's band can only equal a template's through the shingle that
is the template's least in that band, so every shingle of every text is joined, as a key, to the least
shingles of all templates, and for the windows around a hit the band itself is compared. So the pairs are
exactly those of all windows' signatures joined band by band (a test compares them), without storing
signatures of windows that hold no such shingle. Candidates are verified by exact containment: a match
holds at least LEAST of the template's different shingles, compared as text.

A window that holds LEAST of a template has a Jaccard similarity of at least LEAST / (3 - LEAST), so
BANDS bands of one row retrieve it with a probability of 1 - (1 - that) ** BANDS: over 0.99999.

Only the templates are broadcast: they are a parameter, and refused above MOST_SHINGLES shingles.
Nulls and edge cases: null or wordless texts match nothing; repeated rows and null ids give a row for
each (the row's own columns are kept); very long texts are scanned whole, and only the windows around
hits move; of equal windows the first gives first_word; an empty table or no templates give an empty
result. Carried columns of any name but those of the result keep theirs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body

WIDTH, BANDS, LEAST, MOST_SHINGLES = 5, 32, 0.8, 50_000

#: Notices as their licenses recommend them, and what files usually say: (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    # whole licenses
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _template_table(docs: DataFrame, templates) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Templates (template, license, width, span, words, shingles) and the classes (width, span) they form."""
    rows = []
    for i, (name, text) in enumerate(templates):
        words = template_words(text)
        if words:
            width = min(WIDTH, len(words))
            rows.append((i, name, width, len(words) - width + 1, words, [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]))
    if sum(r[3] for r in rows) > MOST_SHINGLES:
        raise ValueError(f"templates have more than {MOST_SHINGLES} shingles")
    made = docs.sparkSession.createDataFrame(rows, "template int, license string, width int, span int, words array<string>, shingles array<string>")
    return made, sorted({(r[2], r[3]) for r in rows})


def band(shingle: str, b: str) -> str:
    """The hash of a shingle (its 64-bit hash) under the hash function of band b."""
    return f"xxhash64({shingle}, {b})"


def band_keys(known: DataFrame) -> DataFrame:
    """(template, license, width, span, shingles, t, bands): each shingle that is a template's least in some bands."""
    hashed = known.withColumn("hashes", F.expr("transform(shingles, s -> xxhash64(s))")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    least = hashed.withColumn("t", F.expr(f"array_min(transform(hashes, x -> struct({band('x', 'b')} AS key, x AS shingle))).shingle"))
    return least.groupBy("template", "license", "width", "span", "shingles", "t").agg(F.sort_array(F.collect_list("b")).alias("bands"))


def text_shingles(docs: DataFrame, widths: list[int], carry: tuple[str, ...]) -> DataFrame:
    """(_row, carry..., words, pos, width, t): a row for each shingle of each text, t its hash as text."""
    split = F.split(F.lower(body()), r"[^\p{L}\p{N}]+").alias("_raw")
    bare = F.expr("slice(_raw, if(_raw[0] = '', 2, 1), greatest(size(_raw) - int(_raw[0] = '') - int(_raw[size(_raw) - 1] = ''), 0))")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *carry, split).select("_row", *carry, bare.alias("_words"))
    rows = rows.where(F.size("_words") >= min(widths))
    widest = max(widths)
    shifted = F.arrays_zip("_words", *[F.slice("_words", k + 1, F.greatest(F.size("_words") - k, F.lit(0))).alias(f"w{k}") for k in range(1, widest)])
    each = rows.select("_row", *carry, "_words", F.posexplode(shifted).alias("_pos", "_s"))
    names = ["_words", *[f"w{k}" for k in range(1, widest)]]
    hashes = ", ".join(f"{w}, if(_s.`{names[w - 1]}` IS NULL, null, xxhash64(concat_ws(' ', {', '.join(f'_s.`{n}`' for n in names[:w])})))" for w in widths)
    return each.selectExpr("_row", *[f"`{c}`" for c in carry], "_words", "_pos", f"stack({len(widths)}, {hashes}) AS (_width, _t)").where("_t IS NOT NULL")


def candidates(docs: DataFrame, known: DataFrame, widths: list[int], carry: tuple[str, ...]) -> DataFrame:
    """(_row, carry..., template, license, width, span, shingles, win, own): windows that share a band with a template.

    win: the window's number, it starts at word win * span; own: its shingles as text.
    """
    keys = F.broadcast(band_keys(known))  # BANDS rows a template at most
    hits = text_shingles(docs, widths, carry).join(keys, (F.col("_width") == F.col("width")) & (F.col("_t") == F.col("t")))
    around = hits.withColumn("win", F.explode(F.expr("filter(array(_pos div span, _pos div span - 1), k -> k >= 0)")))
    cut = around.withColumn("_part", F.expr("slice(_words, int(win * span + 1), 2 * span + width - 1)")).drop("_words", "_pos", "_width", "_t")
    own = F.expr("transform(sequence(1, size(_part) - width + 1), i -> array_join(slice(_part, i, width), ' '))")
    least = f"array_min(transform(hashes, x -> {band('x', 'b')})) = {band('t', 'b')}"
    met = cut.withColumn("own", own).withColumn("hashes", F.expr("transform(own, s -> xxhash64(s))")).where(F.expr(f"exists(bands, b -> {least})"))
    first = [F.first(c).alias(c) for c in ("shingles", "own")]
    return met.groupBy("_row", *carry, "template", "license", "width", "span", "win").agg(*first)


def scan(docs: DataFrame, templates=TEMPLATES, carry: tuple[str, ...] = ("doc_id",), least: float = LEAST) -> DataFrame:
    """A row for each document (the columns ``carry``) and template that match.

    license, template (its number), containment (the best window's), first_word (where the first
    matching window starts), windows (how many match).
    """
    known, classes = _template_table(docs, templates)
    if not classes:
        return docs.select(*carry).where("false").selectExpr("*", "'' AS license", "0 AS template", "0D AS containment", "0L AS first_word", "0L AS windows")
    found = candidates(docs, known, sorted({w for w, _ in classes}), carry)
    held = F.size(F.array_intersect("own", "shingles")) / F.size(F.array_distinct("shingles"))
    matches = found.withColumn("containment", held).where(F.col("containment") >= least)
    best = matches.groupBy("_row", *carry, "license", "template").agg(F.max("containment").alias("containment"), F.min(F.col("win") * F.col("span")).cast("long").alias("first_word"), F.count("*").alias("windows"))
    return best.drop("_row")
