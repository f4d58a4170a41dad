"""License scans: Dice coefficient over word bigrams, DataFrame operations only.

Text is normalised (lower case, runs of other characters than a-z and 0-9 become one
space) line by line, and a segment is a line or the whole text.  A segment's bigrams
are its distinct pairs of neighbouring words.  It matches a template if
2 * shared / (segment bigrams + template bigrams) reaches the threshold t.

A licence that is in neither segment of a document is looked for in runs of consecutive lines (a paragraph, a
hard-wrapped header), of at most (2 - t) / t times the template's bigrams, repeats counted on both sides.  Only texts that
hold enough of a template's bigrams are looked at.  A run of best coefficient begins and ends at a line
with a bigram of the template, and has at least n t / (2 - t) of them, so only such runs are compared: nothing is lost by that.

Two bounds prune first.  A match shares at least n t / (2 - t) of a template's n bigrams, so
it shares one of any n - n t / (2 - t) + 1 of them.  Some long words of each template that are in
that many of its bigrams serve as anchors: text without an anchor matches nothing, which one
search for whole words sees before anything is normalised.  And that coefficient needs a template of n bigrams and a segment of
at least n t / (2 - t) and at most n (2 - t) / t.  Segments outside the bounds of all
templates are dropped before their bigrams are made; the join of bigrams with the templates'
checks the bounds of the one template.  The template table is the only thing that is
broadcast, and is checked to be small.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATE_BIGRAMS = 200_000

#: Notices and texts of public licences, as their owners publish them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "all-rights-reserved": "All rights reserved.",
}


#: Frequent words, which are anchors only where a template leaves no other choice.
COMMON = frozenset("a all an and any are as at be been but by can each either following for from has have if in including is it its later may more no not of on one or other out shall so such than that the their then there this to under use was were which who will with without you your".split())


def words_of(text: Column) -> Column:
    """The normalised words; an empty array for null or for a text without any."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " ")))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def pairs_of(words: Column, f) -> Column:
    """f of each word and the one after it."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), f)


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words, each as text with a space between."""
    return F.array_distinct(pairs_of(words, lambda a, b: F.concat_ws(" ", a, b)))


def size_bounds(n, t: float) -> tuple:
    """A set that reaches Dice coefficient t with one of n has a size between these; a little wider, for rounding."""
    return n * t / (2 - t) - 1e-6, n * (2 - t) / t + 1e-6


def anchor_words(templates: dict[str, str], t: float) -> list[str]:
    """Words such that a segment without any of them reaches t with no template."""
    chosen: set[str] = set()
    for body in templates.values():
        words = re.findall("[a-z0-9]+", body.lower())
        grams = set(zip(words, words[1:], strict=False))
        needed = len(grams) - math.ceil(len(grams) * t / (2 - t) - 1e-9) + 1
        count = lambda: sum(bool(chosen & set(g)) for g in grams)  # noqa: B023, E731
        for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
            if not grams or count() >= needed:
                break
            chosen.add(w)
    return sorted(chosen)


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(bigram, licenses: array of (license, n)) and the sizes; templates without a bigram are left out."""
    t = spark.createDataFrame(list(templates.items()), "license string, body string").withColumn("grams", bigrams_of(words_of(F.col("body")))).filter(F.size("grams") > 0)
    sizes = [r.n for r in t.select(F.size("grams").alias("n")).collect()]  # one number for each template of the caller's
    if sum(sizes) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"{sum(sizes)} template bigrams; at most {MAX_TEMPLATE_BIGRAMS} are broadcast")
    rows = t.select(F.explode("grams").alias("gram"), F.struct("license", F.size("grams").alias("n")).alias("of"))
    return rows.groupBy("gram").agg(F.collect_list("of").alias("licenses")), sizes


def run_matches(texts: DataFrame, templates: dict[str, str], t: float) -> DataFrame:
    """(id, license, dice, n) of each text's runs of lines that reach t; overlapping runs count once in ``n``."""
    of = texts.sparkSession.createDataFrame(list(templates.items()), "license string, body string").withColumn("words", words_of(F.col("body")))
    of = of.select("license", bigrams_of(F.col("words")).alias("of_grams"), (F.size("words") - 1).alias("of_length")).filter(F.size("of_grams") > 0)
    least, longest = F.ceil(size_bounds(F.size("of_grams"), t)[0]), F.floor(size_bounds(F.col("of_length"), t)[1])
    of = of.withColumn("least", least.cast("int")).withColumn("longest", longest.cast("int"))
    d = texts.select("id", "text", F.xxhash64("text").alias("key"), bigrams_of(words_of(F.col("text"))).alias("grams"))
    d = d.join(F.broadcast(of), F.size("grams") >= F.col("least")).filter(F.size(F.array_intersect("grams", "of_grams")) >= F.col("least")).drop("grams")
    # Each word with its position in its line and the line's length; then the template's bigrams, each with the start of its
    # first word's line and the end of its second word's.
    lines = F.transform(F.split("text", "[\r\n]+"), words_of)
    words = F.flatten(F.transform(lines, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.size(ws).alias("of")))))
    d = d.select("id", "key", "license", "of_grams", "least", "longest", words.alias("words"))
    grams = pairs_of(F.col("words"), lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("gram"), a["i"].alias("back"), (b["of"] - b["i"]).alias("on")))
    hits = F.transform(grams, lambda g, p: F.struct(g["gram"].alias("gram"), (p - g["back"]).alias("start"), (p + 1 + g["on"]).alias("end")))
    d = d.withColumn("hits", F.filter(hits, lambda g: F.array_contains("of_grams", g["gram"])))
    first = lambda h, k: (k == 0) | (F.get("hits", k - 1)["start"] != h["start"])
    begun = F.filter(F.transform("hits", lambda h, k: F.when(first(h, k), F.struct(h["start"].alias("at"), k.alias("k")))), lambda b: b.isNotNull())
    near = lambda b: F.filter(F.slice("hits", b["k"] + 1, F.col("longest")), lambda h: h["end"] - b["at"] - 1 <= F.col("longest"))
    starts = F.transform(begun, lambda b: F.struct(b["at"].alias("at"), near(b).alias("hits"), F.slice(F.transform("words", lambda w: w["w"]), b["at"] + 1, F.col("longest") + 1).alias("words")))
    s = d.select("id", "key", "license", F.size("of_grams").alias("of_n"), F.explode(F.filter(starts, lambda b: F.size(b["hits"]) >= F.col("least"))).alias("s"))
    n = lambda end: F.size(bigrams_of(F.slice("s.words", 1, end - F.col("s.at"))))
    shared = lambda end: F.size(F.array_distinct(F.transform(F.filter("s.hits", lambda h: h["end"] <= end), lambda h: h["gram"])))
    ends = F.array_distinct(F.transform("s.hits", lambda h: h["end"]))
    runs = F.filter(F.transform(ends, lambda e: F.struct((2.0 * shared(e) / (n(e) + F.col("of_n"))).alias("dice"), e.alias("end"))), lambda r: r["dice"] >= t)
    s = s.select("id", "key", "license", F.col("s.at").alias("start"), runs.alias("runs")).filter(F.size("runs") > 0)
    s = s.select("id", "key", "license", "start", F.array_max("runs.dice").alias("dice"), F.array_max("runs.end").alias("end"))
    s = s.groupBy("id", "key", "license").agg(F.max("dice").alias("dice"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))
    apart = F.aggregate("runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, r: F.struct(F.greatest(a["end"], r["end"]).alias("end"), (a["n"] + (r["start"] >= a["end"]).cast("int")).alias("n")))
    return s.select("id", "license", "dice", apart["n"].cast("bigint").alias("n"))


def license_matches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document id and licence found: (id, license, dice, n_segments).

    ``dice`` is the best coefficient of the id's segments, ``n_segments`` how many distinct segments (lines, and the whole
    text if it has several) reach the threshold.  Where none does, they are the best coefficient of the runs of lines, and how many
    runs reach the threshold, overlapping ones counted once.  Documents without a match, null or empty texts and texts of under two words give no
    row.  Rows with the same id count as one document: equal segments of them are counted once.  A null id is an id.
    Templates whose bigrams are equal all match.  Of ``docs`` only the two columns are read, whatever others it has.
    """
    spark = docs.sparkSession
    grams, sizes = template_table(spark, templates if templates is not None else TEMPLATES)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    anchors = anchor_words(templates if templates is not None else TEMPLATES, threshold)
    pattern = f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(anchors)})(?![A-Za-z0-9])" if anchors else "(?!)"
    anchored = lambda text: F.coalesce(text.rlike(pattern), F.lit(False))
    d = d.filter(anchored(F.col("text")))
    lines = F.split(F.coalesce("text", F.lit("")), "[\r\n]+")
    segments = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    # The number of words bounds that of bigrams from above, so short segments go before any further work.
    least = min((size_bounds(n, threshold)[0] for n in sizes), default=0.0)
    s = d.select("id", F.explode(segments).alias("segment")).filter(F.length("segment") >= 2 * least).filter(anchored(F.col("segment")))
    s = s.select("id", bigrams_of(words_of(F.col("segment"))).alias("grams")).withColumn("n", F.size("grams"))
    bounds = [F.col("n").between(*size_bounds(n, threshold)) for n in sorted(set(sizes))]
    s = s.filter(reduce(lambda a, b: a | b, bounds, F.lit(False)))
    s = s.withColumn("segment", F.xxhash64(F.sort_array("grams")))
    low, high = size_bounds(F.col("of.n"), threshold)
    shared = s.select("id", "segment", "n", F.explode("grams").alias("gram")).join(F.broadcast(grams), "gram").select("id", "segment", "n", "gram", F.explode("licenses").alias("of")).filter(F.col("n").between(low, high))
    counted = shared.groupBy("id", "segment", "n", "of").agg(F.count_distinct("gram").alias("shared"))
    dice = 2.0 * F.col("shared") / (F.col("n") + F.col("of.n"))
    found = counted.select("id", F.col("of.license").alias("license"), dice.alias("dice"), F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("run")).filter(F.col("dice") >= threshold)
    runs = run_matches(d.filter(F.col("text").rlike("[\r\n]")), templates if templates is not None else TEMPLATES, threshold)
    either = found.unionByName(runs.withColumn("run", F.lit(True))).groupBy("id", "license")
    best = lambda f, c: F.coalesce(f(F.when(~F.col("run"), F.col(c))), f(c))
    return either.agg(best(F.max, "dice").alias("dice"), best(F.sum, "n").alias("n_segments")).withColumnRenamed("id", id_col)
