"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Notices fall into length classes by powers of two. For each class, a document's shingles are cut into windows of 5/4 of
the class's length at strides of 1/4 of it, so that every place where a notice can stand lies in one whole window, with a
Jaccard similarity of about 1/3 at least. A window collides with a template in a band if its least
shingle under the band's permutation is the template's least shingle. With one row a band and b bands, a window of
similarity s collides with probability 1 - (1 - s)^b: over 0.99999 for 32 bands at 1/3. Since a colliding shingle is a template's, windows without any
template shingle cannot collide and are not hashed: a set of bits, made from all template shingles and of a size that follows
their number up to a bound, tells which positions may hold one. Candidates are verified by exact shingle containment.
Template sets may be of any size: their bands are joined, and Spark sends them to every task only while they are small.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
MAX_BIT_WORDS = 1 << 20
BROADCAST_SHINGLES = 1 << 18
PROBES = 6

#: The texts of short licenses.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""

#: License notices and short licenses as their publishers word them. Longer ones come from files (template_files).
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", MIT_TEXT],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", BSD_TEXT],
    "isc": [ISC_TEXT],
    "zlib": [ZLIB_TEXT],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles in order; none if there are fewer words."""
    last = F.size(words) - k
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _once(value: Column) -> Column:
    """The value as a generated column, so that later expressions refer to it and don't repeat it for each element."""
    return F.explode(F.array(value))


def template_rows(spark, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(license, notice, text)."""
    return spark.createDataFrame([(k, n, t) for k, texts in templates.items() for n, t in enumerate(texts)], "license string, notice int, text string")


def template_files(spark, folder: str) -> DataFrame:
    """Template rows from the text files of a folder, each a license named by its file."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("license"), F.lit(0).alias("notice"), F.col("value").alias("text"))


def _slot(h: Column, probe: int, bits: int) -> Column:
    """A place of a shingle in the set of bits; the shingle's name is a hash already."""
    return F.shiftrightunsigned(h, 7 * probe).bitwiseAND(F.lit(bits - 1)).cast("int")


def _bit_set(notices: DataFrame, shingles: int):
    """A test whether a shingle may be a template's: always so for those that are, and for one other in a million up to a million shingles.

    The bits, 64 for each shingle and 8 MiB at most, are put together by Spark and stand in the plan as one constant array.
    """
    words = 1
    while words < shingles and words < MAX_BIT_WORDS:
        words *= 2
    own = notices.select(F.explode("own").alias("h")).select(F.explode(F.array(*[_slot(F.col("h"), i, words * 64) for i in range(PROBES)])).alias("slot"))
    rows = own.selectExpr("slot >> 6 as w", "1L << (slot & 63) as m").groupBy("w").agg(F.bit_or("m").alias("m")).collect()  # at most words rows
    values = [0] * words
    for r in rows:
        values[r["w"]] = r["m"]
    held = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded to a constant once

    def hit(h: Column, probe: int) -> Column:
        slot = _slot(h, probe, words * 64)
        return F.call_function("shiftrightunsigned", F.get(held, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1

    return lambda h: functools.reduce(Column.__and__, [hit(h, i) for i in range(PROBES)])


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, notice, first_word, containment): windows that hold at least the share containment of a notice's shingles; the best and then first window of each document and notice.

    Words are lower-cased runs of a-z and 0-9. Null and empty texts match nothing; rows without an id are scanned and
    come back with a null id, all as one document. Repeated rows give one result. Notices of fewer than shingle words
    cannot match.
    """
    worded = templates.select("license", "notice", _once(_words(F.col("text"))).alias("words"))
    notices = worded.select("license", "notice", _once(F.array_distinct(_shingles(F.col("words"), shingle))).alias("own")).where(F.size("own") > 0)
    notices = notices.withColumn("k", F.ceil(F.log2(F.size("own"))).cast("int"))
    sizes = notices.groupBy("k").agg(F.sum(F.size("own")).alias("n"), F.min(F.size("own")).alias("least")).orderBy("k").collect()  # a class for each power of two
    shingles = sum(r["n"] for r in sizes)
    if not shingles:
        return docs.select(F.col(id_col).cast("long").alias("doc_id")).where("false").select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("license", "string"), ("notice", "int"), ("first_word", "int"), ("containment", "double"))])
    may = _bit_set(notices, shingles)
    # length class, window, stride, and how many template shingles a window must hold to contain a notice of the class
    classes = [(r["k"], (1 << r["k"]) + max(1, 1 << r["k"] >> 2), max(1, 1 << r["k"] >> 2), math.ceil(containment * r["least"] - 1e-9)) for r in sizes]
    # positions that may hold a notice's shingle, then the windows around them; rows without any end at the explode
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), _once(_words(F.col(text_col).cast("string"))).alias("words"))
    hashed = split.select("doc_id", _once(_shingles(F.col("words"), shingle)).alias("h"))
    places = F.filter(F.transform("h", lambda x, i: F.when(may(x), i)), lambda i: i.isNotNull())

    def class_windows(i: Column, k: int, width: int, stride: int, need: int) -> Column:
        first = F.greatest(F.floor((i - width) / stride) + 1, F.lit(0).cast("long"))
        return F.transform(F.sequence(first, F.floor(i / stride)), lambda w: F.struct(F.lit(k).alias("k"), (w * stride).cast("int").alias("start"), F.lit(width).alias("width"), F.lit(need).alias("need")))

    def around(i: Column) -> Column:
        """The windows of each length class that hold position i."""
        return F.concat(*[class_windows(i, *c) for c in classes])

    placed = hashed.select("doc_id", "h", _once(places).alias("p")).where(F.size("p") > 0)
    starts = placed.select("doc_id", "h", "p", F.explode(F.array_distinct(F.flatten(F.transform("p", around)))).alias("w"))
    enough = F.size(F.filter("p", lambda i: (i >= F.col("w.start")) & (i < F.col("w.start") + F.col("w.width")))) >= F.col("w.need")
    windows = starts.where(enough).select("doc_id", F.col("w.k").alias("k"), F.col("w.start").alias("first_word"), _once(F.array_distinct(F.slice("h", F.col("w.start") + 1, F.col("w.width")))).alias("h"))

    def under(column: str, band: int) -> Column:
        """The least shingle under a band's permutation."""
        return F.array_min(F.transform(column, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("rank"), x.alias("x"))))["x"]

    def least(column: str) -> Column:
        return F.array(*[under(column, b) for b in range(bands)])

    banded = windows.select("doc_id", "k", "first_word", "h", F.posexplode(least("h")).alias("band", "value")).where(may(F.col("value")))
    keys = notices.select("license", "notice", "k", F.posexplode(least("own")).alias("band", "value"))
    texts = notices.select("license", "notice", "own")
    if shingles <= BROADCAST_SHINGLES:  # some 2 MB of hashes
        texts = F.broadcast(texts)
    met = banded.join(keys, ["k", "band", "value"]).join(texts, ["license", "notice"])
    found = met.select("doc_id", "license", "notice", "first_word", (F.size(F.array_intersect("own", "h")) / F.size("own")).alias("containment"))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("at")))
    return found.where(F.col("containment") >= containment).groupBy("doc_id", "license", "notice").agg(best.alias("b")).select("doc_id", "license", "notice", (-F.col("b.at")).alias("first_word"), F.col("b.containment").alias("containment"))
