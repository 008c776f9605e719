"""License scans: MinHash bands over overlapping text windows, in DataFrame functions only.

A document is read in windows of `Settings.window` words, one every `Settings.stride`; a
template in pieces of window - stride + 1 words, so every piece of a template in a document lies
whole in some window.  Of each window and piece, `Settings.bands` MinHash values are taken over
word shingles (one row a band).  A piece of s shingles in a window of w shingles collides in a
band with probability s / w, so it is retrieved with probability 1 - (1 - s / w) ** bands:
0.99999 for a single shingle by default (s = 1, w = 4, 40 bands), and a template of many
shingles has as many chances.  Templates of fewer words than a shingle are one shingle of
their own length, with windows of such shingles.

Retrieved pairs of text and template are reduced to distinct ones and verified exactly: the
share of the template's distinct shingles that the text holds.  Time and the broadcast bands
grow in proportion to the templates' words; beyond `block_marks` bands (24 bytes each) they are
broadcast block by block, each against all texts.

Bit maps hold the bands of all templates and the texts of all pairs; values outside them stop at
once, so only rows near a template reach a join.  Maps have up to 2 ** `map_bits_most` bits; a
fuller one lets more rows pass and changes no result.

Null and empty texts match nothing, nor do templates without words or without an id; an id with
several texts counts as its best one.  Repeated rows give their matches once.  Extra columns
are ignored, and empty tables give empty results.  Texts of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._stage import staged
from linkloom.llm.decontaminate import words

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""

#: Public license texts and notices; any table (template_id, text) may take their place, such as
#: whole licenses of thousands of words read by `templates_in`.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "Apache-2.0-header": _APACHE,
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "GPL-3.0-header": _GPL,
    "ISC": _ISC,
    "MIT-whole": _MIT,
}


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    window: int = 6
    stride: int = 4
    bands: int = 40
    percent: int = 80  # of a template's distinct shingles
    map_bits_most: int = 23
    block_marks: int = 500_000  # bands of template pieces broadcast at once


def _shingles(array: str, at: Column, window: int, size: int) -> list[Column]:
    """Hashes of the shingles that start in a window of words; null beyond the end."""
    return [F.when(F.get(array, at + j + size - 1).isNotNull(), F.xxhash64(*(F.get(array, at + j + i) for i in range(size)))) for j in range(window - size + 1)]


def _bands(table: DataFrame, width: int, how: Settings) -> DataFrame:
    """One row per band of rows with shingle hashes s0..: the least hash of a shingle
    and the band, so that every shingle of a window is as likely as any other to be it."""
    table = table.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(how.bands - 1))))
    mixed = lambda c: F.when(c.isNotNull(), F.xxhash64(c, "band"))  # noqa: E731  (the hash of null is not null)
    value = F.least(*(mixed(F.col(f"s{j}")) for j in range(width))) if width > 1 else mixed(F.col("s0"))
    return table.withColumn("value", value).where(F.col("value").isNotNull())


def _places(array: str, size: int) -> Column:
    """(at, shingle) of every place of an array with at least `size` words."""
    joined = lambda i: F.concat_ws(" ", *(F.get(array, i + j) for j in range(size)))
    return F.when(F.size(array) >= size, F.transform(F.sequence(F.lit(0), F.size(array) - size), lambda i: F.struct(i.alias("at"), joined(i).alias("shingle"))))


def _bit_map(values: DataFrame, how: Settings):
    """A test of hashes against a Bloom map of the column `value`, with one hash; 64 bits a value
    up to 2 ** map_bits_most.  The map becomes a literal."""
    bits = min(how.map_bits_most, max(12, int(64 * values.count()).bit_length()))
    cell = F.shiftrightunsigned("value", 64 - bits)
    rows = values.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    held = np.zeros(1 << (bits - 6), np.int64)
    for row in rows.collect():
        held[row.word] = row.bits
    words_ = F.split(F.lit(",".join(map(str, held.tolist()))), ",").cast("array<bigint>")

    def passes(value: Column) -> Column:
        at = F.shiftrightunsigned(value, 64 - bits)
        word = F.get(words_, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


def scan_licenses(docs: DataFrame, templates: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(doc_id, template_id, containment, place): each template found in a document, the share
    of its distinct shingles there and the place (in words, from 0) of the first of them."""
    known = templates.select(F.col("template_id").cast("string").alias("template_id"), words(F.col("text")).alias("t")).where((F.size("t") > 0) & F.col("template_id").isNotNull())
    known = staged(known.select("template_id", F.xxhash64("template_id", "t").alias("tid"), "t", F.least(F.size("t"), F.lit(how.shingle)).alias("k")), "templates")
    sizes = [r.k for r in known.select("k").distinct().orderBy("k").limit(how.shingle).collect()] or [how.shingle]
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # Retrieval: pairs of text and template that share a band.
    pairs = []
    for k in sizes:
        piece = max(how.window - how.stride + 1 - k + 1, 1)  # shingles in a piece
        last = F.greatest(F.size("t") - k - piece + 1, F.lit(0))
        starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(piece)), last))
        pieces = known.where(F.col("k") == k).select("tid", "t", F.explode(starts).alias("at"))
        pieces = pieces.select("tid", *(x.alias(f"s{j}") for j, x in enumerate(_shingles("t", F.col("at"), piece + k - 1, k))))
        marks = staged(_bands(pieces, piece, how).select("band", "value", "tid").distinct(), "marks")
        passes = _bit_map(marks.select(F.xxhash64("band", "value").alias("value")), how)
        table = source.select("text_hash", words(F.col("text")).alias("words")).where(F.size("words") >= k)
        table = table.select("text_hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(how.stride))).alias("at"))
        table = table.select("text_hash", *(x.alias(f"s{j}") for j, x in enumerate(_shingles("words", F.col("at"), how.window, k))))
        rows = _bands(table, how.window - k + 1, how).where(passes(F.xxhash64("band", "value"))).select("text_hash", "band", "value")
        blocks = max(1, -(-marks.count() // how.block_marks))
        for b in range(blocks):
            part = marks if blocks == 1 else marks.where(F.pmod(F.xxhash64("band", "value"), F.lit(blocks)) == b)
            pairs.append(staged(rows.join(F.broadcast(part), ["band", "value"]).select("text_hash", "tid").distinct(), "block"))
    pairs = pairs[0] if len(pairs) == 1 else staged(reduce(DataFrame.union, pairs).distinct(), "pairs")
    # Verification: the template's shingles in those texts.
    near = source.where(_bit_map(pairs.select(F.col("text_hash").alias("value")), how)(F.col("text_hash"))).select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    found = []
    for k in sizes:
        held = known.where(F.col("k") == k).select("template_id", "tid", F.explode(F.array_distinct(_places("t", k).getField("shingle"))).alias("shingle"))
        held = staged(held, "shingles")
        all_ = held.groupBy("tid").agg(F.count("*").alias("all"))
        there = near.select("doc_id", "text_hash", F.explode(_places("words", k)).alias("p")).select("doc_id", "text_hash", "p.*")
        there = there.join(held, "shingle").join(pairs, ["text_hash", "tid"]).groupBy("doc_id", "text_hash", "template_id", "tid").agg(F.countDistinct("shingle").alias("inside"), F.min("at").alias("place"))
        found.append(there.join(all_, "tid").where(F.col("inside") * 100 >= F.col("all") * how.percent).select("doc_id", "text_hash", "template_id", (F.col("inside") / F.col("all")).alias("containment"), "place"))
    found = reduce(DataFrame.union, found)
    return found.groupBy("doc_id", "text_hash", "template_id").agg(F.max("containment").alias("containment"), F.min("place").alias("place")).drop("text_hash")


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "template_id string, text string")


def templates_in(spark: SparkSession, folder: str) -> DataFrame:
    """One template for each text file of a folder, named by the file."""
    found = spark.read.text(folder, wholetext=True).select("_metadata.file_name", "value")
    return found.select(F.col("file_name").alias("template_id"), F.col("value").alias("text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), notices(spark))
