"""License scans: exact set-similarity join of text windows with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places count as base matches, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Wording of public licences and licence notices, with labels.
TEMPLATES = [
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
     (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
     distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
     following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
     Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
     MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
     CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
     SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License", "apache"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
     a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
     distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
     the License for the specific language governing permissions and limitations under the License.""", "apache"),
    ("This work is licensed under the GNU General Public License version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
     Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
     it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
     GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
     1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
     Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
     documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
     AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
     PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
     EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
     OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
     OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
     copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
     REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
     DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
     CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]

#: Share of a template's distinct words that a block must hold. At 0.9 no template of ten words or fewer may lack one, so
#: "released under the ... license" of another licence is no match.
THRESHOLD = 0.9


def template_words(text: str) -> list[str]:
    """The words of a template, cut like those of a text."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null counts as empty."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


def _places(phrase: str) -> Column:
    """Starts of the phrase in the array column words; its last word is looked up first."""
    parts = phrase.split()
    last = len(parts) - 1
    ends = F.filter(F.transform("words", lambda w, i: F.when(w == parts[-1], i)), lambda i: i.isNotNull())
    fits = lambda i: (i >= last) & F.expr("true") if not last else (i >= last) & _all([F.get("words", i - (last - k)) == parts[k] for k in range(last)])
    return F.transform(F.filter(ends, fits), lambda i: (i - last).cast("long"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, best_window.

    Text blocks are windows of words, of a length of their own for every template: with s the template's number of words, windows of
    2 s words start every s words, so any stretch as long as the template lies inside one, and no other template changes them.
    A block meets the template when it holds at least `threshold` of its distinct words. The join finds every such pair:
    document frequencies of the template words over all docs give one global order, rarest first; a block that keeps
    ceil(threshold * n) of a template's n words must hold one of its first n - ceil(threshold * n) + 1 words (prefix),
    must have that many words of templates of its length at all (length), and the words left after the meeting places in both
    orders must suffice (position). Survivors are verified exactly. Blocks without a prefix word are never built. The templates
    are a parameter list of the driver, so their index is bounded by it; what is read back is one count per template word.

    base_labels and labels are distinct, sorted and comma-joined ('' if none); score is 1 with a base place, else
    the largest containment found (0 if none). Null texts are empty; repeated rows stay; long texts are scanned
    whole; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = [template_words(t) for t, _ in templates]
    sets = [(k, sorted(set(w)), len(w), label) for k, (w, (_, label)) in enumerate(zip(cut, templates)) if w]
    vocabulary = sorted({w for _, t, _, _ in sets for w in t})
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), words_of(F.col(text_col)).alias("words"))

    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    counted = rows.select(F.explode(F.array_intersect("words", known)).alias("w")).groupBy("w").count().collect()
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (next((r["count"] for r in counted if r["w"] == w), 0), w)))}
    index = []
    for k, t, step, label in sets:
        order = sorted(t, key=rank.__getitem__)
        need = math.ceil(threshold * len(order) - 1e-9)
        index += [(order[p], k, step, p, len(order), need, order, label) for p in range(len(order) - need + 1)]
    schema = "token string, template int, step int, t_pos int, t_size int, need int, t_words array<string>, label string"
    table = F.broadcast(spark.createDataFrame(index, schema))
    literal = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    starters = sorted({x[0] for x in index})

    phrase_rows = F.lit(None).cast("array<long>")
    found = {p: F.when(F.array_contains("words", p.split()[-1]), _places(p)).otherwise(F.array().cast("array<long>")) for p, _ in phrases}
    at = F.concat(*found.values()) if found else F.coalesce(phrase_rows, F.array().cast("array<long>"))
    base = rows.select(
        id_col, "_row", "words", F.size("words").cast("long").alias("n_words"), at.alias("at"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for (_, label), c in zip(phrases, found.values())])))).alias("base"),
    )

    def blocks_of(step: int) -> Column:
        """Blocks of this length that hold a prefix word, with their words of templates of this length in the global order."""
        ordered = literal(sorted({w for _, t, n, _ in sets if n == step for w in t}, key=rank.__getitem__))
        near = F.transform(F.filter("met", lambda m: m["w"].isin(sorted({x[0] for x in index if x[2] == step}))), lambda m: F.floor(m["i"] / step).cast("int"))
        blocks = F.array_distinct(F.flatten(F.array(near, F.transform(near, lambda b: F.greatest(b - 1, F.lit(0))))))
        return F.transform(blocks, lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.array_intersect(ordered, F.slice("words", b * step + 1, F.lit(2 * step))).alias("b_words")))

    steps = sorted({n for _, _, n, _ in sets})
    met = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(starters), F.struct(i.alias("i"), w.alias("w"))))) if starters else F.lit(None).cast("array<struct<i:int,w:string>>")
    base = base.withColumn("met", F.when(F.arrays_overlap("words", literal(starters)), met))
    slim = base.select(
        id_col, "_row", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"), "base",
        (F.when(F.size("met") > 0, F.concat(*[blocks_of(n) for n in steps])) if steps else F.lit(None).cast("array<struct<step:int,block:int,b_words:array<string>>>")).alias("blocks"),
    )
    each = slim.withColumn("_b", F.explode_outer("blocks")).drop("blocks")
    each = each.select("*", "_b.step", "_b.block", "_b.b_words").drop("_b")
    each = each.select("*", F.posexplode_outer(F.when(F.size("b_words") > 0, F.col("b_words"))).alias("b_pos", "token"))
    met = each.join(table, ["token", "step"], "left")
    passes = (F.size("b_words") >= F.col("need")) & (1 + F.least(F.col("t_size") - F.col("t_pos") - 1, F.size("b_words") - F.col("b_pos") - 1) + F.least("t_pos", "b_pos") >= F.col("need"))
    overlap = F.when(passes, F.size(F.array_intersect("b_words", "t_words")))
    good = met.withColumn("_hit", F.when(overlap >= F.col("need"), F.struct((overlap / F.col("t_size")).alias("share"), (-F.col("block") * F.col("step")).alias("start"), "label")))
    keys = [id_col, "_row", "n_words", "n_base", "first_word", "last_word", "base"]
    summed = good.groupBy(*keys).agg(F.collect_set("_hit.label").alias("more"), F.max("_hit").alias("top"))
    return summed.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("top.share", F.lit(0.0))).alias("score"),
        (-F.col("top.start")).cast("long").alias("best_window"),
    )
