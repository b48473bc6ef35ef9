"""Licence scan by a positional rare-token index, with built-in DataFrame functions only.

* Templates are licence texts and notices, each with a mandatory key phrase.  The index posts every
  word of every template with its place.  It has some thousand rows, whatever the data.
* Inverse document frequencies of all template words are counted over the whole table.
* A file that has all words of some key phrase looks up its ``TOP`` licence words of highest IDF, and
  the rarest word of each key phrase, at every place they have.  Postings are intersected by
  relative position: hits of one template that agree on where it would start form an alignment, which
  counts if the rarest word of the key phrase is among them.
* An alignment holds if its key phrase stands word by word.  The share of the template's IDF weight
  that stands in place is its score, and has to reach the template's least share.

Four base phrases are templates that are all key phrase, so all their places are found.  Their
score is the weight of the phrase against the heaviest template of the same licence.

Defined cases: null or empty text has no words, no places, empty labels and score 0; very long
texts are read whole; ties in IDF go to the first word in order; repeated rows are judged alike; a
null id is passed through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.store import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many licence words of highest IDF a file looks up.
TOP = 12
#: label, phrase, prefix of the labels of its licence.
BASE = [("gpl", "gnu general public license", "gpl"), ("apache", "apache license", "apache"), ("cc-by", "cc by", "cc-by"), ("mit", "mit license", "mit")]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD3 = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}
General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works
of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
#: label, template, key phrase within it, least share of the template's weight in place.
TEMPLATES = [
    ("apache-2.0", _APACHE, "apache license version 2", 0.5),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2", 0.5),
    ("gpl-3.0", _GNU.format("", "3"), "gnu general public license as published by the free software foundation either version 3", 0.5),
    ("gpl-2.0", _GNU.format("", "2"), "gnu general public license as published by the free software foundation either version 2", 0.5),
    ("lgpl", _GNU.format("Lesser", "3"), "gnu lesser general public license", 0.4),
    ("agpl", _GNU.format("Affero", "3"), "gnu affero general public license", 0.4),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", 0.5),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2", 0.5),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license", 0.5),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license", 0.5),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", 0.4),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.4),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd", 0.4),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", 0.3),
    ("cc0", "released under the creative commons zero v1 0 universal license", "creative commons zero", 0.3),
    ("mit", _MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.4),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", 0.3),
    ("bsd-3-clause", _BSD + _BSD3 + _BSD_END, "neither the name of the copyright holder nor the names of its contributors", 0.5),
    ("bsd", _BSD + _BSD_END, "redistribution and use in source and binary forms", 0.4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", 0.4),
    ("bsd", "released under the bsd license", "bsd license", 0.4),
    ("mpl-2.0", _MPL, "mozilla public license v 2", 0.4),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license", 0.3),
    ("isc", _ISC, "permission to use copy modify and or distribute this software", 0.4),
    ("isc", "released under the isc license", "isc license", 0.4),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license", 0.3),
    ("zlib", _ZLIB, "the origin of this software must not be misrepresented", 0.4),
    ("boost", _BOOST, "to any person or organization obtaining a copy of the software", 0.4),
    ("unlicense", _UNLICENSE, "free and unencumbered software", 0.3),
]


@dataclass(frozen=True)
class Template:
    """Words, the place and length of the key phrase, the least share; base phrases name their licence's labels."""

    label: str
    words: list[str]
    at: int
    size: int
    least: float
    family: str | None = None
    key: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "key", self.words[self.at : self.at + self.size])


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _templates() -> list[Template]:
    out = [Template(label, p.split(), 0, len(p.split()), 0.0, family) for label, p, family in BASE]
    for label, text, key, least in TEMPLATES:
        words, own = _split(text), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        out.append(Template(label, words, at, len(own), least))
    return out


ALL = _templates()
VOCABULARY = sorted({w for t in ALL for w in t.words})


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def read_words(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, present, ws), read once: the licence words of every file, and all words of candidates.

    A file is a candidate if it has all words of some key phrase; the phrase can't stand elsewhere.
    """
    rows = docs.select("doc_id", words_of().alias("ws")).select("doc_id", "ws", F.array_intersect("ws", _array(VOCABULARY)).alias("present"))
    keys = {frozenset(t.key) for t in ALL}
    candidate = F.lit(False)
    for key in sorted(sorted(k) for k in keys if not any(o < k for o in keys)):  # a key that holds another key tells no more
        candidate = candidate | (F.size(F.array_except(_array(key), "present")) == 0)
    empty = F.array().cast("array<string>")
    kept = rows.select("doc_id", F.size("ws").cast("long").alias("n_words"), "present", F.when(candidate, F.col("ws")).otherwise(empty).alias("ws"))
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()), "words")


def idf(rows: DataFrame) -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) of each template word, over all rows."""
    seen = rows.select(F.explode("present").alias("w")).groupBy("w").count().collect()
    df, n = {r["w"]: r["count"] for r in seen}, rows.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}


def anchors(weight: dict[str, float]) -> list[int]:
    """The place in each template of the rarest word of its key phrase."""
    return [t.at + max(range(t.size), key=lambda i: (weight[t.key[i]], -i)) for t in ALL]


def index(spark: SparkSession, weight: dict[str, float]) -> DataFrame:
    """(word, template, place, anchor): the postings of all templates."""
    rare = anchors(weight)
    posted = [(w, n, i, i == rare[n]) for n, t in enumerate(ALL) for i, w in enumerate(t.words)]
    return spark.createDataFrame(posted, "word string, template int, place int, anchor boolean")


def alignments(rows: DataFrame, weight: dict[str, float], top: int = TOP) -> DataFrame:
    """(row, told): the (template, start) of every alignment of the rows that have words."""
    rare = anchors(weight)
    own = sorted({t.words[a] for t, a in zip(ALL, rare, strict=True)})
    by_idf = sorted(VOCABULARY, key=lambda w: (-weight[w], w))
    looked = F.array_union(F.slice(F.array_intersect(_array(by_idf), "present"), 1, top), F.array_intersect(_array(own), "present"))
    placed = rows.filter(F.size("ws") > 0).withColumn("looked", looked)
    hits = placed.select("row", F.explode(F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains("looked", x["word"]))).alias("x"))
    found = hits.select("row", "x.at", "x.word").join(F.broadcast(index(rows.sparkSession, weight)), "word")
    agreed = found.groupBy("row", "template", (F.col("at") - F.col("place")).alias("start")).agg(F.bool_or("anchor").alias("anchor")).filter("anchor")
    return agreed.groupBy("row").agg(F.collect_list(F.struct("template", "start")).alias("told"))


def scan_licenses(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = read_words(docs)
    weight = idf(rows)
    total = [sum(weight[w] for w in t.words) for t in ALL]
    own = [_base_share(t, n, total) for n, t in enumerate(ALL)]
    known = F.array(*[F.struct(_array(t.words).alias("words"), F.array(*[F.lit(weight[w]) for w in t.words]).alias("idf"), F.lit(total[n]).alias("total"), F.lit(t.at).alias("at"), _array(t.key).alias("key"), F.lit(t.least).alias("least"), F.lit(t.label).alias("label"), F.lit(t.family is not None).alias("base"), F.lit(own[n]).alias("own")) for n, t in enumerate(ALL)])
    aligned = rows.select("row", "ws").join(alignments(rows, weight, top), "row")

    def stands(x: Column) -> Column:
        t, key = F.get(known, x["template"]), x["start"] + F.get(known, x["template"])["at"]
        return (key >= 0) & (F.slice("ws", F.greatest(key, F.lit(0)) + 1, F.size(t["key"])) == t["key"])

    def share(x: Column) -> Column:
        t = F.get(known, x["template"])
        in_place = F.transform(t["words"], lambda w, i: F.when(F.get("ws", x["start"] + i) == w, F.get(t["idf"], i)).otherwise(0.0))
        weighed = F.aggregate(in_place, F.lit(0.0), lambda a, v: a + v)
        return F.when(t["base"], t["own"]).when(t["total"] > 0, weighed / t["total"]).otherwise(1.0)

    held = F.transform(F.filter("told", stands), lambda x: F.struct(F.get(known, x["template"])["label"].alias("label"), F.get(known, x["template"])["base"].alias("base"), F.get(known, x["template"])["least"].alias("least"), x["start"].alias("start"), share(x).alias("share")))
    live = aligned.select("row", held.alias("held")).select("row", F.filter("held", lambda x: x["share"] >= x["least"]).alias("live"))
    base = F.filter("live", lambda t: t["base"])
    label = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda t: t["label"]))), ",")
    starts = F.transform(base, lambda t: t["start"])
    judged = live.select("row", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), label(base).alias("base_labels"), label(F.col("live")).alias("labels"), F.array_max(F.transform("live", lambda t: t["share"])).alias("score"))
    return (
        rows.select("row", "doc_id", "n_words")
        .join(judged, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
        )
    )


def _base_share(t: Template, n: int, total: list[float]) -> float:
    """What a base phrase weighs against the heaviest template of its licence; 0 for other templates."""
    if t.family is None:
        return 0.0
    most = max(x for o, x in zip(ALL, total, strict=True) if o.family is None and o.label.startswith(t.family))
    return min(1.0, total[n] / most) if most > 0 else 1.0


def _oracle() -> str:
    """The same by brute force over every place of every key phrase, without an index."""
    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    values = ",\n  ".join(f"({n}, '{t.label}', {lists(t.words)}, {t.at}, {lists(t.key)}, {t.least}, {t.family is not None}, '{t.family or t.label}')" for n, t in enumerate(ALL))
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), t(n, label, tw, pos, phrase, least, base, family) AS (VALUES
  {values}
), df AS (
  SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(ws) AS word FROM w) GROUP BY word
), v AS (
  SELECT n, list(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) ORDER BY i) AS idf
  FROM (SELECT n, unnest(tw) AS word, unnest(range(len(tw))) AS i FROM t) LEFT JOIN df USING (word) GROUP BY n
), own AS (
  SELECT b.n, CASE WHEN max(list_sum(ov.idf)) > 0 THEN least(1.0, any_value(list_sum(bv.idf)) / max(list_sum(ov.idf))) ELSE 1.0 END AS own
  FROM t b JOIN v bv ON bv.n = b.n JOIN t o ON NOT o.base AND starts_with(o.label, b.family) JOIN v ov ON ov.n = o.n WHERE b.base GROUP BY b.n
), k AS (
  SELECT r, ws, t.*, idf, own, unnest(list_filter(range(1, len(ws) - len(phrase) + 2), lambda i: ws[i:i + len(phrase) - 1] = phrase)) AS s
  FROM w, t JOIN v ON v.n = t.n LEFT JOIN own ON own.n = t.n WHERE list_has_all(ws, phrase)
), h AS (
  SELECT r, label, base, least, s - 1 AS s, CASE WHEN base THEN own WHEN list_sum(idf) > 0 THEN list_sum(list_transform(range(1, len(tw) + 1),
    lambda i: CASE WHEN s - pos + i - 1 >= 1 AND ws[s - pos + i - 1] = tw[i] THEN idf[i] ELSE 0.0 END)) / list_sum(idf) ELSE 1.0 END AS share FROM k
), g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS f, max(s) FILTER (base) AS l, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al
  FROM h WHERE share >= least GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score
FROM w LEFT JOIN g ON g.r = w.r
"""


ORACLE = _oracle()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
