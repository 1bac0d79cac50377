"""Licence scan by a positional index of rare licence words, on Spark SQL functions alone.

A template is a label, a licence line or a whole licence text, and its key phrases:
ranges of its words that must stand consecutively, all of them at their places.
Document frequencies of all licence words are counted over the whole corpus. The
index holds, for each template, its `RARE` words with the highest IDF and the rarest
word of each key phrase, its anchor, with all their positions.

A file looks up its `LOOKED_UP` licence words with the highest IDF, and the anchors it
holds, so that no place of a key phrase is missed. Each occurrence proposes alignments
(its position in the file less its positions in the template); where postings meet in
one alignment, the key phrases are verified at their relative positions.

The score is the highest IDF-weighted share of a template's indexed words that stand
aligned where its key phrases do: 1 for a whole template, 0 without any.

Defined cases: a null or empty text has no words, null positions, empty labels
and score 0; null ids are kept; ties of IDF go to the word that sorts first; repeated rows are scanned
each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiomark.llm.common import A_Z, read

#: A word: ASCII letters and digits, and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, LOOKED_UP = 12, 8
#: Kelvin sign, capital I with a dot: beyond ASCII, but their lower case is not.
OTHER_CAPITALS = "\u212a\u0130"


class Template(NamedTuple):
    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(LICENSE_WORD, self.text.lower())

    @property
    def places(self) -> list[tuple[int, list[str]]]:
        """(first position, words) of each key phrase."""
        w, out = self.words, []
        for key in self.keys:
            k = re.findall(LICENSE_WORD, key.lower())
            out.append((next(i for i in range(len(w)) if w[i : i + len(k)] == k), k))
        return out


# Labels, licence lines and texts, and their key phrases.
TEMPLATES = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "text:mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge", "this permission notice shall be included", "merchantability fitness for a particular purpose and noninfringement"),
    ),
    Template(
        "text:isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS.""",
        ("for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "text:bsd-2",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    Template(
        "text:apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ("licensed under the apache license version 2 0", "unless required by applicable law or agreed to in writing"),
    ),
    Template(
        "text:gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ("gnu general public license as published by the free software foundation", "distributed in the hope that it will be useful"),
    ),
    Template(
        "text:mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"),
    ),
)


def words_of(text):
    """Words in lower case; only what A to Z become matters, as licence words are ASCII.

    The two other letters whose lower case begins in ASCII are set aside first."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    for c in OTHER_CAPITALS:
        t = F.replace(t, F.lit(c), F.lit("\u00e5"))
    return F.regexp_extract_all(F.lower(t), F.lit(LICENSE_WORD), F.lit(0))


def frequencies(df: DataFrame, templates: Sequence[Template], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, in how many of them each licence word stands); one row per licence word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    # The empty string counts the documents.
    counted = dict(df.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect())
    return counted.get("", 0), {w: counted.get(w, 0) for w in vocabulary}


class Index:
    """Postings of the rare words of templates: by template, word and position; words in order of IDF, the highest first."""

    def __init__(self, templates: Sequence[Template], documents: int, frequency: dict[str, int]):
        self.idf = {w: math.log((documents + 1) / (n + 1)) + 1 for w, n in frequency.items()}
        rank = lambda w: (frequency[w], w)
        self.anchors = sorted({min(key, key=rank) for t in templates for _, key in t.places})
        self.postings: list[dict[str, list[int]]] = []
        for t in templates:
            rare = set(sorted(set(t.words), key=rank)[:RARE]) | {min(key, key=rank) for _, key in t.places}
            self.postings.append({w: [i for i, x in enumerate(t.words) if x == w] for w in sorted(rare)})
        self.ranked = sorted({w for p in self.postings for w in p}, key=rank)


def _strings(words: Sequence[str]):
    return F.array(*map(F.lit, words))


def _aligned(t: Template, postings: dict[str, list[int]], idf: dict[str, float]):
    """(places of t's first key phrase where all its key phrases stand, the best share there) from _hits and _words."""
    rare, mass = sorted(postings), sum(idf[w] * len(at) for w, at in postings.items())
    at = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*map(F.lit, postings[w])))])
    own = F.filter("_hits", lambda h: h["w"].isin(rare))
    starts = F.array_distinct(F.flatten(F.transform(own, lambda h: F.transform(at[h["w"]], lambda j: h["i"] - j))))

    def verified(s):
        fine = F.lit(True)
        for first, key in t.places:
            fine = fine & (s + first >= 0) & (F.slice("_words", F.greatest(s + first, F.lit(0)) + 1, F.lit(len(key))) == _strings(key))
        return fine

    def share(s):
        got = F.lit(0.0)
        for w in rare:
            for j in postings[w]:
                got = got + F.when(F.when(s + j >= 0, F.get("_words", s + j)) == w, idf[w] / mass).otherwise(0.0)
        return got

    first, key = t.places[0]
    good = F.filter(starts, verified)
    span = F.transform(good, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), (s + first).cast("long").alias("first"), F.lit(len(key)).cast("long").alias("length")))
    return span, F.coalesce(F.array_max(F.transform(good, share)), F.lit(0.0))


def scan(df: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (label, base, first word and length of the first key phrase of each template found), score."""
    index = Index(templates, *frequencies(df, templates, text_col))
    d = df.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("_words"))
    held = F.slice(F.array_intersect(_strings(index.ranked), F.col("_words")), 1, LOOKED_UP)
    d = d.withColumn("_look", F.array_union(held, F.array_intersect(_strings(index.anchors), F.col("_words"))))
    hit = lambda w, i: F.when(w.isin(index.ranked) & F.array_contains("_look", w), F.struct(i.alias("i"), w.alias("w")))
    d = d.withColumn("_hits", F.when(F.size("_look") > 0, F.array_compact(F.transform("_words", hit))).otherwise(F.array().cast("array<struct<i:int,w:string>>")))
    spans, shares = zip(*(_aligned(t, p, index.idf) for t, p in zip(templates, index.postings, strict=True)), strict=True)
    some = F.size("_hits") > 0
    none = F.array().cast("array<struct<label:string,base:boolean,first:bigint,length:bigint>>")
    return d.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(some, F.concat(*spans)).otherwise(none).alias("spans"), F.when(some, F.least(F.lit(1.0), F.round(F.greatest(*shares), 6))).otherwise(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    s = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    places = F.transform(base, lambda x: x["first"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    return s.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )


def _sql() -> str:
    words = ", ".join(f"({k}, {i}, '{w}')" for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    keys = ", ".join(f"({k}, {n}, {first + i}, '{w}')" for k, t in enumerate(TEMPLATES) for n, (first, key) in enumerate(t.places) for i, w in enumerate(key))
    heads = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.places[0][0]}, {sum(len(key) for _, key in t.places)})" for k, t in enumerate(TEMPLATES))
    return f"""
WITH t(k, i, w) AS (VALUES {words}), kw(k, n, i, w) AS (VALUES {keys}), hd(k, label, base, f, n_key) AS (VALUES {heads}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_Z[0]}', '{A_Z[1]}'), '{LICENSE_WORD}') AS words FROM documents),
vocab AS (SELECT DISTINCT w FROM t),
tok AS (SELECT r, w, p FROM (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM d) WHERE w IN (SELECT w FROM vocab)),
idf AS (SELECT w, count(DISTINCT r) AS df, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT r) + 1)) + 1 AS idf FROM vocab LEFT JOIN tok USING (w) GROUP BY w),
anchor AS (SELECT DISTINCT k, w FROM (SELECT k, n, w, row_number() OVER (PARTITION BY k, n ORDER BY df, w) AS o FROM kw JOIN idf USING (w)) WHERE o = 1),
rare AS (SELECT k, w FROM (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY df, w) AS o FROM (SELECT DISTINCT k, w FROM t) JOIN idf USING (w)) WHERE o <= {RARE} UNION SELECT k, w FROM anchor),
post AS (SELECT t.k, t.i, t.w, idf FROM t JOIN rare USING (k, w) JOIN idf USING (w)),
mass AS (SELECT k, sum(idf) AS mass FROM post GROUP BY k),
own AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY df, w) AS o FROM (SELECT DISTINCT r, w FROM tok WHERE w IN (SELECT w FROM post)) JOIN idf USING (w)),
look AS (SELECT r, w FROM own WHERE o <= {LOOKED_UP} OR w IN (SELECT w FROM anchor)),
cand AS (SELECT DISTINCT tok.r, post.k, tok.p - post.i AS s FROM tok JOIN look USING (r, w) JOIN post USING (w)),
good AS (SELECT cand.r, cand.k, cand.s FROM cand JOIN kw ON kw.k = cand.k JOIN tok ON tok.r = cand.r AND tok.p = cand.s + kw.i AND tok.w = kw.w JOIN hd ON hd.k = cand.k GROUP BY cand.r, cand.k, cand.s HAVING count(*) = any_value(n_key)),
fit AS (SELECT g.r, g.k, g.s, sum(CASE WHEN tok.w IS NOT NULL THEN idf ELSE 0 END) / any_value(mass) AS part FROM good g JOIN post ON post.k = g.k JOIN mass ON mass.k = g.k
  LEFT JOIN tok ON tok.r = g.r AND tok.p = g.s + post.i AND tok.w = post.w GROUP BY g.r, g.k, g.s),
found AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s + f) FILTER (WHERE base) AS first_word, max(s + f) FILTER (WHERE base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, least(1.0, round(max(part), 6)) AS score
  FROM fit JOIN hd USING (k) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)"""


SQL = _sql()
