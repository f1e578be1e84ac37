"""Operator 8, licence scans: TF-IDF cosine to templates, then inheritance by directory.  DataFrame functions only.

A file's units are its sentences (cut at line ends too), its paragraphs with their
lines joined, which header blocks and licence texts are, and, for a file named like
a licence file, its whole text.  Each unit is a vector of TF-IDF weights, (1 + ln tf)
* idf, and so is each template: a notice, an SPDX line, a title, a standard header or
a licence's body.  A join on terms gives the dot products, and a unit at `threshold` or
more declares its best template's licence; a file has its best unit's (ties: sentences,
then paragraphs, by their place, by name).

A unit can only reach the threshold if the terms it shares with a template hold
threshold**2 of the template's squared norm.  So of each template the commonest terms
that hold less than that together may be left aside, and a unit without any of the
others, the `anchors`, is not scored: an exact filter.  Nor can it if less than
threshold**2 of its own squared norm is on terms of templates at all; as (1 + ln tf)**2
is at most 1.48 tf and no term weighs more than an unknown one, counting them tells
(`mostly_known`).

A file speaks for its directory if it is named like a licence file or declares its
licence at its edge, in one of its first or last `edge` units of that kind: headers and
closing notices.  The licence that most such files of a directory have (ties to the
smaller name) goes to the files without one there and in the directories below, from
the nearest one above.

The inverse document frequencies are those of the templates; a term of no template
weighs most, so other words in a unit lower its cosine.  Null and empty texts
declare nothing; null parts of a path count as ''.  Repeated rows give repeated
results.  Hot directories are resolved once, not once a file.  Extra columns pass through;
one named like a result comes out with `_in` after its name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .carry import REST, packed, unpacked
from .session import cut

# Fixed texts: the licences' own words.
MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)
BSD_2_BODY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_3_END = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License."
)
MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


def gnu_header(name: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def spdx(*identifiers: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {x}" for x in identifiers)


#: Licence: its texts, in the forms that files have them in.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (*spdx("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", gnu_header("Affero", 3)),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", *spdx("Apache-2.0"), "Apache License Version 2.0, January 2004", APACHE_HEADER),
    "BSD-2-Clause": (*spdx("BSD-2-Clause"), "BSD 2-Clause License", BSD_2_BODY),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", *spdx("BSD-3-Clause"), "BSD 3-Clause License", f"{BSD_2_BODY} {BSD_3_END}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", *spdx("CC-BY-4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", *spdx("CC-BY-NC-4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", *spdx("CC-BY-SA-4.0")),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright to this work under CC0 1.0.", *spdx("CC0-1.0")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *spdx("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", gnu_header("", 2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *spdx("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", gnu_header("", 3)),
    "ISC": (*spdx("ISC"), "ISC License", ISC_BODY),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *spdx("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", gnu_header("Lesser", 3)),
    "MIT": ("Released under the MIT License.", *spdx("MIT"), "MIT License", "The MIT License (MIT)", MIT_BODY),
    "MPL-2.0": ("This work is subject to the terms of the Mozilla Public License, version 2.0.", *spdx("MPL-2.0"), "Mozilla Public License Version 2.0", MPL_HEADER),
    "Unlicense": (*spdx("Unlicense"), "This is free and unencumbered software released into the public domain."),
}
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)\b"
#: A sentence's end, which becomes a line end; what parts paragraphs.
SENTENCE_END = r"([.!?])[\x20\x09-\x0D]+"
PARAGRAPH = r"\n[\x20\x09\x0B-\x0D]*\n"
SENTENCE, PARAGRAPHS, WHOLE = 0, 1, 2
OWN = ["key", "path", "own_licence", "own_similarity", "licence", "inherited_from"]


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def template_weights(templates: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """((licence, number of the text, term, idf, weight over the text's norm) rows, idf of other terms)."""
    texts = [(name, terms(t)) for name, ts in sorted(templates.items()) for t in ts]
    df: dict[str, int] = {}
    for _, ws in texts:
        for x in set(ws):
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log((1 + len(texts)) / (1 + n)) + 1 for x, n in df.items()}
    rows = []
    for number, (name, ws) in enumerate(texts):
        w = {x: (1 + math.log(ws.count(x))) * idf[x] for x in dict.fromkeys(ws)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows += [(name, number, x, idf[x], v / norm) for x, v in w.items()]
    return rows, math.log(1 + len(texts)) + 1


#: Common words of any English text, the commonest first: of a template these are left aside first.
COMMON = tuple(
    "the of and to in a is it that for was on as with be by at this are not from or you have an which all if has one can so will they may its into see "
    "must do no only who some there such other used made name use file free form work your following provided without shall either".split()
)


def anchors(rows: list[tuple[str, int, str, float, float]], threshold: float) -> list[str]:
    """Terms of which a unit at the threshold has one: of each template all but the commonest of less than threshold**2 together."""
    out = set()
    for number in {r[1] for r in rows}:
        room = threshold * threshold - 1e-9
        for _, _, x, idf, w in sorted((r for r in rows if r[1] == number), key=lambda r: (COMMON.index(r[2]) if r[2] in COMMON else len(COMMON), r[3], r[2])):
            if w * w < room:
                room -= w * w
            else:
                out.add(x)
    return sorted(out)


def mostly_known(words: Column, vocabulary: list[str], threshold: float) -> Column:
    """Whether the words of templates can hold threshold**2 of the squared norm: false only where they cannot."""
    known = F.size(F.filter(words, lambda x: x.isin(vocabulary)))
    others = F.size(F.array_except(words, F.array(*[F.lit(x) for x in vocabulary])))
    return (1 - threshold * threshold) * 1.48 * known >= threshold * threshold * others


def units(files: DataFrame) -> DataFrame:
    """(key, file, kind, of, pos, unit) of files (key, file, text), of being the number of units of that kind."""
    text = F.col("text")
    sentences = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    whole = F.when(F.col("file").rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    kinds = [F.struct(F.lit(kind).alias("kind"), parts.alias("parts")) for kind, parts in ((SENTENCE, sentences), (PARAGRAPHS, F.split(text, PARAGRAPH)), (WHOLE, whole))]
    each = files.select("key", "file", F.explode(F.array(*kinds)).alias("k")).select("key", "file", "k.kind", F.size("k.parts").alias("of"), F.col("k.parts").alias("parts"))
    return each.select("key", "file", "kind", "of", F.posexplode("parts").alias("pos", "unit"))


def declared(files: DataFrame, templates: dict[str, tuple[str, ...]], threshold: float, edge: int) -> DataFrame:
    """(key, licence, similarity, speaks) of each of files (key, path, text) that declares one."""
    rows, other = template_weights(templates)
    # the templates' terms: as many rows as their words
    table = F.broadcast(files.sparkSession.createDataFrame([(n, i, x, w) for n, i, x, _, w in rows], "name string, number int, term string, weight double"))
    idf = F.broadcast(files.sparkSession.createDataFrame(sorted({(x, v) for _, _, x, v, _ in rows}), "term string, idf double"))
    marks = F.array(*[F.lit(x) for x in anchors(rows, threshold)])
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    told = units(files.where(F.arrays_overlap(words("text"), marks)).select("key", name.alias("file"), "text"))
    own = ["key", "kind", "pos"]
    said = told.select(*own, "file", "of", words("unit").alias("w")).where(F.arrays_overlap("w", marks) & mostly_known(F.col("w"), sorted({r[2] for r in rows}), threshold))
    tf = said.select(*own, "file", "of", F.explode("w").alias("term")).groupBy(*own, "term").agg(F.count("*").alias("tf"), F.first("file").alias("file"), F.first("of").alias("of")).join(idf, "term", "left")
    tf = tf.withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).drop("idf")
    tf = tf.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*own))))
    dots = tf.join(table, "term").groupBy(*own, "name", "number").agg((F.sum(F.col("w") * F.col("weight")) / F.first("norm")).alias("similarity"), F.first("file").alias("file"), F.first("of").alias("of"))
    dots = dots.withColumn("similarity", F.round("similarity", 9)).where(F.col("similarity") >= threshold)
    speaks = F.col("file").rlike(LICENCE_FILE) | (F.col("pos") < edge) | (F.col("pos") >= F.col("of") - edge)
    top = dots.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "kind", "pos", "name", speaks.alias("speaks"))).alias("top"))
    return top.select("key", F.col("top.name").alias("licence"), (-F.col("top.s")).alias("similarity"), F.col("top.speaks").alias("speaks"))


def ancestors(directory: Column) -> Column:
    """The directory and those above it, '' last."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))
    return F.concat(F.filter(up, lambda x: x != ""), F.array(F.lit("")))


def license_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.7, edge: int = 2) -> DataFrame:
    """files (key, path, text, ...) with own_licence, own_similarity, licence and inherited_from, without text.

    key: alike only for rows with the same path and text.
    """
    rest = [c for c in files.columns if c not in ("key", "path", "text")]
    files = files.select("key", F.coalesce("path", F.lit("")).alias("path"), F.col("text").cast("string").alias("text"), packed(rest))
    base = files.select("key", "path", REST, F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"))
    own = cut(declared(files.select("key", "path", "text"), templates or TEMPLATES, threshold, edge))
    named = base.join(own, "key", "left")
    votes = named.where("speaks").groupBy("directory", "licence").agg(F.count("*").alias("n"))
    spoken = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("n"), "licence")).alias("v")).select(F.col("directory").alias("above"), F.col("v.licence").alias("given"))
    lookups = base.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "above"))
    nearest = lookups.join(spoken, "above").groupBy("directory").agg(F.min(F.struct("up", "above", "given")).alias("n"))
    nearest = nearest.select("directory", F.col("n.above").alias("above"), F.col("n.given").alias("given"))
    out = named.join(nearest, "directory", "left")
    return out.select("key", "path", *unpacked(rest, OWN), F.col("licence").alias("own_licence"), F.col("similarity").alias("own_similarity"), F.coalesce("licence", "given").alias("licence"), F.when(F.col("licence").isNull(), F.col("above")).alias("inherited_from"))


def document_path() -> Column:
    """source/lang/hundred/doc_id: the tables have no file names, so the directories are made of these."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", document_path().alias("path"), "text").withColumn("key", F.xxhash64("path", "text"))
    return license_scan(files).drop("key").withColumn("own_similarity", F.round("own_similarity", 6))


def _sql() -> str:
    rows, other = template_weights(TEMPLATES)
    values = ", ".join(f"('{n}', {i}, '{x}', {v!r}::DOUBLE, {w!r}::DOUBLE)" for n, i, x, v, w in rows)
    return rf"""
WITH t(name, number, term, idf, weight) AS (VALUES {values}),
f AS (
  SELECT row_number() OVER () AS r, doc_id, text,
         coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(floor(doc_id / 100)::BIGINT::VARCHAR, '') AS dir,
         coalesce(doc_id::VARCHAR, '') AS file
  FROM documents
), p AS (
  SELECT r, 0 AS kind, string_split(regexp_replace(text, '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)) AS us FROM f
  UNION ALL SELECT r, 1, string_split_regex(text, '{PARAGRAPH}') FROM f
), s AS (
  SELECT r, kind, len(us) AS "of", unnest(us) AS unit, unnest(range(len(us))) AS pos FROM p
), w AS (
  SELECT r, kind, pos, any_value("of") AS "of", term, count(*) AS tf
  FROM (SELECT r, kind, pos, "of", unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM s)
  GROUP BY r, kind, pos, term
), i AS (SELECT DISTINCT term, idf FROM t),
x AS (SELECT r, kind, pos, "of", term, (1 + ln(tf)) * coalesce(idf, {other!r}::DOUBLE) AS w FROM w LEFT JOIN i USING (term)),
n AS (SELECT r, kind, pos, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL),
d AS (
  SELECT r, kind, pos, name, number, any_value("of") AS "of", round(sum(w * weight) / any_value(norm), 9) AS similarity
  FROM x JOIN t USING (term) JOIN n USING (r, kind, pos) GROUP BY r, kind, pos, name, number
), o AS (
  SELECT r, name AS licence, similarity, pos < 2 OR pos >= "of" - 2 AS speaks
  FROM d WHERE similarity >= 0.7 QUALIFY row_number() OVER (PARTITION BY r ORDER BY similarity DESC, kind, pos, name) = 1
), v AS (
  SELECT dir, licence, count(*) AS n FROM f JOIN o USING (r) WHERE speaks GROUP BY ALL
), g AS (
  SELECT dir AS above, licence AS given FROM v QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, licence) = 1
), a AS (
  SELECT DISTINCT dir, unnest([dir, regexp_extract(dir, '^(.*)/[^/]*$', 1), split_part(dir, '/', 1), '']) AS above, unnest([0, 1, 2, 3]) AS up FROM f
), b AS (
  SELECT dir, above, given FROM a JOIN g USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY up) = 1
)
SELECT doc_id, dir || '/' || file AS path, licence AS own_licence, round(similarity, 6) AS own_similarity,
       coalesce(licence, given) AS licence, CASE WHEN licence IS NULL THEN above END AS inherited_from
FROM f LEFT JOIN o USING (r) LEFT JOIN b USING (dir)
"""


OP8_SQL = _sql()
