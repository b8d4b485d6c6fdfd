"""Licence scan by sparse TF-IDF cosine and inheritance from the nearest directory, in DataFrame functions only.

A text with a cue (licence, copyright, SPDX, rights reserved ...) is cut into units: each
line with a cue, each block of lines with a cue, and the whole text.  A unit's terms are
letters and version numbers in lower case, weighted by frequency and by their rarity among
the templates (terms of no template are as rare as can be, so foreign words count against
a match).  Its licence is the template with the largest cosine, if that is at least
``LEAST``.  Weights are whole numbers, so sums are exact in any order; equal units of the
corpus are scored once.

A file's own licence is that of its best unit.  If the unit holds at least half of the
file's words, or the file has a licence file's name, the file also governs its directory.
Files without a licence of their own take that of the nearest directory above them, found
by joining directory names; the lookup is made per directory, not per file, so a directory
with a third of all files is joined once.

Null paths are the root's; null or empty texts have no licence of their own.  Rows with
equal path and text get equal results.  Ties: larger cosine, then the licence's name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm.common import pin, text_of, words

LEAST = 0.6
#: A directory table is broadcast only up to so many rows.
BROADCAST_ROWS = 20_000
TERM = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
CUE = "licen[cs]|copyright|copyleft|all rights reserved|spdx|public domain|redistribution and use|permission is hereby"
FILE_NAME = "^(licen[cs]e|copying|copyright|unlicense|notice)([._-].*)?$"

# Usual licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, "
     "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
     "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
     "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither "
     "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
)


def template_rows() -> tuple[list[tuple[str, int]], list[tuple[int, str, str, int, int]], int]:
    """(term, rarity) of the vocabulary, (template, licence, term, weight, squared norm), and the rarity of other terms."""
    counted = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    n = len(TEMPLATES)
    rarity = lambda df: round(100 * (math.log((n + 1) / (df + 1)) + 1))
    held = Counter(t for c in counted for t in c)
    idf = {t: rarity(df) for t, df in held.items()}
    rows = []
    for i, c in enumerate(counted):
        norm = sum((k * idf[t]) ** 2 for t, k in c.items())
        rows += [(i, TEMPLATES[i][0], t, k * idf[t], norm) for t, k in sorted(c.items())]
    return sorted(idf.items()), rows, rarity(0)


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def units(files: DataFrame) -> DataFrame:
    """(path, text_hash, unit, half) of texts with a cue; ``half`` tells that the unit has half of the words."""
    cue = lambda s: F.lower(s).rlike(CUE)
    marked = files.filter(cue(F.col("text")))
    pieces = F.concat(
        F.filter(F.split("text", "\n"), cue), F.filter(F.split("text", "\n[\\x20\\x09\\x0B-\\x0D]*\n"), cue), F.array("text")
    )
    return marked.withColumn("n", F.size(words(F.col("text")))).select(
        "path", "text_hash", "n", F.explode(F.array_distinct(pieces)).alias("unit")
    ).select("path", "text_hash", "unit", (2 * F.size(words(F.col("unit"))) >= F.col("n")).alias("half"))


def scored_units(distinct: DataFrame) -> DataFrame:
    """(unit_hash, license, score): the best template of each unit that reaches the limit."""
    spark: SparkSession = distinct.sparkSession
    vocabulary, weights, rarest = template_rows()
    idf = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(vocabulary)} AS v(term, idf)"))
    templates = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(weights)} AS v(template, license, term, weight, norm)"))
    terms = distinct.select(
        "unit_hash", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term")
    ).groupBy("unit_hash", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = pin(terms.join(idf, "term", "left").select(
        "unit_hash", "term", (F.col("tf") * F.coalesce("idf", F.lit(rarest))).alias("w")), "unit-terms")
    norms = weighted.groupBy("unit_hash").agg(F.sum(F.col("w") * F.col("w")).alias("unit_norm"))
    dots = weighted.join(templates, "term").groupBy("unit_hash", "template", "license", "norm").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot")
    )
    cosine = F.round(F.col("dot") / (F.sqrt("unit_norm") * F.sqrt("norm")), 4)
    return dots.join(norms, "unit_hash").withColumn("score", cosine).filter(F.col("score") >= LEAST).groupBy("unit_hash").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    ).select("unit_hash", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def own_licences(files: DataFrame) -> DataFrame:
    """(path, text_hash, license, score, governs) of files with a licence of their own."""
    each = pin(units(files).withColumn("unit_hash", F.xxhash64("unit")), "units")
    best = scored_units(each.select("unit_hash", "unit").distinct())
    found = each.select("path", "text_hash", "unit_hash", "half").join(best, "unit_hash")
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(FILE_NAME)
    return found.groupBy("path", "text_hash").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"),
        F.min(F.when(F.col("half"), F.struct((-F.col("score")).alias("s"), "license"))).alias("h"),
    ).select(
        "path", "text_hash", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"),
        (F.col("h").isNotNull() | named).alias("governs"),
    )


def directory(path: Column) -> Column:
    """The part before the last slash; the root is empty."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """(directory, depth) of a directory and all above it, the root included."""
    parts = F.split(folder, "/")
    depth = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(
        F.array_join(F.slice(parts, 1, k), "/").alias("above"), k.alias("depth")))


def inherited(folders: DataFrame, own: DataFrame) -> DataFrame:
    """(folder, from_dir, license): the nearest governed directory at or above each directory."""
    governed = pin(own.filter("governs").groupBy(directory(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    ).select("above", F.col("b.license").alias("license")), "governed")
    lookup = F.broadcast(governed) if governed.count() <= BROADCAST_ROWS else governed
    near = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.above", "a.depth")
    return near.join(lookup, "above").groupBy("folder").agg(
        F.max(F.struct("depth", "above", "license")).alias("m")
    ).select("folder", F.col("m.above").alias("from_dir"), F.col("m.license").alias("inherited"))


def scan(files: DataFrame, path: Column, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, path, license, score, origin and from_dir of every row.

    ``origin`` is file (governs its directory), header, inherited or none.
    """
    rows = files.select(
        *[F.col(c) for c in carry], F.coalesce(path.cast("string"), F.lit("")).alias("path"), text_of(text).alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    own = pin(own_licences(rows.select("path", "text", "text_hash")), "own")
    light = rows.select(*carry, "path", "text_hash", directory(F.col("path")).alias("folder"))
    above = pin(inherited(light.select("folder").distinct(), own), "inherited")
    above = F.broadcast(above) if above.count() <= BROADCAST_ROWS else above
    joined = light.join(own, ["path", "text_hash"], "left").join(above, "folder", "left")
    return joined.select(
        *carry, "path", F.coalesce("license", "inherited").alias("license"), "score",
        F.when(F.col("governs"), "file").when(F.col("license").isNotNull(), "header")
        .when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """Documents as files: source / language / id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("/", part("source"), part("lang"), part("doc_id"))


def _oracle() -> str:
    vocabulary, weights, rarest = template_rows()
    size = lambda c: f"len(list_filter(string_split_regex({c}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
    cue = lambda c: f"regexp_matches(lower({c}), '{CUE}')"
    return f"""
WITH v(term, idf) AS (VALUES {_values(vocabulary)}),
t(template, license, term, weight, norm) AS (VALUES {_values(weights)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') || '/' || coalesce(lang, '') AS folder,
    coalesce(source, '') AS top, coalesce(text, '') AS text FROM documents
), u0 AS (
  SELECT r, text, unnest(list_distinct(list_concat(list_concat(list_filter(string_split(text, chr(10)), lambda x: {cue("x")}),
    list_filter(string_split_regex(text, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n'), lambda x: {cue("x")})), [text]))) AS unit
  FROM d WHERE {cue("text")}
), u AS (SELECT r, unit, 2 * {size("unit")} >= {size("text")} AS half FROM u0),
term AS (SELECT unit, term, count(*) AS tf FROM (
  SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM (SELECT DISTINCT unit FROM u)) GROUP BY ALL),
w AS (SELECT unit, term.term, tf * coalesce(idf, {rarest}) AS w FROM term LEFT JOIN v ON term.term = v.term),
n AS (SELECT unit, CAST(sum(w * w) AS BIGINT) AS unit_norm FROM w GROUP BY ALL),
dot AS (SELECT unit, template, license, norm, CAST(sum(w * weight) AS BIGINT) AS dot FROM w JOIN t ON w.term = t.term GROUP BY ALL),
s AS (
  SELECT dot.unit, license, round(dot / (sqrt(CAST(unit_norm AS DOUBLE)) * sqrt(CAST(norm AS DOUBLE))), 4) AS score
  FROM dot JOIN n ON dot.unit = n.unit
), b AS (SELECT unit, license, score FROM s WHERE score >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1),
own AS (
  SELECT r, license, score, bool_or(half) OVER (PARTITION BY r) AS governs FROM u JOIN b ON u.unit = b.unit
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1
), gov AS (
  SELECT d.folder, license FROM own JOIN d ON own.r = d.r WHERE governs
  QUALIFY row_number() OVER (PARTITION BY d.folder ORDER BY score DESC, license) = 1
)
SELECT d.doc_id, coalesce(own.license, gov.license) AS license, own.score,
  CASE WHEN own.governs THEN 'file' WHEN own.r IS NOT NULL THEN 'header' WHEN gov.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.r IS NULL AND gov.license IS NOT NULL THEN d.folder END AS from_dir
FROM d LEFT JOIN own ON d.r = own.r LEFT JOIN gov ON d.folder = gov.folder
"""


ORACLE = _oracle()
