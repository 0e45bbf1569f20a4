"""License scans with DataFrame functions alone.

Lines, windows of two and three lines (headers that are wrapped) and whole texts (licence files) are compared with
templates, statements and whole licences, by the cosine of sparse TF-IDF vectors; document frequencies are counted over all files.  A file without a match of its own inherits the
licence of the nearest directory above it that has a licence file: the directories' chains of ancestors are
joined by path, then files join their own directory.

A term outside the templates counts in the norm as the rarest term would.  Terms are chosen as anchors, heaviest
first, until the others hold less than the threshold's square of every template's norm; by Cauchy-Schwarz no
line or text without an anchor can reach the threshold, so only files with one are looked at line by line.

Defined cases: a null or empty text matches nothing and can still inherit; a null path lies in the root
directory; a null id is an id like any other, and rows that share an id are told apart by their texts; repeated rows
each get the same answer; a very long text is looked at whole, by all its lines, and only if it has an anchor; among equal
scores the licence's name decides; several licence files in a directory: the best score, then the name; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence names and the statements they are known by.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Whole licences, without the lines of years and owners.
WHOLE = (
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)
THRESHOLD = 0.75
#: Lines of a window, at most.
LINES = 3
#: Names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)([.-].*)?$"
_BREAK = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    """Lower-case ASCII words of a text, with repeats."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda t: t != "")


def _template_terms() -> list[dict[str, int]]:
    out = []
    for _, text in TEMPLATES + WHOLE:
        count: dict[str, int] = {}
        for t in re.split(_BREAK, text.lower()):
            if t:
                count[t] = count.get(t, 0) + 1
        out.append(count)
    return out


def weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """idf of each template term over all files, and that of a term no file has; the driver sees one count a template term."""
    vocabulary = sorted(set().union(*_template_terms()))
    known = F.array(*map(F.lit, vocabulary))
    has = files.select(F.explode(F.array_intersect(terms("text"), known)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = files.count()
    found = {r.term: r.n for r in has.collect()}
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    return {t: idf(found.get(t, 0)) for t in vocabulary}, idf(0)


def anchors(idf: dict[str, float], threshold: float) -> list[str]:
    """Terms without any of which no template can be matched."""
    chosen: set[str] = set()
    for count in _template_terms():
        square = {t: (c * idf[t]) ** 2 for t, c in count.items()}
        total, left = sum(square.values()), sum(v for t, v in square.items() if t not in chosen)
        for t in sorted(square, key=lambda t: (-square[t], t)):
            if left < 0.999 * threshold**2 * total:
                break
            if t not in chosen:
                chosen.add(t)
                left -= square[t]
    return sorted(chosen)


def windows(text: Column) -> Column:
    """The lines of a text, its windows of two and more lines (null where the text ends before), and the whole text."""
    lines = F.split(text, "\n")
    found, own = [lines], lines
    for k in range(1, LINES):  # each line is joined to the line k below it: linear in the text
        own = F.zip_with(own, F.slice(lines, F.lit(k + 1), F.size(lines)), lambda above, line: F.concat(above, F.lit(" "), line))
        found.append(own)
    return F.concat(*found, F.array(text))


def matches(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, own_license, own_score: the best match of any line, window of lines or of the whole text, for files(id, text) that have one.

    Rows of an id that repeat a text multiply all its counts alike, which changes no cosine.
    """
    spark = files.sparkSession
    idf, rarest = weights(files)
    needed = F.array(*map(F.lit, anchors(idf, threshold)))
    rows = [(k, name, t, float(c * idf[t]), idf[t], math.sqrt(sum((n * idf[x]) ** 2 for x, n in count.items()))) for k, ((name, _), count) in enumerate(zip(TEMPLATES + WHOLE, _template_terms(), strict=True)) for t, c in count.items()]
    template = spark.createDataFrame(rows, "template int, license string, term string, weight double, idf double, norm double")
    idfs = F.broadcast(template.select("term", "idf").distinct())  # a fixed number of rows
    likely = files.where(F.arrays_overlap(terms("text"), needed))
    units = likely.select("id", F.posexplode(windows(F.col("text"))).alias("unit", "line"))
    line = units.select("id", "unit", terms("line").alias("t")).where(F.arrays_overlap("t", needed))
    tf = line.select("id", "unit", F.explode("t").alias("term")).groupBy("id", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(idfs, "term", "left")
    # repeats of a term outside the templates count as they do inside: by the square of their number
    norms = weighed.groupBy("id", "unit").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(rarest)), F.lit(2.0)))).alias("size"))
    dots = weighed.where("idf is not null").select("id", "unit", "term", "tf", "idf").join(F.broadcast(template.drop("idf")), "term")
    dot = dots.groupBy("id", "unit", "license", "template", "norm").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    cosine = dot.join(norms, ["id", "unit"]).select("id", "license", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("score")).where(F.col("score") >= threshold)
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("best"))
    return best.select("id", F.col("best.license").alias("own_license"), (-F.col("best.order")).alias("own_score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, path, own_license, own_score, license and licensed_by (header, file or the directory it comes from) of files(id, path, text)."""
    # a file is its id and text; 128 bits tell them apart, with or without an id
    file = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    found = matches(files.select(file.alias("id"), "text"), threshold).withColumnRenamed("id", "file")
    path = F.coalesce("path", F.lit(""))
    placed = files.select("id", file.alias("file"), path.alias("path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"))
    own = placed.join(found, "file", "left")
    by_file = own.where(F.col("own_license").isNotNull() & F.col("name").rlike(LICENCE_FILE))
    of_dir = by_file.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("order"), "own_license")).alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.own_license").alias("inherited"))
    part = F.split("dir", "/")
    chain = placed.select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(part)))).alias("depth")).select("dir", "depth", F.array_join(F.slice(part, F.lit(1), F.col("depth")), "/").alias("ancestor"))
    nearest = chain.join(of_dir, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "inherited")).alias("near")).select("dir", F.col("near.ancestor").alias("from_dir"), F.col("near.inherited").alias("inherited"))
    out = own.join(nearest, "dir", "left")
    by = F.when(F.col("own_license").isNotNull(), F.when(F.col("name").rlike(LICENCE_FILE), F.lit("file")).otherwise(F.lit("header"))).otherwise(F.col("from_dir"))
    return out.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), by.alias("licensed_by"))


#: Documents have no paths: a layout by source and id, where ids divisible by 16, 256 and 4096 are the licence files of their directories.
def document_path() -> Column:
    i = F.coalesce(F.col("doc_id"), F.lit(1)).cast("bigint")
    level = lambda n: F.concat(F.lit("/"), F.expr(f"coalesce(cast(doc_id as bigint), 1) div {n}").cast("string"))
    top = F.concat(F.coalesce("source", F.lit("unknown")), level(4096))
    middle, low = F.concat(top, level(256)), F.concat(top, level(256), level(16))
    name = F.concat(F.lit("/doc"), i.cast("string"), F.lit(".txt"))
    return F.when(i % 4096 == 0, F.concat(top, F.lit("/LICENSE"))).when(i % 256 == 0, F.concat(middle, F.lit("/LICENSE"))).when(i % 16 == 0, F.concat(low, F.lit("/LICENSE"))).otherwise(F.concat(low, name))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, license and licensed_by of all documents."""
    files = docs.select(F.col("doc_id").cast("bigint").alias("id"), document_path().alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")


def oracle() -> str:
    """The same scan of documents in DuckDB's SQL, without anchors."""
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES + WHOLE))
    more = "".join(f", list_transform(range(1, len(l) - {n} + 2), lambda i: array_to_string(l[i:i + {n} - 1], ' '))" for n in range(2, LINES + 1))
    words = lambda x: f"unnest(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''))"
    return f"""
WITH template(k, license, words) AS (VALUES {values}),
tt AS (SELECT k, license, term, count(*) AS c FROM (SELECT k, license, {words("words")} AS term FROM template) GROUP BY ALL),
files AS (SELECT doc_id, text, source || '/' || (doc_id // 4096) AS top, '/' || (doc_id // 256) AS b, '/' || (doc_id // 16) AS c FROM documents),
placed AS (SELECT doc_id, CASE WHEN doc_id % 4096 = 0 THEN top || '/LICENSE' WHEN doc_id % 256 = 0 THEN top || b || '/LICENSE'
  WHEN doc_id % 16 = 0 THEN top || b || c || '/LICENSE' ELSE top || b || c || '/doc' || doc_id || '.txt' END AS path FROM files),
df AS (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, {words("text")} AS term FROM documents) WHERE term IN (SELECT term FROM tt) GROUP BY term),
total AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), total),
rarest AS (SELECT ln(1 + n) + 1 AS idf FROM total),
norm AS (SELECT k, sqrt(sum((c * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY k),
lines AS (SELECT doc_id, flatten([l{more}, [text]]) AS u FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
units AS (SELECT doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS unit FROM lines),
tf AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, {words("line")} AS term FROM units) GROUP BY ALL),
size AS (SELECT doc_id, unit, sqrt(sum((tf * coalesce(idf.idf, rarest.idf)) ** 2)) AS size FROM tf LEFT JOIN idf USING (term), rarest GROUP BY ALL),
dot AS (SELECT doc_id, unit, license, k, sum(tf * idf * c * idf) AS dot FROM tf JOIN tt USING (term) JOIN idf USING (term) GROUP BY ALL),
score AS (SELECT doc_id, license, round(dot / (norm * size), 6) AS score FROM dot JOIN size USING (doc_id, unit) JOIN norm USING (k)),
best AS (SELECT doc_id, license AS own_license, score AS own_score FROM score WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, path LIKE '%/LICENSE' AS is_file, own_license, own_score FROM placed LEFT JOIN best USING (doc_id)),
of_dir AS (SELECT dir, own_license AS inherited FROM own WHERE is_file AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
near AS (SELECT o.doc_id, d.dir AS from_dir, d.inherited FROM own o JOIN of_dir d ON o.dir = d.dir OR starts_with(o.dir, d.dir || '/') QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(d.dir) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NULL THEN from_dir WHEN is_file THEN 'file' ELSE 'header' END AS licensed_by
FROM own LEFT JOIN near USING (doc_id)"""
