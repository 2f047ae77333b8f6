"""Licence scan by canonical digest. Spark functions only.

A text is brought to a canonical form: lower case, no copyright lines, punctuation as
blanks, equivalent spellings made one. The digest of the whole canonical text is looked up
by a hash join among the digests of known licences. The whole document and each of its
lines count as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that licence texts use alike, first form -> second form.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized",
    "organisation": "organization", "recognised": "recognized", "favour": "favor", "fulfil": "fulfill",
    "judgement": "judgment", "labour": "labor", "merchantibility": "merchantability", "modelled": "modeled",
    "programme": "program", "whilst": "while", "wilful": "willful", "analyse": "analyze", "artefact": "artifact",
    "centre": "center", "colour": "color", "behaviour": "behavior", "https": "http",
}

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

# Licence id and a text that stands for it, a notice or the whole licence.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
_SPELL = "|".join(sorted(SPELLINGS, key=lambda w: (-len(w), w)))


def canonical(text: Column) -> Column:
    """The canonical form: words with one blank between them."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}]+", " "))

    def respelt(x: Column) -> Column:
        out = x
        for old, new in SPELLINGS.items():
            out = F.regexp_replace(out, rf"\b{old}\b", new)
        return F.when(x.rlike(rf"\b({_SPELL})\b"), out).otherwise(x)

    return F.transform(F.array(words), respelt)[0]      # the lambda computes the words once


def known_digests(spark: SparkSession) -> DataFrame:
    """license, digest: one row per different canonical text, as many as KNOWN at most."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, whole_license (the licence that the whole text is, or null), licenses
    (ids found in the whole text or a line, sorted, joined by commas; empty if none), n_notices
    (lines that are a notice). Texts without a word, null ones included, match nothing.

    Documents keep to their row: lines are matched apart from the texts and only hits travel.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = F.broadcast(known_digests(docs.sparkSession))           # as many rows as KNOWN
    key = F.xxhash64("text").alias("h")
    units = rows.select("doc_id", key, F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("at", "unit"))
    hits = (units.select("doc_id", "h", "at", F.sha2(canonical(F.col("unit")), 256).alias("digest"))
            .join(known, "digest").groupBy("doc_id", "h")
            .agg(F.max(F.when(F.col("at") == 0, F.col("license"))).alias("whole_license"),
                 F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
                 F.count_distinct(F.when(F.col("at") > 0, F.col("at"))).alias("n_notices")))
    a, b = rows.select("doc_id", key).alias("a"), hits.alias("b")
    return (a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left")
            .select("a.doc_id", "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
                    F.coalesce("n_notices", F.lit(0)).alias("n_notices")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return "array_to_string(list_transform(string_split(" + out + ", ' '), lambda w: coalesce(" \
        "map {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}[w], w)), ' ')"


ORACLE = f"""
WITH known AS (SELECT DISTINCT license, sha256({_sql_canonical('t')}) AS digest
  FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}) AS k(license, t)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT r, 0 AS pos, t AS unit FROM d UNION ALL
      SELECT r, i, ls[i] FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i
                               FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d))),
hit AS (SELECT r, max(CASE WHEN pos = 0 THEN license END) AS whole_license,
          string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT CASE WHEN pos > 0 THEN pos END) AS n_notices
        FROM u JOIN known ON sha256({_sql_canonical('unit')}) = digest GROUP BY r)
SELECT doc_id, whole_license, coalesce(licenses, '') AS licenses, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM d LEFT JOIN hit ON d.r = hit.r
"""
