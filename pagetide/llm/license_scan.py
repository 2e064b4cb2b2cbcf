"""Licence scan: canonical digests of entire texts, joined to digests of known licences.

A canonical text has no copyright lines, no punctuation, no capitals, one
spelling for words that licences write in several ways, and single blanks.
What is looked up is the whole text of a document and each of its lines by
itself, as a notice stands on a line of its own.  The lookup is a hash join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.once import let, once
from pagetide.llm.shared import lower_ascii

# Lines that only say whose work it is, spellings that mean the same, and known texts.
COPYRIGHT_LINE = r"^[^0-9a-z]*(copyright|\(c\)|©|all rights reserved)"
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("behaviour", "behavior"), ("favour", "favor"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("https", "http"),
)
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _plain(line: Column) -> Column:
    """A line without capitals and punctuation; empty if it is a copyright line."""
    low = lower_ascii(line)
    plain = F.trim(F.regexp_replace(low, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))
    owned = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved"))
    return F.when(owned & low.rlike(COPYRIGHT_LINE), "").otherwise(plain)


def _digest(plain: Column) -> Column:
    """SHA-256 of plain text in one spelling; null for an empty one."""
    out = F.concat(F.lit(" "), plain, F.lit(" "))
    for variant, word in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {word} "))
    return F.when(plain != "", F.sha2(F.trim(out), 256))


def digests(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds digest (of the whole canonical text, null if nothing is left of it) and line_digests (of its distinct lines)."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _plain)
    plain = once(texts, F.filter(lines, lambda x: x != "").alias("_lines"))
    return plain.select(
        *texts.columns, let(F.array_join("_lines", " "), _digest).alias("digest"),
        F.transform(F.array_distinct("_lines"), _digest).alias("line_digests"))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license_id and digest of known texts, one row per digest."""
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    return digests(texts).filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of documents, by whole text and by line.

    `known` has license_id and digest, any number of rows.  Returns one row per
    input row: id, digest (of the whole canonical text; null for null, empty or
    punctuation-only texts), license_id (of the whole text, null if unknown),
    notices (sorted distinct license_ids of single lines, empty if none).
    Repeated ids share the notices of all their rows, as do null ids.  More
    columns are ignored.
    """
    read = digests(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    whole = read.select(F.col("_id").alias(id_col), "digest")
    notices = (
        read.select("_id", F.explode("line_digests").alias("digest")).join(known, "digest").groupBy("_id")
        .agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    )
    found = whole.join(known, "digest", "left").join(notices, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return found.select(id_col, "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
