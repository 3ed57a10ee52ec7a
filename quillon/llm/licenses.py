"""License scans: canonical digests of whole texts, joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of well-known short licences and licence notices, as published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", "text", _MIT),
    ("MIT", "text", "MIT License\n\n" + _MIT),
    ("ISC", "text", _ISC),
    ("ISC", "text", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", "text", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "text", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
)

#: Spellings that count as the same, as (pattern over canonical words, spelling kept).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)

_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters and digits only, one spelling for equivalents."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for had, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {had} "), F.lit(f" {kept} "))
    return F.btrim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id, kind) of known texts, each digest once; the size is that of the given list."""
    rows = spark.createDataFrame(list(known), "license_id string, kind string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id", "kind").groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, n_canonical) of every row: the licence whose canonical text is the whole text.

    ``known`` has unique digests; whichever join its size asks for is left to the planner.  A null or
    wordless text has the digest of the empty string and no licence; an empty table stays empty; rows
    that repeat are scanned alike; other columns are ignored.
    """
    text = canonical(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("c")).select("doc_id", F.sha2("c", 256).alias("digest"), F.length("c").cast("long").alias("n_canonical"))
    return own.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id", "n_canonical")


def scan_notices(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license_id) of every line that is, as a whole, a known licence notice."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "text"))
    # a cheap test first: only lines with a word that every known notice has are digested
    worded = lines.where(F.lower("text").rlike("licen[sc]e|copyright|permission|redistribut"))
    return worded.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2(canonical(F.col("text")), 256).alias("digest")).join(known.where("kind = 'notice'"), "digest").select("doc_id", "line", "license_id")
