"""License scan by canonical digest lookup; DataFrame functions only.

A text is brought into a canonical form: lower case, lines that state a copyright removed,
equivalent spellings made one, punctuation and runs of space made one space.
Its SHA-256 digest is hash-joined to the digests of known licence texts, which
went through the same expressions.  The units looked up are each document's
whole text and each of its lines (a one-line notice is an entire text too); all
matches are between entire units, never parts.

Units are exploded from one scan; only matches (a few per document) are grouped
afterwards, so no task gathers a licence's documents.  The known table is a
parameter; Spark chooses a broadcast or shuffled hash join by its size.

Defined cases: a null or empty text and units that are empty in canonical form
match nothing; rows that repeat a doc_id are reported together in each of their
rows; several matches are listed once each in order of name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Public licence texts and the notices that stand for a licence.
KNOWN: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
]

#: Digests of the canonical form of long licence texts, as their publishers spell them.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]

#: Spellings that licence matching treats as the same.
SAME = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("&", " and "),
        ("http://", "https://"), ("favour", "favor"), ("judgement", "judgment"), ("fulfil ", "fulfill ")]
#: Lines that state a copyright: by year, sign, placeholder or "by", and "all rights reserved" alone. Lines of a licence that
#: merely start with the word ("copyright notice and this permission notice ...") stay.
_COPYRIGHT = (r"(?m)^[ \t]*((copyright|copr\.?|\(c\)|©)[ \t]*[:,]?[ \t]*(\(c\)|©|[12][0-9]{3}|[\[<{(]?(yyyy|year)|by[ \t]|copyright)[^\n]*"
              r"|all rights reserved\.?[ \t]*)$")


def canonical_lines(text: Column) -> Column:
    """Canonical text that still has its line breaks."""
    t = F.lower(text)
    t = F.regexp_replace(t, _COPYRIGHT, "")
    for old, new in SAME:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def _digests(lined: Column) -> Column:
    """Array of (scope, digest) of the whole text and of every line; empty units are left out."""
    whole = F.trim(F.regexp_replace(lined, r"[ \n]+", " "))
    unit = lambda scope, t: F.struct(F.lit(scope).alias("scope"), F.when(t != "", F.sha2(t, 256)).alias("digest"))
    lines = F.transform(F.split(lined, "\n"), lambda x: unit("line", F.trim(x)))
    return F.filter(F.concat(F.array(unit("text", whole)), lines), lambda u: u["digest"].isNotNull())


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN,
                  digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(license, digest) of the known texts, through the same expressions as the documents, and the digests given."""
    rows = spark.createDataFrame(known, "license string, text string")
    own = rows.select("license", F.inline(F.slice(_digests(canonical_lines(F.col("text"))), 1, 1))).select("license", "digest")
    return own.unionByName(spark.createDataFrame(digests, "license string, digest string")).distinct()


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, notices, notice_lines): one row per row of ``docs``.

    ``license`` names the licence whose text the document is, ``notices`` the
    licences (sorted, joined by ``|``) that one of its lines states.
    """
    lined = docs.select(F.col(doc_id).alias("id"), canonical_lines(F.col(text).cast("string")).alias("t"))
    units = lined.select("id", F.inline(_digests(F.col("t"))))
    hits = units.join(known, "digest").groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("scope") == "text", F.col("license")))), "|").alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("scope") == "line", F.col("license")))), "|").alias("notices"),
        F.sum((F.col("scope") == "line").cast("long")).alias("notice_lines"))
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    return ids.join(hits, ids.doc_id.eqNullSafe(hits.id), "left").select(
        "doc_id", empty("license"), empty("notices"), F.coalesce("notice_lines", F.lit(0)).alias("notice_lines"))
