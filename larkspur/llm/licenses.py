"""Known licence texts and notices found by canonical digest: DataFrame and SQL functions only.

A text is cut into lines (at LF, CR LF or CR); every line is brought to a canonical form (case, equivalent
spellings, punctuation, white space), empty and copyright lines go, and what is left is hashed.  Blank
lines divide paragraphs.  Digests of the whole text, of its paragraphs, of its lines, and of runs of as
many consecutive paragraphs as a known text has, are joined by hash with the digests of the known texts.
The built-in table has a fixed number of rows, which is why it is broadcast; a caller's table is joined as
the optimizer sees fit.  Every step is linear in the text.

Result, one row per document, scope and licence: doc_id, scope ("text", "passage" for a run of paragraphs,
"paragraph" or "line"; a unit that is at the same time the whole of the larger one counts for the larger
one alone), license_id, kind, n_units.

Defined results: null and empty texts, and texts of copyright lines alone, match nothing; rows with equal
or null doc_id are counted together; known texts without words match nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The public texts of short licences, without their copyright lines, and usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
KNOWN = [
    ("MIT", "license", _MIT),
    ("ISC", "license", _ISC),
    ("BSD-2-Clause", "license", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_TAIL])),
    ("BSD-3-Clause", "license", "\n\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL])),
    ("Zlib", "license", _ZLIB),
    ("Apache-2.0", "notice", _APACHE_NOTICE),
    ("GPL-2.0-or-later", "notice", _GPL.format(v=2)),
    ("GPL-3.0-or-later", "notice", _GPL.format(v=3)),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-only", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    *[(i, "identifier", f"SPDX-License-Identifier: {i}") for i in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "CC-BY-4.0", "CC-BY-NC-4.0")],
]
# Spellings taken as equal, applied in this order to lower-case lines.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("https:", "http:"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("©", "(c)"),
    ("&", "and"),
]
#: Every character outside this class becomes a blank; letters of all alphabets count as wordy.
_BLANKED = r"[^\p{L}\p{N}]+"
_COPYRIGHT = r"^\s*[^\p{L}\p{N}(]*(portions )?(copyright|\(c\))\s*(\(c\)|[0-9]|by |the )"


def _line(c):
    c = F.lower(c)
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.when(F.regexp_like(c, F.lit(_COPYRIGHT)), F.lit("")).otherwise(F.trim(F.regexp_replace(c, _BLANKED, " ")))


#: Ends of lines, and lines that divide paragraphs.
_LINE_END = r"\r\n?|\n"
_BLANK = r"^[ \t\x0B\f]*$"
SCOPES = ("text", "passage", "paragraph", "line")


def _nonempty(x):
    return x != ""


def _paragraphs(df: DataFrame, text: str) -> DataFrame:
    """df with `paragraphs`, of each paragraph the array of its canonical lines, none of them empty, in place of the text column.

    Between the steps stands inline() of one row: the optimizer would otherwise merge the projections and
    bring every line to its canonical form once for each use of it.
    """
    kept = [c for c in df.columns if c != text]
    lines = df.select(*kept, F.split(text, _LINE_END).alias("raw"))
    # \x01 stands for a division between paragraphs, \x02 for the end of a line; canonical lines have neither
    marked = F.array_join(F.transform("raw", lambda r: F.when(F.regexp_like(r, F.lit(_BLANK)), F.lit("\x01")).otherwise(_line(r))), "\x02")
    cut = F.transform(F.split(marked, "\x01"), lambda p: F.filter(F.split(p, "\x02"), _nonempty))
    return lines.select(*kept, F.inline(F.array(F.struct(F.filter(cut, lambda p: F.size(p) > 0).alias("paragraphs")))))


def _digested(df: DataFrame) -> DataFrame:
    """df with `whole` and `digests` (canonical text, and the digest of each paragraph) beside the paragraphs."""
    whole = F.array_join(F.flatten("paragraphs"), " ").alias("whole")
    each = F.transform("paragraphs", lambda p: F.md5(F.array_join(p, " "))).alias("digests")
    return df.select(*[c for c in df.columns if c != "paragraphs"], F.inline(F.array(F.struct("paragraphs", whole, each))))


def _unit(rank: int, digest):
    return F.struct(F.lit(rank).alias("rank"), digest.alias("digest"))


def _units(docs: DataFrame, id_col: str, text_col: str, sizes: list[int]) -> DataFrame:
    """(doc_id, rank, digest) of every unit; sizes are the paragraph counts of known texts, 2 or more."""
    df = _digested(_paragraphs(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t")), "t"))
    n = F.size("digests")
    none = F.array().cast("array<struct<rank:int,digest:string>>")

    def runs(r: int):
        return F.when(n > r, F.transform(F.sequence(F.lit(1), n - (r - 1)), lambda i: _unit(1, F.md5(F.array_join(F.slice("digests", i, r), ""))))).otherwise(none)

    units = F.concat(
        F.when(F.col("whole") != "", F.array(_unit(0, F.md5("whole")))).otherwise(none),
        *map(runs, sizes),
        F.when(n > 1, F.transform("digests", lambda d: _unit(2, d))).otherwise(none),
        F.transform(F.flatten(F.filter("paragraphs", lambda p: F.size(p) > 1)), lambda x: _unit(3, F.md5(x))),
    )
    return df.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.rank", "u.digest")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id, kind, size) of known texts (license_id, kind, text): of the whole, and of the run of its paragraphs if it has several."""
    df = _digested(_paragraphs(known.select("license_id", "kind", F.col("text").alias("t")), "t")).filter("whole <> ''")
    n = F.size("digests")
    rows = F.array(F.struct(F.md5("whole").alias("digest"), F.lit(1).alias("size")), F.struct(F.md5(F.array_join("digests", "")).alias("digest"), n.alias("size")))
    return df.select("license_id", "kind", F.inline(rows)).select("digest", "license_id", "kind", "size").distinct()


def builtin(spark) -> DataFrame:
    """(license_id, kind, text): the fixed table."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(k).alias("kind"), F.lit(t).alias("text")) for i, k, t in KNOWN])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """known (license_id, kind, text) takes the place of the built-in table."""
    digests = known_digests(builtin(docs.sparkSession) if known is None else known)
    sizes = sorted(r["size"] for r in digests.select("size").distinct().collect() if r["size"] > 1)
    digests = digests.select("digest", "license_id", "kind").distinct()
    hits = _units(docs, id_col, text_col, sizes).join(F.broadcast(digests) if known is None else digests, "digest")
    counted = hits.groupBy("doc_id", "rank", "license_id", "kind").agg(F.count(F.lit(1)).alias("n_units"))
    scope = F.element_at(F.array(*map(F.lit, SCOPES)), F.col("rank") + 1)
    return counted.select("doc_id", scope.alias("scope"), "license_id", "kind", "n_units")


def oracle(documents: str = "documents") -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = "lower(l)"
    for old, new in SPELLINGS:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    line = f"(CASE WHEN regexp_matches(l, {quote(_BLANK)}) THEN chr(1) WHEN regexp_matches({x}, {quote(_COPYRIGHT)}) THEN '' ELSE trim(regexp_replace({x}, {quote(_BLANKED)}, ' ', 'g')) END)"
    marked = lambda t: f"array_to_string(list_transform(string_split_regex({t}, {quote(_LINE_END)}), lambda l: {line}), chr(2))"
    paragraphs = lambda t: f"list_filter(list_transform(string_split({marked(t)}, chr(1)), lambda p: list_filter(string_split(p, chr(2)), lambda x: x <> '')), lambda p: len(p) > 0)"
    digested = "SELECT *, array_to_string(flatten(ps), ' ') AS whole, list_transform(ps, lambda p: md5(array_to_string(p, ' '))) AS ds"
    known = ", ".join(f"({quote(i)}, {quote(k)}, {quote(t)})" for i, k, t in KNOWN)
    return f"""
WITH texts AS ({digested} FROM (SELECT license_id, kind, {paragraphs('t')} AS ps FROM (VALUES {known}) AS v(license_id, kind, t))),
known AS (SELECT md5(whole) AS digest, license_id, kind FROM texts UNION SELECT md5(array_to_string(ds, '')), license_id, kind FROM texts),
units AS ({digested} FROM (SELECT doc_id, {paragraphs('text')} AS ps FROM {documents} WHERE text IS NOT NULL)),
found AS (
  SELECT doc_id, 'text' AS scope, md5(whole) AS digest FROM units WHERE whole <> ''
  UNION ALL SELECT doc_id, 'passage', unnest(list_transform(range(1, len(ds) - r + 2), lambda i: md5(array_to_string(ds[i:i + r - 1], '')))) FROM units JOIN (SELECT DISTINCT len(ds) AS r FROM texts WHERE len(ds) > 1) AS sizes ON len(ds) > r
  UNION ALL SELECT doc_id, 'paragraph', unnest(ds) FROM units WHERE len(ds) > 1
  UNION ALL SELECT doc_id, 'line', md5(unnest(flatten(list_filter(ps, lambda p: len(p) > 1)))) FROM units)
SELECT doc_id, scope, license_id, kind, count(*) AS n_units FROM found JOIN known USING (digest) GROUP BY ALL"""
