"""Licence scans: canonical digests of entire texts hash-joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.tables import let

# Public licence texts and notices, as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_CONDITIONS, _BSD_DISCLAIMER = BSD2.rsplit("\n", 1)
BSD3 = _BSD_CONDITIONS + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_DISCLAIMER
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + ISC.split("\n", 1)[1]
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""" + MIT.rsplit("\n", 1)[1].replace("THE AUTHORS OR COPYRIGHT HOLDERS BE", "THE AUTHORS BE") + """
For more information, please refer to <https://unlicense.org/>"""
#: (licence, text) of whole licences and of notices that stand for one. Longer licences are given to `scan` as a table.
KNOWN = (
    ("BSD-3-Clause", BSD3), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD3), ("0BSD", ZERO_BSD), ("0BSD", "Zero-Clause BSD\n" + ZERO_BSD), ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB), ("Unlicense", UNLICENSE),
    ("MIT", MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("MIT", "MIT License\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD2), ("Apache-2.0", APACHE_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("all-rights-reserved", "All rights reserved."),
)
#: Equivalent spellings, applied in order to lower-case words between blanks.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("v 2 0", "version 2 0"), ("v2 0", "version 2 0"), ("v2", "version 2"), ("v3", "version 3"), ("merchantibility", "merchantability"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
)
#: A line is a copyright line if, lower-cased, it opens with one of these marks.
COPYRIGHT = r"(?m)^[ \t#*/;.-]*(copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines out, everything but ASCII letters and digits to single blanks, equivalent spellings replaced."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, "[^a-z0-9]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of the known texts, given as pairs or as a table (license, text); of equal texts the first name."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    return table.where("license IS NOT NULL AND text IS NOT NULL").select("license", canonical(F.col("text").cast("string")).alias("body")).where("body <> ''").groupBy(
        F.sha2("body", 256).alias("digest")).agg(F.min("license").alias("license"))


def filled_lines(text: Column) -> Column:
    """(raw, digest) of the lines of a text that are not empty in canonical form."""
    both = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("raw"), canonical(x).alias("body")))
    return F.transform(F.filter(both, lambda x: x["body"] != ""), lambda x: F.struct(x["raw"].alias("raw"), F.sha2(x["body"], 256).alias("digest")))


def scan(docs: DataFrame, known=KNOWN, notices=KNOWN) -> DataFrame:
    """(doc_id, text_digest, license, notices) of every row of `docs`.

    license is that of the known text which the entire document equals in canonical form, else null; `known` may be pairs
    or a table (license, text) of any size, joined by digest. notices are the sorted licences of `notices`, a fixed list of
    pairs, whose text equals one or more whole consecutive lines of the document, lines empty in canonical form left out; a
    notice of several lines is tried where its first line is met. Lines are compared in the row, so nothing is gathered by
    digest and a notice in every document costs no more than one.

    Null and empty texts have the digest of the empty text and match nothing; repeated rows and null doc_id return each; a
    very long text is one row, its lines hashed once; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    lists = spark.createDataFrame(list(notices), "license string, text string").select(filled_lines(F.col("text")).alias("lines"))
    shapes = lists.where("size(lines) > 0").select(F.col("lines")[0]["digest"].alias("first"), F.size("lines").alias("n")).distinct().collect()  # as many as `notices` has
    entries = known_digests(spark, notices).collect()
    names = F.create_map(*[F.lit(v) for row in sorted(entries) for v in row]) if entries else F.expr("map('', '')")
    firsts, lengths = sorted({r["first"] for r in shapes if r["n"] > 1}), sorted({r["n"] for r in shapes if r["n"] > 1})

    def met(lines: Column) -> Column:
        single = F.transform(lines, lambda x: F.try_element_at(names, x["digest"]))
        if not firsts:
            return single
        run = lambda i, n: F.try_element_at(names, F.sha2(canonical(F.array_join(F.transform(F.slice(lines, i + 1, n), lambda x: x["raw"]), "\n")), 256))
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i)["digest"].isin(firsts))
        several = F.flatten(F.transform(starts, lambda i: F.array(*[F.when(i + n <= F.size(lines), run(i, n)) for n in lengths])))
        return F.when(F.size(lines) > 0, F.concat(single, several)).otherwise(single)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = let(filled_lines(F.col("text")), lambda lines: F.array_join(F.array_sort(F.array_distinct(F.array_compact(met(lines)))), ","))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), found.alias("notices"))
    return rows.join(table.withColumnRenamed("digest", "text_digest"), "text_digest", "left").select("doc_id", "text_digest", "license", "notices")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """SQL twin of `canonical`."""
    out = f"regexp_replace(lower(coalesce({text}, '')), {_sql_text(COPYRIGHT)}, '', 'g')"
    out = f"concat(' ', trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')), ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


ORACLE = f"""
WITH known AS (SELECT sha256({_sql_canonical('body')}) AS digest, min(license) AS license
               FROM (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in KNOWN)}) AS t(license, body) GROUP BY 1),
documents_numbered AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
lines AS (SELECT row_no, generate_subscripts(ls, 1) AS place, unnest(ls) AS line FROM (SELECT row_no, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents_numbered)),
filled AS (SELECT row_no, list(line ORDER BY place) AS ls FROM lines WHERE {_sql_canonical('line')} <> '' GROUP BY row_no),
runs AS (SELECT DISTINCT row_no, array_to_string(ls[i:i + n - 1], chr(10)) AS run FROM filled, unnest(range(1, {1 + max(len(t.splitlines()) for _, t in KNOWN)})) AS u(n), unnest(range(1, CAST(len(ls) - n + 2 AS BIGINT))) AS v(i)),
notices AS (SELECT row_no, string_agg(license, ',' ORDER BY license) AS notices
            FROM (SELECT DISTINCT row_no, license FROM runs JOIN known ON sha256({_sql_canonical('run')}) = digest) AS found GROUP BY row_no)
SELECT doc_id, sha256({_sql_canonical('text')}) AS text_digest, license, coalesce(notices, '') AS notices
FROM documents_numbered LEFT JOIN known ON digest = sha256({_sql_canonical('text')}) LEFT JOIN notices USING (row_no)
"""
