"""License scans by canonical digest lookup.

A whole text is brought to a canonical form (case, copyright lines, a title line, list marks,
equivalent spellings, punctuation and white space no longer tell texts apart) and hashed, so
that it does not matter how its lines are wrapped; digests are joined with
those of known licenses.  Everything is built-in column functions, so the scan stays inside
the JVM, and only the table of known digests, which is written down here, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverspark.llm import common

#: Spellings that license texts use for each other, replaced in this order.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("www.", ""), ("(c)", "copyright"), ("©", "copyright")]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Whole texts of known licenses and of one-line notices, by SPDX identifier.
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
]

#: Canonical digests of longer licenses, of the whole text as it is commonly handed out.  The SQL
#: is made from the texts in ``KNOWN`` alone and has no license for these.
KNOWN_DIGESTS = [
    ("Apache-2.0", "bfc7ccc84963d2921d97f673bf3aa53f6fea3d7d32f55c76b8f8e2144a3beafa"),
    ("Apache-2.0", "27f5107a6c13df5a0b3d7c0dacd51b5837fbf11f02b6292c8dfa7b3aa8392baf"),  # up to the end of its terms
    ("Artistic-1.0-Perl", "0ecc5f2bb1619d7f534b973d4f7e7e273fd28db4a64d1a15500263f487ef1e05"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("CC0-1.0", "7f86e48c814c9321828512eeba2f465aef6a5ec1ca1dd3b9a18ca79ca9e8b7d1"),
    ("GFDL-1.2-only", "ff2b727e398536837fe045aab8a02dc68930815378e2ce051c3d79b2e1950630"),
    ("GFDL-1.3-only", "f6ebeaedc622f855080ac62a6b58540d7ea5c4debf94ef5b8406ae58c3b34598"),
    ("GPL-1.0-only", "29cd611b10bf55acc87b2214e4d6f4ec3a4bbc22f600789b6f704bbda155e8bb"),
    ("GPL-1.0-only", "e7d0184665046b7b6606aab95cb6321a497aa126fb7c18b302fd1efb9312e27f"),  # up to the end of its terms
    ("GPL-2.0-only", "25f78eb476ba5a20ef4bab572e988363b3b51925131c8480ba0c51b0221f1d6f"),
    ("GPL-2.0-only", "6e9f5379fb7ac3f4152d736ab379fb0771e25eedbc4cead5966bce1f6cb65366"),  # up to the end of its terms
    ("GPL-3.0-only", "3621bb7794807eaf5b073f7ed2f796289b33bb9e11490f057ca9ee488b23c6b2"),
    ("GPL-3.0-only", "f18f163fb9050e54dcbfca53a2e880c205d19b8a2f1b99a84ad0c5b75813a64c"),  # up to the end of its terms
    ("LGPL-2.0-only", "41e812bc7f7e722920e0118340d2470ee1009174cbf9f2baa962556c286575ed"),
    ("LGPL-2.0-only", "66849d83aff839fcf244074fbddaa3c5722fb679c72f20e6faa827c08a64c947"),  # up to the end of its terms
    ("LGPL-2.1-only", "7e125e82dd44641085c9a5d4eef7e13ed3262cc816b38d8318eed4a5fe112fbb"),
    ("LGPL-2.1-only", "1a0a1112b88b9898ddf983e67cd138cc7a3d4cbb03867db7cfd72c91f8fa9a66"),  # up to the end of its terms
    ("LGPL-3.0-only", "b7bbb44d2a8bc8c636959d54f6ca4e3fcc8711761e34f5bddf0e7f71b8606ac6"),
    ("MPL-1.1", "e96f12584dbbeedf135d5ae7b7ee1d468f4011780f1ee0ecffbdbb597e9b13c0"),
    ("MPL-2.0", "93105b1dd2996449be896bd95a75cadf047d21c8a3f4c6675ac049d36af60c66"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names an owner: by a year or the sign, which has become the word.  A line of the body that a
#: wrap lets begin with "copyright holders" is none.
_COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+copyright|copyright[^\n]*[12][0-9][0-9][0-9]|all rights reserved)[^\n]*"
#: A word that a wrap has cut at its hyphen, a title above a blank line, and numbers or letters of lists.
_CUT_WORD = r"-[ \t]*\r?\n[ \t]*"
_TITLE_LINE = r"^[ \t\r\n]*[^\n]{0,50}license([ .,()0-9\"'-][^\n]{0,40})?\r?\n[ \t]*\r?\n"
_LIST_MARK = r"\b[0-9][0-9]?[.)][ \t\r\n]+|\([0-9a-z][0-9a-z]?\)"
_NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f‘’“”–— ]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _CUT_WORD, "-")
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    for pattern in (_COPYRIGHT_LINE, _TITLE_LINE, _LIST_MARK):
        out = F.regexp_replace(out, pattern, "\n")
    return F.trim(F.regexp_replace(out, _NOT_WORD, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and license_id, one row per digest; the smallest identifier where two texts agree."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    rows = rows.select(digest(F.col("text")).alias("digest"), "license_id")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, and license_id (null if the text is no known license).

    A null, empty or all-punctuation text has the digest of the empty text and no license; a
    text of any length is hashed whole; of several licenses with one digest the smallest name
    is given; a null doc_id stays null; repeated rows are scanned alike; extra columns are not
    read; an empty table gives no rows.  ``known`` of one's own is joined by a shuffle on the digest
    unless Spark finds it small; the built-in table is broadcast.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known.select("digest", "license_id")
    return told.join(table, "digest", "left").select("doc_id", "digest", "license_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, and its license if its entire text is one."""
    return scan(common.table(spark, sf_dir, "documents"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), {_sql_text(_CUT_WORD)}, '-', 'g')"
    for spelling, same in SPELLINGS:
        out = f"replace({out}, {_sql_text(spelling)}, {_sql_text(same)})"
    for pattern in (_COPYRIGHT_LINE, _TITLE_LINE, _LIST_MARK):
        out = f"regexp_replace({out}, {_sql_text(pattern)}, chr(10), 'g')"
    return f"trim(regexp_replace({out}, {_sql_text(_NOT_WORD)}, ' ', 'g'))"


OP7_SQL = (
    "WITH known(license_id, text) AS (VALUES "
    + ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    + f"), digests AS (SELECT sha256({_sql_canonical('text')}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1), "
    + f"told AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents) "
    + "SELECT doc_id, told.digest, license_id FROM told LEFT JOIN digests USING (digest)"
)
