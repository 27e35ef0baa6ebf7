"""Licence scan by canonical digests: whole texts are normalised and hash-joined to the digests of known licences.

Texts that are short are listed as such, long ones by the digest of their canonical form alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

# Licence texts and notices in general use, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_ITEMS = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2, _BSD_3 = _BSD_GRANT + _BSD_ITEMS + _BSD_END, _BSD_GRANT + _BSD_ITEMS + _BSD_NAME + _BSD_END
# Headings that licence texts carry.
HEADINGS = (
    ("MIT", _MIT, ("", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)")), ("ISC", _ISC, ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)")),
    ("0BSD", _0BSD, ("", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)")), ("BSD-2-Clause", _BSD_2, ("", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", _BSD_3, ("", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License")), ("Zlib", _ZLIB, ("", "zlib License", "The zlib License", "The zlib/libpng License")),
    ("Unlicense", _UNLICENSE, ("", "Unlicense", "The Unlicense")), ("BSL-1.0", _BOOST, ("",)), ("Apache-2.0", _APACHE, ("",)),
)
KNOWN = tuple((name, f"{heading} {text}") for name, text, headings in HEADINGS for heading in headings) + (
    ("MIT", "Released under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
# Canonical digests of whole licence texts as their stewards publish them.
DIGESTS = (
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb"),
    ("GFDL-1.3", "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)
#: Equivalent spellings in canonical form, each replaced by the second; fixed values.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("https ", "http "))
#: Words that follow "copyright" within licence texts, so that a line which begins with them is no copyright line.
WITHIN = (
    "act", "also", "and", "any", "are", "as", "at", "claim", "disclaimer", "doctrine", "doctrines", "for", "from", "holder", "holders", "if", "in", "infringement", "interest", "interests", "is", "law", "laws", "licence", "licences", "license", "licenses", "like", "line", "lines", "must", "notice",
    "notices", "of", "on", "or", "owner", "owners", "ownership", "patent", "patents", "permission", "permissions", "protection", "resulting", "rights", "shall", "statement", "statements", "status", "that", "those", "to", "treaty", "under", "which", "will", "with", "you", "your",
)
#: The same after "copyright the".
WITHIN_THE = ("document", "library", "program", "software", "work")
_START, _GAP, _END = r"^[^\p{L}\n]*", r"[^\p{L}\n]+", r"(?:[^\p{L}]|$)"
_SIGN = rf"{_START}(?:(?:portions|parts){_GAP})?(?:copyright[^\p{{L}}\n]*(?:\(c\)|©|[0-9]{{4}})|\(c\)|©|all rights reserved)"
_HOLDER = rf"{_START}(?:(?:portions|parts){_GAP})?copyright{_GAP}"
_TERM = rf"(?:(?:{'|'.join(WITHIN)}){_END}|the(?:{_GAP}(?:{'|'.join(WITHIN_THE)}){_END}|[^\p{{L}}\n]*$))"
_COPYRIGHT = rf"(?md)(?:{_SIGN}|{_HOLDER}(?!{_TERM})\p{{L}})[^\n]*$"


def _plain(text: Column) -> Column:
    """Lower case without copyright lines, and with one space in place of all but letters, digits and newlines.

    A copyright line begins with a sign or a year of copyright, "all rights reserved", or "copyright" and a holder: any
    word but those that licence texts have there.
    """
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}\n]+", " ")


def _spelt(plain: Column) -> Column:
    for other, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(usual))
    return plain


def _joined(plain: Column) -> Column:
    return _spelt(F.trim(F.regexp_replace(plain, r"[ \n]+", " ")))


def canonical(text: Column) -> Column:
    """Lower case without copyright lines, spelt one way, and with single spaces in place of all but letters and digits."""
    return _joined(_plain(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of the known texts, one row for each digest."""
    rows = spark.createDataFrame(list(known), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, line, digest, license): line 0 is the whole text of a row, others are lines of it that are a known text.

    Every row of `docs` has its line 0, with a null license if it is no known text; of the lines, counted from 1, those
    whose whole text is known have a row too, whatever they say. Texts of any length go to the hash join as digests.
    `known` holds the fixed list of this module, or another bounded one, so it may be broadcast. Null and empty texts
    have the digest of the empty text and no licence; repeated rows are all returned, null doc_ids too, and an empty table
    gives no row. Columns of `docs` besides doc_id and text are not read.
    """
    rows = docs.select("doc_id", _plain(F.col("text")).alias("plain"))
    lines = F.transform(F.split(_spelt(F.col("plain")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("text")))
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("line"), F.sha2(_joined(F.col("plain")), 256).alias("digest"))),
        F.transform(F.filter(lines, lambda x: x["text"] != ""), lambda x: F.struct(x["line"].alias("line"), F.sha2(x["text"], 256).alias("digest"))),
    )
    rows = rows.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*")
    return rows.join(F.broadcast(known), "digest", "left").where("line = 0 or license is not null").select("doc_id", "line", "digest", "license")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and its lines that are a known licence text or notice, as `scan` defines them."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    ours = f"regexp_matches(x, {_quoted(_SIGN)}) OR (regexp_matches(x, {_quoted(_HOLDER + r'[\p{L}]')}) AND NOT regexp_matches(x, {_quoted(_HOLDER + _TERM)}))"
    text = f"array_to_string(list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: NOT ({ours})), chr(10))"
    text = f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
    for other, usual in SPELLINGS:
        text = f"replace({text}, {_quoted(other)}, {_quoted(usual)})"
    return f"sha256({text})"


_ROWS = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)
ORACLE = f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
    SELECT {_sql_digest('t')} AS digest, license FROM (VALUES {_ROWS}) v(license, t)
    UNION ALL SELECT digest, license FROM (VALUES {", ".join(f"({_quoted(n)}, '{x}')" for n, x in DIGESTS)}) w(license, digest)) GROUP BY 1),
parts AS (
  SELECT doc_id, 0 AS line, {_sql_digest('text')} AS digest FROM documents
  UNION ALL
  SELECT doc_id, line, {_sql_digest('part')} FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
  WHERE regexp_matches(part, '[\\p{{L}}\\p{{Nd}}]'))
SELECT doc_id, line::INTEGER AS line, digest, license FROM parts LEFT JOIN known USING (digest) WHERE line = 0 OR license IS NOT NULL
"""
