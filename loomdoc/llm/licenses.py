"""Licence scan by canonical digest: entire texts are normalised and hash-joined to known licences.

Canonical form, in this order: lower case; copyright lines removed, with a line "all rights reserved" right below; numbers of
list items removed; every run of characters that are not ASCII letters or digits turned into one space, trimmed; equivalent
spellings replaced on whole words; the licence's own title removed from the front of a longer text. So a licence is the
same however its lines are wrapped, with numbers or bullets, under its title or not. The form's SHA-256 is the join key.

Edge cases: null and empty texts, and texts of punctuation only, have the canonical form ``""`` and match nothing. Very
long texts are normalised whole. Repeated rows each get their row; an empty table gives an empty result; extra columns
are not carried, so their names cannot clash. A hot text is no problem: the known side is a fixed list that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.tables import load

QUERY = "op6_licenses"

# Short public licence texts and notices, as published.
KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "NTP": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without
fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice
and this permission notice appear in supporting documentation, and that the name not be used in advertising or publicity
pertaining to distribution of the software without specific, written prior permission. This software is provided "as is"
without express or implied warranty.""",
}

# Equivalent spellings, as licence-matching guidelines list them (left is replaced by right).
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("noninfringement", "non infringement"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantable quality", "merchantability"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
#: What follows "copyright" in the clauses of licences, so that a line which is wrapped there names no owner.
CLAUSE_WORDS = (
    "holders?|owners?|notices?|laws?|licen[sc]es?|statements?|interests?|protections?|claims?|treat(?:y|ies)|acts?|status|permissions?|disclaimers?|"
    "rights?|and|or|in|on|to|is|are|was|has|have|may|shall|will|for|as|with|that|which|under|of|at|from|if|be|not|can"
)
#: A line that starts (after marks) with "(c)" or the copyright sign, or with "copyright" and a year, a sign or an owner; and
#: the reservation of rights that may stand right below.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;-]*(\(c\)|©|copyright[ \t:,.-]*+(?:\(c\)|©|[0-9]{4})"
    rf"|copyright[ \t:]++(?!(?:{CLAUSE_WORDS})\b(?!:))[\p{{L}}\p{{N}}<\[{{\"'])[^\n]*(?:\n[ \t*#/;-]*all rights reserved\.?[ \t\r]*(?=\n|$))?"
)
#: The number of a list item: at the start of the text or behind the end of a sentence or clause, wherever lines are cut.
ITEM_NUMBER = r"(^|[.:;])[ \t\r\n*#/-]*\(?[0-9]{1,2}[.)][ \t\r\n]+([a-z])"
# Titles of licences, as they are published, in canonical form.
TITLES = (
    r"^(?:the )?(?:(?:mit|isc|zlib|apache|boost software|(?:new |modified |simplified |revised |freebsd |original )?bsd|bsd [23] clause|[23] clause bsd) license"
    r"|unlicense)(?: (?:mit|isc|zlib|bsd))?(?: version [0-9]+(?: [0-9]+)?)?(?: august 17th 2003)? "
)


def without_marks(text: Column) -> Column:
    """Lower case, without copyright lines, item numbers and punctuation."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    c = F.regexp_replace(c, ITEM_NUMBER, "$1 $2")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def respelled(c: Column) -> Column:
    """One look for any of the spellings; only texts that hold one pay for the replacements. The title goes last."""
    put_right = c
    for found, put in SPELLINGS:
        put_right = F.regexp_replace(put_right, rf"\b{found}\b", put)
    c = F.when(c.rlike(r"\b(?:" + "|".join(found for found, _ in SPELLINGS) + r")\b"), put_right).otherwise(c)
    return F.regexp_replace(c, TITLES, "")


def with_form(df: DataFrame) -> DataFrame:
    """``text`` replaced by ``form``, its canonical form."""
    rest = [c for c in df.columns if c != "text"]
    return df.select(*rest, without_marks(F.col("text")).alias("bare")).select(*rest, respelled(F.col("bare")).alias("form"))


def read_known(spark: SparkSession, path: str) -> dict[str, str]:
    """Known licences of a folder of texts, by file name without ending: for lists that are too long for a program. A list of
    licences has some hundred texts, whatever the size of the documents."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.txt|\.md)?$", 1)
    return {r["name"]: r["value"] for r in rows.select(name.alias("name"), "value").collect()}


def known_digests(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    """license_id and digest. The list is part of the program, so its size is fixed."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, text string")
    return with_form(rows).select("license_id", F.sha2(F.col("form"), 256).alias("digest"))


def scan_licenses(df: DataFrame, known: dict[str, str] = KNOWN) -> DataFrame:
    """doc_id, canonical_chars, digest (null for an empty canonical form) and license_id (null if unknown)."""
    if len(set(known.values())) != len(known):
        raise ValueError("two known licences have one text")
    rows = with_form(df.select("doc_id", "text")).select(
        "doc_id",
        F.length("form").cast("long").alias("canonical_chars"),
        F.when(F.col("form") != "", F.sha2(F.col("form"), 256)).alias("digest"),
    )
    return rows.join(F.broadcast(known_digests(df.sparkSession, known)), "digest", "left").select("doc_id", "canonical_chars", "digest", "license_id")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def _sql() -> str:
    def form(c: str) -> str:
        # Line by line: it opens (after marks) with a sign of its own, or with "copyright" and something that is no clause.
        opens = r"'^[ \t*#/;-]*"
        owner = rf"regexp_matches(x, {opens}copyright[ \t:]+[\p{{L}}\p{{N}}<\[{{\"'']')"
        clause = rf"regexp_matches(x, {opens}copyright[ \t:]+(?:{CLAUSE_WORDS})\b(?:[^:]|$)')"
        signed = rf"regexp_matches(x, {opens}(?:\(c\)|©|copyright[ \t:,.-]*(?:\(c\)|©|[0-9]{{4}}))')"
        lines = f"string_split(lower(coalesce({c}, '')), chr(10))"
        line = f"({signed} OR ({owner} AND NOT {clause}))"
        above = line.replace("(x, ", f"({lines}[i - 1], ")
        reserved = rf"(i > 1 AND {above} AND regexp_matches(x, {opens}all rights reserved\.?[ \t\r]*$'))"
        c = f"list_filter({lines}, lambda x, i: NOT ({line} OR {reserved}))"
        c = f"array_to_string({c}, chr(10))"
        c = f"regexp_replace({c}, '{ITEM_NUMBER}', '\\1 \\2', 'g')"
        c = f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"
        for found, put in SPELLINGS:
            c = f"regexp_replace({c}, '\\b{found}\\b', '{put}', 'g')"
        return f"regexp_replace({c}, '{TITLES}', '')"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
WITH known AS (SELECT license_id, sha256({form("text")}) AS digest FROM (VALUES {values}) AS k(license_id, text)),
forms AS (SELECT doc_id, {form("text")} AS form FROM documents),
digests AS (
  SELECT doc_id, CAST(length(form) AS BIGINT) AS canonical_chars, CASE WHEN form <> '' THEN sha256(form) END AS digest
  FROM forms)
SELECT doc_id, canonical_chars, digest, license_id FROM digests LEFT JOIN known USING (digest)
"""


SQL = _sql()
