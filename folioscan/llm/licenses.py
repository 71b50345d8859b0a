"""10. License scan: canonical digests of entire texts, looked up among those of known licences.

A text is lower-cased, its copyright notices are dropped (lines that begin with one; where a licence begins on the same
line, the notice alone; body lines that name copyright stay), punctuation and white space become one space, equivalent
spellings one spelling. Each line so made, and the whole of them, is a unit; a unit whose digest is that of a known
licence or notice, made the same way, is one. All of it is built-in expressions; the table of known texts is a constant
of this module (KNOWN), so its broadcast has a fixed size.

Defined cases: null and empty texts have no unit; a text of copyright notices alone neither; repeated rows are rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm._common import columns

_DATED = r"(?:copyright[\s:,]*(?:\(c\)|©|&copy;|[\[<{(]?(?:[0-9]{4}|year|yyyy)\b|by\b)|©|\(c\)\s*(?:copyright\b|[0-9]{4}\b))"
#: After "copyright", what no holder's name begins with: such lines are wrapped body text.
_BODY = r"(?:notices?|holders?|owners?|laws?|licen[cs]e[sd]?|statements?|interests?|disclaimers?|permissions?|protections?|infringements?|treat(?:y|ies)|acts?|rights?|status|resulting|and|or|of|on|in|to|is|are|as|for|that|this|these|those|any|which|with|under|from|the (?:software|program|library|work|material|licen[cs]e))"
_LEAD = r"^[^\p{L}\p{N}©(]*(?:portions )?"
#: A copyright notice: a dated one, or one that names a holder and isn't body text.
DATED_NOTICE, NAMED_NOTICE, NO_NOTICE = _LEAD + _DATED, _LEAD + r"copyright\s+\p{L}", _LEAD + r"copyright\s+" + _BODY + r"\b"
#: A notice, and the words with which a licence begins on the same line.
BEFORE_BODY = _DATED + r"[^\n]{0,300}?\b(permission is hereby granted|permission to use|licensed under|released under|this work is licensed|this program is free|redistribution and use|spdx-license-identifier)\b"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), (" version ", " v "), ("https", "http"))
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = "\nFor more information, please refer to <https://unlicense.org>"
#: Licence and text; a notice in several wordings has several entries.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("0BSD", _0BSD), ("0BSD", "BSD Zero Clause License\n" + _0BSD), ("0BSD", "Zero-Clause BSD\n" + _0BSD), ("0BSD", "SPDX-License-Identifier: 0BSD"), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _UNLICENSE_END), ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("ISC", "Licensed under the ISC License."), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Released under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _spelled(made: Column) -> Column:
    for a, b in SPELLINGS:
        made = F.replace(made, F.lit(a), F.lit(b))
    return made


def canonical_lines(text: Column) -> Column:
    parted = F.regexp_replace(F.lower(text), BEFORE_BODY, "\n$1")
    kept = F.filter(F.split(parted, "\n"), lambda x: ~(x.rlike(DATED_NOTICE) | (x.rlike(NAMED_NOTICE) & ~x.rlike(NO_NOTICE))))
    made = _spelled(F.regexp_replace(F.array_join(kept, "\n"), PUNCTUATION, " "))
    return F.filter(F.transform(F.split(made, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def canonical_whole(lines: Column) -> Column:
    """Of canonical lines; spellings may be broken by a line's end."""
    return _spelled(F.array_join(lines, " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_texts: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """known_texts: (licence, text), a table small enough for the driver. doc_id, digest (of the whole), n_units (lines), n_license_lines, whole_license, licenses (sorted, by comma; both null if none)."""
    spark = docs.sparkSession
    docs = columns(docs, id_col, text_col).toDF("doc_id", "text")
    known = spark.createDataFrame(list(known_texts), "license string, text string")
    known = known.select("license", F.md5(canonical_whole(canonical_lines(F.col("text")))).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("uid", "doc_id", F.md5(canonical_whole(F.col("lines"))).alias("whole"), F.transform("lines", F.md5).alias("lines"))
    # The whole, then its lines; a text of one line is one unit of each.
    units = rows.select("uid", "doc_id", "whole", F.posexplode(F.concat(F.array("whole"), F.coalesce("lines", F.array().cast("array<string>")))).alias("pos", "digest"))
    found = units.join(F.broadcast(known), "digest", "left")
    line = F.col("pos") > 0
    out = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.max("whole").alias("digest"), F.count_if(line).alias("n_units"), F.count_if(line & F.col("license").isNotNull()).alias("n_license_lines"), F.max(F.when(~line, F.col("license"))).alias("whole_license"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    return out.select("doc_id", "digest", "n_units", "n_license_lines", "whole_license", F.nullif("licenses", F.lit("")).alias("licenses"))


def _sql_lines(text: str) -> str:
    q = lambda x: x.replace("'", "''")
    parted = f"regexp_replace(lower({text}), '{q(BEFORE_BODY)}', chr(10) || '\\1', 'g')"
    kept = f"[x for x in string_split({parted}, chr(10)) if NOT (regexp_matches(x, '{q(DATED_NOTICE)}') OR (regexp_matches(x, '{q(NAMED_NOTICE)}') AND NOT regexp_matches(x, '{q(NO_NOTICE)}')))]"
    made = f"regexp_replace(array_to_string({kept}, chr(10)), '{PUNCTUATION}', ' ', 'g')"
    for a, b in SPELLINGS:
        made = f"replace({made}, '{a}', '{b}')"
    return f"[trim(x) for x in string_split({made}, chr(10)) if trim(x) <> '']"


def oracle() -> str:
    """DuckDB SQL for scan() over documents."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""WITH known AS (SELECT md5(array_to_string({_sql_lines("t")}, ' ')) AS d, min(n) AS license FROM (VALUES {rows}) v(n, t) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS uid, doc_id, {_sql_lines("text")} AS lines FROM documents),
units AS (SELECT uid, unnest(lines) AS line FROM rows),
found AS (SELECT uid, count(*) AS n_units, count(k.license) AS n_license_lines, list(DISTINCT k.license) FILTER (WHERE k.license IS NOT NULL) AS l FROM units LEFT JOIN known k ON md5(line) = k.d GROUP BY uid)
SELECT r.doc_id, md5(array_to_string(r.lines, ' ')) AS digest, coalesce(f.n_units, 0) AS n_units, coalesce(f.n_license_lines, 0) AS n_license_lines, w.license AS whole_license,
nullif(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.l, []), CASE WHEN w.license IS NULL THEN [] ELSE [w.license] END))), ','), '') AS licenses
FROM rows r LEFT JOIN found f USING (uid) LEFT JOIN known w ON md5(array_to_string(r.lines, ' ')) = w.d"""
