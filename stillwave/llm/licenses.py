"""Licence scans by canonical digests, with DataFrame functions only.

Texts are brought to one canonical form (case, punctuation, copyright lines, equivalent
spellings, white space), whole texts are digested, and the digests are joined with those of
known licences. The lines of a text are digested in the same way and looked up among the
known one-line notices. Nothing is shuffled: the known digests are a fixed, short table.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwave.llm import common

# The public texts of licences and of the notices by which they are applied.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: (SPDX identifier, text); a text of one line is also looked up line by line.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n\n1. {_BSD_1}\n2. {_BSD_2}\n3. {_BSD_3}\n\n{_BSD_TAIL}"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", _MPL_NOTICE),
    ("GPL-3.0-or-later", _GPL3_NOTICE),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

_TEXTS = Path(__file__).parent / "license_texts"
#: Entire texts, by file.
ENTIRE: list[tuple[str, str]] = [
    (name, (_TEXTS / f"{file}.txt").read_text("utf-8"))
    for name, file in [
        ("Apache-2.0", "Apache-2.0"), ("GPL-1.0-only", "GPL-1"), ("GPL-2.0-only", "GPL-2"), ("GPL-3.0-only", "GPL-3"), ("LGPL-2.0-only", "LGPL-2"),
        ("LGPL-2.1-only", "LGPL-2.1"), ("LGPL-3.0-only", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"),
        ("Artistic-1.0-Perl", "Artistic-1.0-Perl"), ("BSL-1.0", "BSL-1.0"), ("EPL-1.0", "EPL-1.0"), ("GFDL-1.2-only", "GFDL-1.2"), ("GFDL-1.3-only", "GFDL-1.3"), ("Unlicense", "Unlicense"),
    ]
]

# Patterns and replacements, applied in this order to lowered text.
#: Lines that name a holder, with names, years or placeholders in any order, and lines
#: that reserve all rights; but no sentence of a licence that begins with "copyright".
_SENTENCE = "and|as|disclaimer|for|holders?|in|interests?|is|laws?|licen[cs]es?|notices?|of|on|or|owners?|permission|protection|statements?|to|treaty"
HOLDER_LINE = (
    rf"(^|\n)[^a-z0-9\n]*(copyright[ \t:]+(?!({_SENTENCE})(?![a-z0-9]))[^ \t:\n]|\(c\)[ \t]*[0-9]|©"
    r"|all[ \t]+rights[ \t]+reserved(?=[^a-z0-9\n]*(\n|$)))[^\n]*"
)
NOT_WORDS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
#: Whole words; the spaces around a word stand for its ends.
EQUIVALENT: list[tuple[str, str]] = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorise", "authorize"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("favourable", "favorable"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"),
    ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("organisations", "organizations"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("v", "version"),
]


def canonical_lines(text: F.Column) -> F.Column:
    """Lowered text without holders' lines, punctuation and variant spellings; words stand
    between blanks, lines stay."""
    out = F.regexp_replace(F.lower(text), "\r", "\n")
    # A line consumes the break before it, so a second pass isn't needed for adjacent lines.
    out = F.regexp_replace(out, HOLDER_LINE, "\n")
    out = F.regexp_replace(out, NOT_WORDS, " ")
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), "\n", " \n ")
    out = F.replace(out, F.lit(" "), F.lit("  "))
    for old, new in spaced():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def spaced() -> list[tuple[str, str]]:
    """EQUIVALENT for texts whose blanks are doubled: each word then has blanks of its own, so
    that of neighbours none is passed over."""
    return [(f" {old} ".replace(" ", "  ")[1:-1], f" {new} ".replace(" ", "  ")[1:-1]) for old, new in EQUIVALENT]


def _squeezed(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def _plain(text: str) -> str:
    """The same canonical form in Python, for the known texts."""
    out = re.sub("\r", "\n", text.lower())
    out = re.sub(HOLDER_LINE, "\n", out)
    out = re.sub(NOT_WORDS.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), " ", out)
    out = re.sub("\n", " \n ", f" {out} ").replace(" ", "  ")
    for old, new in spaced():
        out = out.replace(old, new)
    return re.sub(r"[ \n]+", " ", out).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(_plain(text).encode()).hexdigest()


def known_digests(known: list[tuple[str, str]]) -> dict[str, str]:
    return {digest(text): name for name, text in known}


def scan(df: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``canonical_sha256`` of the whole text, ``license``
    if that is the digest of a known licence, and ``notices``, the licences whose one-line
    notices are lines of the text, sorted and joined by ",", or null.

    A null text has null results; a text without words has the digest of the empty text,
    which is no licence. Repeated rows are scanned each by itself, an empty table gives an
    empty result, and other columns are left out. ``known`` holds pairs of a name and a
    text, so the broadcast side is as short as that list.
    """
    known = [*ENTIRE, *KNOWN] if known is None else known
    digests = known_digests(known)
    notices = known_digests([k for k in known if "\n" not in k[1].strip()])
    table = df.sparkSession.createDataFrame(sorted(digests.items()) or [("", "")], "_key string, license string")
    rows = df.select(F.col(id).alias("_id"), canonical_lines(F.col(text).cast("string")).alias("_lines"))
    rows = rows.withColumn("_key", F.sha2(_squeezed(F.col("_lines")), 256))
    # Digests of those lines alone that are as long as some notice.
    lengths = sorted({len(_plain(t)) for _, t in known if "\n" not in t.strip()})
    lines = F.transform(F.split("_lines", "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    lines = F.filter(lines, lambda x: F.length(x).isin(lengths))
    names = F.create_map(*[F.lit(x) for pair in sorted(notices.items()) for x in pair]) if notices else None
    found = F.lit(None).cast("string")
    if names is not None:
        hits = F.filter(F.transform(lines, lambda x: F.element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
        found = F.array_join(F.array_sort(F.array_distinct(hits)), ",")
    rows = rows.withColumn("_found", found)
    return rows.join(F.broadcast(table), "_key", "left").select(
        F.col("_id").alias(id),
        F.col("_key").alias("canonical_sha256"),
        "license",
        F.when(F.col("_found") != "", F.col("_found")).alias("notices"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    """The same in SQL, whose patterns can't look ahead: line by line, of two patterns."""
    quote = lambda s: s.replace("'", "''")
    start = "^[^a-z0-9]*"
    holds = rf"regexp_matches(l, '{start}(copyright[ \t:]+[^ \t:]|\(c\)[ \t]*[0-9]|©|all[ \t]+rights[ \t]+reserved[^a-z0-9]*$)')"
    says = rf"regexp_matches(l, '{start}copyright[ \t:]+({_SENTENCE})($|[^a-z0-9])')"
    text = f"array_to_string(list_filter(string_split(replace(lower(text), chr(13), chr(10)), chr(10)), lambda l: NOT ({holds} AND NOT {says})), chr(10))"
    text = f"regexp_replace({text}, '{quote(NOT_WORDS)}', ' ', 'g')"
    text = f"replace(' ' || {text} || ' ', chr(10), ' ' || chr(10) || ' ')"
    text = f"replace({text}, ' ', '  ')"
    for old, new in spaced():
        text = f"replace({text}, '{old}', '{new}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests([*ENTIRE, *KNOWN]).items()))
    notices = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests([k for k in KNOWN if chr(10) not in k[1].strip()]).items()))
    return f"""
WITH known(digest, license) AS (VALUES {values}), notice(digest, name) AS (VALUES {notices}),
     canon AS (SELECT doc_id, {text} AS lines FROM documents),
     lines AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM canon)
               JOIN notice ON digest = sha256(trim(regexp_replace(line, ' +', ' ', 'g')))),
     found AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS notices FROM lines GROUP BY doc_id)
SELECT c.doc_id, sha256(trim(regexp_replace(c.lines, '[ \\n]+', ' ', 'g'))) AS canonical_sha256, k.license, f.notices
FROM canon c LEFT JOIN known k ON k.digest = sha256(trim(regexp_replace(c.lines, '[ \\n]+', ' ', 'g')))
LEFT JOIN found f ON f.doc_id = c.doc_id"""


SQL = _sql()
