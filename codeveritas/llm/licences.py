"""Licence scan by canonical digest: whole texts joined to the digests of known licences.

A text is made canonical with built-in functions only: lower case, copyright statements and titles removed, other
spellings brought to one form, punctuation and runs of white space to one blank.  Equal canonical
texts have equal SHA-256, so a scan is one map and a hash join on the digest; nothing is compared
pairwise, and texts never move.

Each line of a text is looked up as an entire text too, for one-line notices inside longer texts.
All look-ups of a document sit in one task, so the map-side half of the final aggregate leaves one
narrow row a document for the only exchange.

Defined results: null and empty text, and text of punctuation or copyright lines only, have no
canonical words and match nothing (digest null); known licences with equal canonical texts are one,
under the smallest name; repeated rows keep a row each; null ids stay; other columns are not read.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings brought to one form, applied in this order to canonical words (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("authorised", "authorized"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("recognised", "recognized"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
    ("http", "https"),
)

#: Whole texts of short licences and of usual one-line notices (fixed values); more in licence_texts/.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: Whole texts in files, named by their licences, and their terms alone where an appendix follows.
_END = "END OF TERMS AND CONDITIONS"
for _file in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda x: x.name):
    _text = _file.read_text(encoding="utf-8")
    KNOWN[_file.name.removesuffix(".txt")] = _text
    if _END in _text:
        KNOWN[_file.name.removesuffix(".txt") + "-terms"] = _text[: _text.index(_END) + len(_END)]

#: Canonical titles above a licence text (fixed pattern).
TITLE = (
    "(?:the )?(?:(?:mit|isc|zlib|bsd|expat|simplified bsd|new bsd|modified bsd|bsd 2 clause|bsd 3 clause|2 clause bsd|3 clause bsd|"
    "bsd zero clause|zero clause bsd|0bsd|boost software|apache|gnu general public|gnu library general public|"
    "gnu lesser general public|mozilla public|gnu free documentation) licen[sc]e(?: mit| isc| zlib| 0bsd)?|"
    "(?:bsd )?(?:zero|two|three|2|3) clause licen[sc]e|boost software licen[sc]e version 1 0(?: august 17th 2003)?|"
    "mozilla public licen[sc]e version [0-9] [0-9])"
)

#: What is no word of a licence (fixed pattern).  At the start of a text: copyright statements of any
#: form and titles.  Elsewhere a line that begins with copyright and a year, or that is "all rights
#: reserved": other lines that begin with copyright may be wrapped words of the licence.  A title or
#: a rights line counts at the start only if text follows it.
COPYRIGHT_LINE = (
    rf"(?m)\A(?:[ \n]*(?:(?:portions )?copyright\b[^\n]*|c [0-9]{{4}}\b[^\n]*|all rights reserved|{TITLE}) *\n){{1,20}}"
    r"(?:[ \n]*copyright\b[^\n]*\z)?|\A[ \n]*copyright\b[^\n]*\z|"
    r"^ *(?:(?:portions )?copyright (?:copyright )?[0-9]{4}\b[^\n]*|c [0-9]{4}\b[^\n]*|all rights reserved *)$"
)


def one_spelling(words: Column) -> Column:
    """Canonical words, single-spaced, with equivalent spellings in one form."""
    words = F.concat(F.lit(" "), words, F.lit(" "))
    for other, form in SPELLINGS:
        words = F.replace(words, F.lit(f" {other} "), F.lit(f" {form} "))
    return F.trim(words)


def canonical_lines(text: Column) -> Column:
    """Lines with a word left, each lower-case, without punctuation and copyright lines."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, "\u00a9|\\(c\\)", " copyright "), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.regexp_replace(lines, COPYRIGHT_LINE, "")
    return F.filter(F.transform(F.split(lines, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def digest(words: Column) -> Column:
    spelled = one_spelling(words)
    return F.when(spelled != "", F.sha2(spelled, 256))


def known_licences(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """digest, licence: the texts above, and the rows (licence, text) of `extra`."""
    rows = spark.createDataFrame(sorted(KNOWN.items()), "licence string, text string")
    if extra is not None:
        rows = rows.unionByName(extra.select("licence", "text"))
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return (
        rows.select("licence", digest(whole).alias("digest"))
        .filter("digest is not null").groupBy("digest").agg(F.min("licence").alias("licence"))
    )


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, licence (of the whole text, or null), line_licences (sorted, distinct)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        canonical_lines(F.col(f"`{text_col}`").cast("string")).alias("lines"),
    )
    # The entire text first, at place 0, then its distinct lines.
    texts = F.concat(F.array(F.array_join("lines", " ")), F.array_distinct("lines"))
    looked = rows.select("row", "doc_id", F.posexplode(texts).alias("place", "words")).select(
        "row", "doc_id", "place", digest(F.col("words")).alias("digest")
    ).join(known, "digest", "left")
    entire = F.col("place") == 0
    return (
        looked.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(entire, F.col("digest"))).alias("digest"),
            F.max(F.when(entire, F.col("licence"))).alias("licence"),
            F.array_sort(F.collect_set(F.when(~entire, F.col("licence")))).alias("line_licences"),
        )
        .drop("row")
    )
