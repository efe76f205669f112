"""Licence scan by canonical digests.

A text is made canonical: lower case, copyright lines dropped, every run of other signs than letters and
digits made one space, equivalent spellings made one. Its digest is then looked up by a hash join among the
digests of known licence texts. Entire texts are looked up: the whole document, and each of its lines, since
a notice stands on a line of its own. Known texts of LONG words or more are also found as blocks of consecutive lines
of a longer document (a wrapped text, a comment header). All of it is DataFrame expressions.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Lines that canonical texts lack, and spellings that count as equal (the public matching
# guidelines for licence texts).
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
SIGNS = r"[^\p{L}\p{N}]+"
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
]

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)

#: Known texts: (licence, text), a licence in each of its forms: full text or notice.
KNOWN = [
    ("MIT", "MIT License " + _MIT + _WARRANTY),
    ("MIT", _MIT + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("ISC", "ISC License " + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL),
    ("0BSD", _ISC + ". " + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


def _entire(path: Path) -> list[tuple[str, str]]:
    """A licence's entire text on one line, as wrapped in its file and with a line for each paragraph: they differ where a
    wrapped line begins like a copyright line."""
    raw = path.read_text("utf-8")
    line = COPYRIGHT_LINE.replace(r"\p{L}\p{N}", r"\w").replace("(?m)", "(?mi)")
    by_paragraph = "\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", raw))
    return [(path.stem, " ".join(re.sub(line, "", t).split())) for t in (raw, by_paragraph)]


KNOWN += [x for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")) for x in _entire(path)]

LONG = 40  # words


def plain(text: Column) -> Column:
    """The canonical form but for spellings."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), SIGNS, " "))


def spelled(plain_text: Column) -> Column:
    c = F.concat(F.lit(" "), plain_text, F.lit(" "))
    for one, other in SPELLINGS:
        c = F.replace(c, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(c)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    return spelled(plain(text))


def first_words(known: list[tuple[str, str]]) -> list[str]:
    """Words that a text must begin with to be a known one, in any spelling."""
    found = {w.split()[0] for _, t in known if (w := re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT_LINE.replace(r"\p{L}\p{N}", r"\w"), "", t.lower())).strip())}
    for _ in SPELLINGS:  # to a fixed point: one spelling can lead to another
        more = {x.split()[0] for one, other in SPELLINGS for x in (one, other) if {one.split()[0], other.split()[0]} & found}
        if more <= found:
            break
        found |= more
    return sorted(found)


def digest(plain_text: Column, firsts: list[str]) -> Column:
    """The digest of the canonical form; null for a text that begins like no known one, whose spelling needs no work."""
    return F.when(F.substring_index(plain_text, " ", 1).isin(firsts), F.md5(spelled(plain_text)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and licence of each known text. Two licences with one canonical text: the first by name stands."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "licence string, text string")
    keyed = rows.select("licence", canonical(F.col("text")).alias("text")).where("text <> ''")
    return keyed.groupBy(F.md5("text").alias("digest")).agg(F.min("licence").alias("licence"))


def anchor(words: list[str]) -> str:
    """Five words of a canonical text that no spelling can change, to look for before spellings are worked out; the
    empty text, which is in every document, if it has none."""
    varied = {w for pair in SPELLINGS for x in pair for w in x.split()}
    runs = (words[i : i + 5] for i in range(len(words) - 4))
    return next((" ".join(r) for r in runs if not varied & set(r)), "")


def with_blocks(rows: DataFrame, known: list[tuple[str, str]]) -> DataFrame:
    """rows (text, plain, ...) with `blocks`, the licences whose known text of LONG words or more is a block of whole
    consecutive lines. Lines are told apart by their number of words, so only where the text has the known one at all."""
    texts = rows.sparkSession.createDataFrame(known, "licence string, text string").select("licence", canonical(F.col("text")).alias("text")).distinct().collect()
    long = sorted((r["licence"], r["text"]) for r in texts if len(r["text"].split()) >= LONG)
    maybe = F.lit(False)
    for a in sorted({anchor(t.split()) for _, t in long}):
        maybe = maybe | F.contains("plain", F.lit(a))

    def n_words(c: Column) -> Column:
        return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))

    some = rows.withColumns({"own": F.when(maybe, spelled(F.col("plain"))), "parts": F.when(maybe, F.split("text", "\n"))})
    sizes = F.transform("parts", lambda line: n_words(spelled(plain(line))))
    some = some.withColumn("sizes", sizes)
    bounds = F.aggregate("sizes", F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    some = some.withColumns({"padded": F.concat(F.lit(" "), "own", F.lit(" ")), "words": F.split("own", " "), "bounds": F.array_distinct(bounds)})

    def stands(text: str) -> Column:
        n = len(text.split())
        here = F.exists("bounds", lambda b: F.array_contains("bounds", b + n) & (F.array_join(F.slice("words", b + 1, F.lit(n)), " ") == text))
        return F.when(F.contains("padded", F.lit(f" {text} ")), here).otherwise(F.lit(False))

    found = F.array(*(F.when(stands(t), F.lit(name)) for name, t in long)) if long else F.array().cast("array<string>")
    return some.select(*rows.columns, F.when(F.col("own").isNotNull(), F.array_distinct(F.array_compact(found))).alias("blocks"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (of the whole text, else null), notices (licences of single lines, sorted, each once, joined by
    commas; null if none) and n_notices (lines that are notices) of every row. Where the whole text is no licence, one
    that stands in it across lines, and on no line, counts as one notice.

    Null and empty texts, and lines without a letter or digit, match nothing. Null ids stay null, repeated rows
    come out each, other columns aren't read, an empty table gives no rows. The known texts are a list of the
    caller's, so small; their digests are broadcast. Digests of a row's text and lines are written once; only matching
    lines are grouped, with partial sums.
    """
    spark, known = docs.sparkSession, KNOWN if known is None else known
    digests, firsts = F.broadcast(known_digests(spark, known)), first_words(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[\p{L}\p{N}]"))
    rows = with_blocks(rows.withColumn("plain", plain(F.col("text"))), known)
    # one pass, written: all that follows has the same numbers of rows, and reads no text
    scanned = written(rows.select("row", "doc_id", digest(F.col("plain"), firsts).alias("digest"), F.array_compact(F.transform(lines, lambda line: digest(plain(line), firsts))).alias("lines"), "blocks"), "licence-digests")
    whole = scanned.select("row", "doc_id", "digest").join(digests, "digest", "left").select("row", "doc_id", "licence")
    found = scanned.select("row", F.explode("lines").alias("digest")).join(digests, "digest")
    named = found.select("row", "licence", F.lit(1).alias("n")).unionAll(scanned.select("row", F.explode("blocks").alias("licence")).select("row", "licence", F.lit(0)))
    counted = named.groupBy("row", "licence").agg(F.sum("n").alias("n")).groupBy("row")
    lists = counted.agg(F.collect_list(F.when(F.col("n") > 0, F.col("licence"))).alias("lines"), F.collect_list("licence").alias("all"), F.sum("n").alias("n"))
    joined = whole.join(lists, "row", "left").withColumn("all", F.when(F.col("licence").isNull(), F.col("all")).otherwise(F.col("lines")))
    return joined.select(
        "doc_id",
        "licence",
        F.when(F.size("all") > 0, F.array_join(F.array_sort("all"), ",")).alias("notices"),
        F.coalesce(F.col("n") + F.size("all") - F.size("lines"), F.lit(0).cast("long")).alias("n_notices"),
    )


def sql(known: list[tuple[str, str]] | None = None) -> str:
    """scan() of documents in SQL, for another engine; ids are taken to be unique."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def of(text: str) -> str:
        c = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(SIGNS)}, ' ', 'g')) || ' '"
        for one, other in SPELLINGS:
            c = f"replace({c}, ' {one} ', ' {other} ')"
        return f"trim({c})"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in (KNOWN if known is None else known))
    return (
        f"WITH k AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, {of('text')} AS digest FROM (VALUES {values}) v(licence, text)) WHERE digest <> '' GROUP BY digest), "
        f"w AS (SELECT doc_id, licence FROM (SELECT doc_id, {of('text')} AS digest FROM documents) LEFT JOIN k USING (digest)), "
        f"l AS (SELECT doc_id, licence FROM (SELECT doc_id, {of('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN k USING (digest)), "
        "n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices FROM l GROUP BY doc_id) "
        "SELECT doc_id, licence, notices, coalesce(n_notices, 0) AS n_notices FROM w LEFT JOIN n USING (doc_id)"
    )
