"""Licence scans by canonical digest lookup, with DataFrame expressions only.

A text is normalised (case, punctuation, copyright lines, equivalent spellings) and digested, and the digests of entire texts are hash-joined to
those of known licences. The same lookup over single lines finds licence notices inside other texts.

Cases: a null or empty text, or one of copyright lines and punctuation only, has no canonical form and matches nothing. Known texts that normalise alike are one licence, the
first by id. Repeated rows are treated alike. Texts of any length are digested whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.llm.common import table
from rippleset.llm.license_digests import FULL_DIGESTS

# --- Fixed values: known licence texts and notices, and spellings that mean the same ---
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
#: Texts of which the SQL knows nothing.
MORE = (
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)
#: Title lines that are set before texts which have none.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
}
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("wilful", "willful"),
             ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("merchantibility", "merchantability"))
# ---
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
_SIGN, _YEAR = r"(?:\((?i:c)\)|©)", r"[\[<{(]?[ \t]*(?:(?:19|20)\d\d|(?i:y{2,4}|year)\b)"
#: Words that go on with a sentence; a holder's name does not begin with them.
_SENTENCE = r"(?i:notices?|holders?|owners?|laws?|licen[cs](?:es?|ed|ing)|and|or|of|in|on|is|are|as|at|to|for|from|with|may|that|this|the|interests?|statements?|acts?|treat(?:y|ies)|protection|permission|disclaimers?|rights?|status|infringement)\b"
#: The copyright lines that are taken out: a sign, a year or a holder follows; a wrapped sentence may begin with the word too.
COPYRIGHT_NOTICE = (
    rf"(?m)^[ \t#*/;-]*(?:(?i:copyright)\b[ \t:]*(?:{_SIGN}|{_YEAR}|(?!{_SENTENCE})(?:(?i:by[ \t])|[A-Z\[<{{]))|{_SIGN}[ \t]*{_YEAR}|©"
    r"|(?i:all[ \t]+rights[ \t]+reserved)(?=[ \t\r.!*/#;-]*$))[^\n]*$")
#: Characters that are not letters, digits or beyond ASCII.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column, whole: bool = True) -> Column:
    """The form that is digested: lower case, no copyright lines, one spelling, words apart by one space."""
    if whole:
        text = F.when(text.rlike(r"(?i:copyright|\(c\)|©|all[ \t]+rights[ \t]+reserved)"), F.regexp_replace(text, COPYRIGHT_NOTICE, "")).otherwise(text)
    text = F.translate(text, UPPER, LOWER)
    text = F.concat(F.lit(" "), F.regexp_replace(text, PUNCTUATION, " "), F.lit(" "))
    one = text
    for other, plain in SPELLINGS:
        one = F.replace(one, F.lit(f" {other} "), F.lit(f" {plain} "))
    text = F.when(text.rlike("|".join(f" {other} " for other, _ in SPELLINGS)), one).otherwise(text)
    return F.trim(text)


def full_forms(text: str, title_lines: int) -> list[str]:
    """A licence file as it is usually met: with and without its title or appendix, wrapped and by paragraphs."""
    end = re.search(r"END OF TERMS AND CONDITIONS", text)
    whole = [text] + ([text[: end.end()]] if end else [])
    lines = [t.split("\n") for t in whole]
    starts = [[k for k, x in enumerate(t) if x.strip()] for t in lines]
    forms = whole + ["\n".join(t[at[k]:]) for t, at in zip(lines, starts, strict=True) for k in range(1, title_lines + 1)]
    return forms + ["\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", form)) for form in forms]


def digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``digest`` and ``license`` of texts."""
    given = spark.createDataFrame(texts, "license string, text string").withColumn("form", canonical(F.col("text")))
    return given.where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = (*KNOWN, *MORE), full: tuple[tuple[str, str], ...] = FULL_DIGESTS) -> DataFrame:
    """``digest`` and ``license`` of the known texts, with titles where they have none, and of full licence files."""
    titled = [(x, f"{title}\n\n{text}") for x, text in known if "\n" in text for title in TITLES.get(x, ())]
    both = digests(spark, [*known, *titled]).union(spark.createDataFrame(list(full), "license string, digest string").select("digest", "license"))
    return both.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_word: str | None = None) -> DataFrame:
    """``id_col``, ``digest`` of the entire text, its ``license``, and ``notices``, the licences of single lines (sorted, once each).

    ``known`` (``digest``, ``license``) is joined by hash: broadcast if Spark finds it small, shuffled if not. With ``line_word`` only lines holding it are
    looked up; give it when every known one-line notice holds it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    form = canonical(text)
    known_lines = known.select(F.col("digest").alias("_line"), F.col("license").alias("_notice"))
    given = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.when(form != "", F.sha2(form, 256)).alias("digest"), text.alias("_text"))
    held = F.col("_text") if line_word is None else F.when(F.contains(F.translate("_text", UPPER, LOWER), F.lit(line_word)), F.col("_text")).otherwise("")
    lines = F.filter(F.split(held, "\n"), lambda s: F.contains(F.translate(s, UPPER, LOWER), F.lit(line_word or "")) & (F.length(s) > 0))
    lines = F.array_distinct(F.transform(lines, lambda s: F.sha2(canonical(s, whole=False), 256)))
    whole = given.select("_row", id_col, "digest", lines.alias("_lines")).join(known, "digest", "left")
    # Rows with lines to look up leave the others alone; a row's lines stay together through its number of lines.
    some = whole.where(F.size("_lines") > 0).select("_row", id_col, "digest", "license", F.explode("_lines").alias("_line"))
    found = some.join(known_lines, "_line", "left").groupBy("_row").agg(F.first(id_col).alias(id_col), F.first("digest").alias("digest"), F.first("license").alias("license"), F.array_sort(F.collect_set("_notice")).alias("notices"))
    none = whole.where(F.size("_lines") == 0).select(id_col, "digest", "license", F.expr("cast(array() as array<string>)").alias("notices"))
    return none.unionByName(found.drop("_row"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence of every document as a whole, and the licence notices among its lines."""
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), known_digests(spark), line_word="licen")
    known = [x for x, text in KNOWN if "licen" not in text.lower() and "\n" not in text]
    if known:
        raise ValueError(f"one-line notices without the word: {known}")
    return out.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_form(text: str, whole: bool = True) -> str:
    text = f"translate({text}, '{UPPER}', '{LOWER}')"
    if whole:
        text = f"regexp_replace({text}, '{COPYRIGHT_LINE}', '', 'g')"
    text = f"' ' || regexp_replace({text}, '{PUNCTUATION}', ' ', 'g') || ' '"
    for other, plain in SPELLINGS:
        text = f"replace({text}, ' {other} ', ' {plain} ')"
    return f"trim({text}, ' ')"


_VALUES = ", ".join("('{}', '{}')".format(x, text.replace("'", "''")) for x, text in KNOWN)
OP5_SQL = f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license) AS license FROM (SELECT license, {_sql_form("text")} AS form FROM (VALUES {_VALUES}) AS t(license, text)) WHERE form <> '' GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON known.digest = sha256({_sql_form("line", whole=False)}) GROUP BY doc_id
), whole AS (
  SELECT doc_id, {_sql_form("coalesce(text, '')")} AS form FROM documents
)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON form <> '' AND known.digest = sha256(form) LEFT JOIN notices USING (doc_id)
"""
