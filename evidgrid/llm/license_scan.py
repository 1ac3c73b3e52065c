"""License scan by canonical digests (DataFrame functions only).

Texts are brought into a canonical form: copyright lines go, A-Z is lower-cased, punctuation and
white space become one blank, equivalent spellings become one. The SHA-256 of the canonical form is
joined with the digests of known license texts and notices. Units that are looked up are whole
texts, their paragraphs and their lines. Only texts with a word that some known text cannot do
without are put into canonical form; a text without any of these words cannot equal one. The known
texts are an argument; those that come with the package are in ``KNOWN``.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import BROADCAST_ROWS, LOWER, UPPER
from evidgrid.session import cut_lineage_counted

# Default known texts: license texts as published, without their copyright lines, the whole texts in
# the folder ``licenses``, one file per license, and short notices made from ``NAMES``.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in
all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will
the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = {
    "ISC": [ISC, f"ISC License\n\n{ISC}"],
    "MIT": [MIT, f"MIT License\n\n{MIT}"],
    "Zlib": [ZLIB],
    "all-rights-reserved": ["All rights reserved."],
}
# Names under which the licenses are published.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License", "GNU AGPL"),
    "Apache-2.0": ("Apache License", "Apache Software License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "CC-BY-4.0": ("CC BY", "Creative Commons Attribution"),
    "CC-BY-NC-4.0": ("CC BY-NC", "Creative Commons Attribution-NonCommercial"),
    "CC-BY-SA-4.0": ("CC BY-SA", "Creative Commons Attribution-ShareAlike"),
    "CC0-1.0": ("CC0", "Creative Commons Zero"),
    "EPL-2.0": ("Eclipse Public License", "EPL"),
    "GPL-2.0": ("GNU General Public License", "GNU GPL"),
    "GPL-3.0": ("GNU General Public License", "GNU GPL"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License", "GNU LGPL"),
    "LGPL-3.0": ("GNU Lesser General Public License", "GNU LGPL"),
    "MIT": ("MIT License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License", "MPL"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
SUBJECTS = ("", "This file is ", "This project is ", "This software is ", "This work is ", "This code is ")
TERMS = ("licensed under", "released under", "distributed under", "available under")


def versioned(license_id: str, name: str) -> list[str]:
    """The ways in which a name states the version that ends the id, if one does."""
    version = re.search(r"-(\d+)\.(\d+)$", license_id)
    if not version:
        return [name]
    number = f"{version[1]}.{version[2]}"
    numbers = [number, version[1]] if version[2] == "0" and "GNU" in name else [number]
    if license_id.startswith("CC"):
        kind = "Universal" if license_id.startswith("CC0") else "International"
        return [f"{name} {number}", f"{name} {number} {kind}"]
    return [f"{name}{link}{n}" for n in numbers for link in (" ", " v", " version ")]


def notices(license_id: str) -> list[str]:
    """Short notices of a license: who, term, article and name with version; SPDX lines."""
    ids = [license_id]
    if "GPL" in license_id:
        ids += [f"{license_id}-only", f"{license_id}-or-later"]
    out = [f"SPDX-License-Identifier: {spdx}" for spdx in ids]
    for name in NAMES[license_id]:
        for full in versioned(license_id, name):
            ends = [full] if "license" in full.lower() else [full, f"{full} License"]
            out += [f"License: {end}" for end in ends]
            for subject, term, end in product(SUBJECTS, TERMS, ends):
                if "license" in f"{term} {end}".lower():
                    out += [f"{subject}{term} {article}{end}" for article in ("", "a ", "the ")]
    return out


TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}
APPENDIX = "APPENDIX: How to apply the Apache License to your work."
for file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
    whole = file.read_text(encoding="utf-8")
    forms = [f"{TITLES[file.stem]}\n\n{whole}", whole] if file.stem in TITLES else [whole]
    if APPENDIX in whole:  # often left off
        forms.append(whole[: whole.index(APPENDIX)])
    KNOWN[file.stem] = KNOWN.get(file.stem, []) + forms
for known_id in NAMES:
    KNOWN[known_id] = notices(known_id) + KNOWN.get(known_id, [])

#: Equivalent spellings, replaced in this order wherever they stand.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
)
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|\([Cc]\)|\x{A9})[^\n]*$"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Every known text has one of these words in its canonical form, in one spelling only.
NEEDED = ("license", "licence", "software", "reserved")
#: Words of given known texts that are looked for before texts are put into canonical form.
MOST_WORDS = 200


def canonical_text(text: str) -> str:
    line = COPYRIGHT_LINE.replace(r"\x{A9}", "©")
    lowered = re.sub(line, "", text).translate(str.maketrans(UPPER, LOWER))
    words = re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", lowered).strip(" ")
    return reduce(lambda out, pair: out.replace(*pair), SPELLINGS, words)


def canonical(text: Column) -> Column:
    lowered = F.translate(F.regexp_replace(text, COPYRIGHT_LINE, ""), UPPER, LOWER)
    words = F.trim(F.regexp_replace(lowered, OTHER, " "))
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, words)


def known_digests() -> list[tuple[str, str]]:
    return sorted(
        {
            (hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
            for name, texts in KNOWN.items()
            for text in texts
        }
    )


def needed_words(forms: DataFrame) -> tuple[str, ...]:
    """Words of which every canonical text in ``forms`` has one; none if there is no such short list.

    ``NEEDED`` first, then the longest word of each text that is left. A word must stand in the raw
    texts too: ASCII, and no result of ``SPELLINGS``. Texts with more than ``MOST_WORDS`` different
    words of their own are looked up without a filter, which changes no result.
    """
    listed = reduce(lambda a, b: a | b, [F.contains("form", F.lit(word)) for word in NEEDED])
    changed = "|".join(new for _, new in SPELLINGS)
    able = F.filter(
        F.split("form", " "), lambda word: word.rlike("^[a-z0-9]+$") & ~word.rlike(changed)
    )
    longest = F.array_max(F.transform(able, lambda word: F.struct(F.length(word).alias("n"), word.alias("word"))))
    own = forms.where(~listed).select(longest["word"].alias("word")).distinct()
    words = [row.word for row in own.limit(MOST_WORDS + 1).collect()]
    if None in words or len(words) > MOST_WORDS:
        return ()
    return tuple(sorted({*NEEDED, *words}))


def scan(docs: DataFrame, texts_known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, whole_license, n_units, licenses.

    ``texts_known`` (license, text) are the texts to look for, a table of any size;
    without it those of ``KNOWN``. ``whole_license`` is the license that the whole text is (null if
    none), ``n_units`` the number of different units (whole text, paragraphs, lines) that are a known
    text, ``licenses`` their licenses, sorted. Null and empty texts have none. Rows that repeat an id
    are judged by their own texts; a null id is kept. An empty table gives an empty table; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    if texts_known is None:
        values = ", ".join(f"('{digest}', '{name}')" for digest, name in known_digests())
        known = spark.sql(f"SELECT * FROM VALUES {values} AS known(digest, license)")
        needed, small = NEEDED, True
    else:
        forms = texts_known.select("license", canonical(F.col("text")).alias("form")).where(
            "license IS NOT NULL AND form != ''"
        )
        needed = needed_words(forms)
        digests = forms.select(F.sha2("form", 256).alias("digest"), "license").distinct()
        known, rows_known = cut_lineage_counted(digests)
        small = rows_known <= BROADCAST_ROWS
    folded = F.lower(F.col("text"))
    possible = reduce(lambda a, b: a | b, [folded.contains(w) for w in needed], F.lit(not needed))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = texts.withColumn("mark", F.xxhash64("text"))
    units = F.array_distinct(
        F.concat(
            F.array("text"), F.split("text", r"\n[ \t\r]*\n"), F.split("text", r"\n")
        )
    )
    lowered = F.lower("unit")
    able = reduce(lambda a, b: a | b, [lowered.contains(w) for w in needed], F.lit(not needed))
    looked_up = (
        marked.where(possible)
        .select("doc_id", "mark", F.length("text").alias("size"), F.explode(units).alias("unit"))
        .where(able)
        .select(
            "doc_id",
            "mark",
            (F.length("unit") == F.col("size")).alias("whole"),
            F.sha2(canonical(F.col("unit")), 256).alias("digest"),
        )
        .distinct()
    )
    found = (
        looked_up.join(F.broadcast(known) if small else known, "digest")
        .groupBy("doc_id", "mark")
        .agg(
            F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
            F.count_distinct("digest").alias("n_units"),
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        )
        .select(
            F.col("doc_id").alias("id"),
            F.col("mark").alias("m"),
            "whole_license",
            "n_units",
            "licenses",
        )
    )
    rows = marked.drop("text")
    same = rows.doc_id.eqNullSafe(F.col("id")) & (rows.mark == F.col("m"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "whole_license",
        F.coalesce("n_units", F.lit(0)).alias("n_units"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )
