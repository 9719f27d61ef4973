"""License scans: texts in a canonical form are looked up by digest among known licenses.

Canonical form: lower case, copyright lines dropped, punctuation and runs of whitespace
turned into one space, equivalent spellings unified. The digests of entire texts meet those of
known licenses in one hash join, on which the size of the known side decides: Spark broadcasts it
below its own threshold and shuffles both sides above. Notices of one line, such as "Released
under ...", are looked up in the same way, each line of a text being an entire text of its own.

Everything runs in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column

# Spellings that the SPDX matching guidelines treat as equal, word by word.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

# Two words that are also written as one; after the spellings above.
JOINED = (("non", "commercial"), ("per", "cent"), ("sub", "license"), ("sub", "licensed"))

#: What becomes one space: ASCII punctuation and blanks, common typographic signs; not the line break.
PUNCTUATION = "[ !-/:-@\\[-`{-~\t\r\x0b\x0c\u00a0\u2010-\u2015\u2018\u2019\u201c\u201d\u2022]+"
#: Letters whose lower case is not the same everywhere.
CASES = (("\u0130", "i"), ("\u03a3", "\u03c3"))
#: A line that says who holds a copyright, with the line break before it.
COPYRIGHT_LINE = "\n[ \t>#*/;-]*(copyright( |\t|:)*(\\(c\\)|\u00a9|[0-9]|by |the )|\\(c\\)[ \t]|\u00a9|all rights reserved)[^\n]*"

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

# Texts of public licenses. A license may have several, as with and without its title.
KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY),
)

# One-line notices by the license they name.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line breaks; lines may have spaces at either end."""
    folded = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    for a, b in CASES:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    plain = F.regexp_replace(F.regexp_replace(F.lower(folded), COPYRIGHT_LINE, ""), PUNCTUATION, " ")
    words = F.split(F.regexp_replace(plain, " *\n *", " \n "), " ")
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    joined = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(spelled, w), w)), " ")
    pairs = "|".join(f"(?<= {a}) (?={b} )" for a, b in JOINED)
    return F.regexp_replace(F.concat(joined, F.lit(" ")), pairs, "")


def canonical(lines: Column) -> Column:
    """An entire text from :func:`canonical_lines`; empty if there is nothing but punctuation."""
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


# Digests of whole canonical texts of public licenses as Debian's /usr/share/common-licenses
# has them, made by ``known_digests``; a test makes them again where that folder is there.
KNOWN_DIGESTS = (
    ("Apache-2.0", "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)


def known_digests(spark, known=KNOWN) -> DataFrame:
    """``digest, license_id``, one row for each distinct canonical text (of two ids the first by name)."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in known])))
    texts = rows.select("license_id", canonical(canonical_lines(F.col("text"))).alias("c")).where("c != ''")
    return texts.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def all_known(spark) -> DataFrame:
    """``digest, license_id`` of all licenses that come with this module: those with texts and those with digests."""
    more = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for i, d in KNOWN_DIGESTS])))
    return known_digests(spark).union(more).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, notices=NOTICES, text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns), ``norm_sha256``, ``license_id``, ``notices`` for every row.

    ``known`` has ``digest, license_id`` (as :func:`known_digests` makes them of any table of texts);
    without it, :func:`all_known`. ``license_id`` is null unless the entire text is a known license.
    ``notices`` holds the sorted ids of the notices among the text's lines. Null, empty and
    punctuation-only texts have the digest of the empty text and no license. Repeated rows are
    alike; of two licenses with one digest the first by name counts; an empty table gives an empty
    result, an empty table of licenses finds none. Long texts are read whole; columns may have any
    name.
    """
    spark = docs.sparkSession
    known = all_known(spark) if known is None else known
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), canonical_lines(column(text_col)).alias("lines"))
    table = known_digests(spark, notices).collect() if notices else []  # a parameter, so few
    found = F.array().cast("array<string>")
    if table:
        digests = F.transform(F.split("lines", "\n"), lambda x: F.sha2(F.trim(x), 256))
        ids = F.create_map(*[F.lit(x) for r in table for x in (r["digest"], r["license_id"])])
        named = F.transform(F.array_intersect(digests, F.array(*[F.lit(r["digest"]) for r in table])), lambda d: ids[d])
        found = F.array_sort(F.array_distinct(named))
    keyed = packed.select("row", F.sha2(canonical(F.col("lines")), 256).alias("norm_sha256"), found.alias("notices"))
    joined = keyed.join(known.select("digest", "license_id"), F.col("norm_sha256") == F.col("digest"), "left")
    return joined.select("row", "norm_sha256", "license_id", "notices")


def license_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, norm_sha256, license_id, n_notices, notices`` (joined by commas) for every row."""
    out = scan_licenses(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "norm_sha256", "license_id", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ",").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL for the rows of :func:`license_ids`.

    Spellings are looked up in a table, word by word; two words become one where a list has them
    side by side. So a neighbour never hides a word, which replacing in the text could do.
    """

    def words(x: str) -> str:
        folded = f"chr(10) || coalesce({x}, '') || chr(10)"
        for a, b in CASES:
            folded = f"replace({folded}, '{a}', '{b}')"
        plain = f"regexp_replace(regexp_replace(lower({folded}), {_quoted(COPYRIGHT_LINE)}, '', 'g'), {_quoted(PUNCTUATION)}, ' ', 'g')"
        listed = f"list_filter(string_split(replace({plain}, chr(10), ' ' || chr(10) || ' '), ' '), lambda w: w <> '')"
        return f"list_transform({listed}, lambda w: coalesce(map_extract(spelled, w)[1], w))"

    spelled = "MAP {" + ", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in SPELLINGS) + "}"
    pairs = ", ".join(_quoted(f"{a} {b}") for a, b in JOINED)

    def spaced(w: str) -> str:
        return f"array_to_string(list_transform({w}, lambda x, i: x || CASE WHEN i < len({w}) AND x || ' ' || {w}[i + 1] IN ({pairs}) THEN '' ELSE ' ' END), '')"

    def table(rows) -> str:
        values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in rows)
        return f"""SELECT sha256(c) AS digest, license_id FROM (
            SELECT license_id, trim(regexp_replace({spaced("w")}, '[ \n]+', ' ', 'g')) AS c
            FROM (SELECT license_id, {words("t")} AS w FROM (VALUES {values}) v(license_id, t), dict)) WHERE c <> ''"""

    more = ", ".join(f"({_quoted(d)}, {_quoted(i)})" for i, d in KNOWN_DIGESTS)
    return f"""
        WITH dict AS (SELECT {spelled} AS spelled),
        known AS (SELECT digest, min(license_id) AS license_id FROM ({table(KNOWN)} UNION ALL SELECT * FROM (VALUES {more})) GROUP BY digest),
        notice AS (SELECT digest, min(license_id) AS license_id FROM ({table(NOTICES)}) GROUP BY digest),
        listed AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents, dict),
        canon AS (SELECT rid, doc_id, {spaced("w")} AS l FROM listed),
        whole AS (SELECT rid, doc_id, l, sha256(trim(regexp_replace(l, '[ \n]+', ' ', 'g'))) AS d FROM canon),
        found AS (SELECT rid, list_sort(list_distinct(list(n.license_id))) AS ids
                  FROM (SELECT rid, sha256(trim(unnest(string_split(l, chr(10))))) AS d FROM canon) x JOIN notice n ON n.digest = x.d GROUP BY rid)
        SELECT c.doc_id, c.d AS norm_sha256, k.license_id, coalesce(len(f.ids), 0) AS n_notices, coalesce(array_to_string(f.ids, ','), '') AS notices
        FROM whole c LEFT JOIN known k ON k.digest = c.d LEFT JOIN found f ON f.rid = c.rid
    """
