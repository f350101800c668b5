"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines taken out, spellings that the SPDX matching
guidelines call equivalent replaced, everything but letters and digits made a single space. Its SHA-256 is joined
to the digests of known licences. The units looked up are the whole text of a document and each of its lines, each
as an entire text, so a document that is a licence and a document that carries a notice line are both found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, after the SPDX matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "acknowledgements": "acknowledgments", "analogues": "analogs", "analysed": "analyzed", "analysing": "analyzing",
    "artefacts": "artifacts", "authorisations": "authorizations", "authorise": "authorize", "authorises": "authorizes",
    "authorising": "authorizing", "catalogues": "catalogs", "centres": "centers", "favours": "favors", "favoured": "favored",
    "fulfils": "fulfills", "initialised": "initialized", "judgements": "judgments", "licenced": "licensed",
    "licencee": "licensee", "licencees": "licensees", "licences": "licenses", "licencing": "licensing", "licencor": "licensor",
    "maximised": "maximized", "offences": "offenses", "optimised": "optimized", "organisations": "organizations",
    "organised": "organized", "practised": "practiced", "programmes": "programs", "realised": "realized",
    "recognised": "recognized", "recognises": "recognizes", "sublicence": "sublicense", "sublicences": "sublicenses",
    "sublicenced": "sublicensed", "sublicencing": "sublicensing", "utilise": "utilize", "utilised": "utilized",
    # a hyphen is a space by now; after those above
    "sub license": "sublicense", "sub licenses": "sublicenses", "sub licensed": "sublicensed", "sub licensing": "sublicensing",
    "non commercial": "noncommercial", "non infringement": "noninfringement", "copyright owner": "copyright holder",
}

# Texts of well-known short licences, and one-line notices of these and longer ones.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace("granted, provided that the above copyright notice and this permission notice appear in all copies.", "granted.")
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_3 = _BSD_2.replace("\nTHIS", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
_BULLETS = str.maketrans("123", "***")
LICENCES = [
    ("MIT", "text", _MIT),
    ("MIT", "text", f"MIT License\n{_MIT}"),
    ("MIT", "text", f"The MIT License (MIT)\n{_MIT}"),
    ("ISC", "text", _ISC),
    ("ISC", "text", f"ISC License\n{_ISC}"),
    ("0BSD", "text", _0BSD),
    ("0BSD", "text", f"BSD Zero Clause License\n{_0BSD}"),
    *(("BSD-2-Clause", "text", title + text) for title in ("", "BSD 2-Clause License\n") for text in (_BSD_2, _BSD_2.translate(_BULLETS))),
    *(("BSD-3-Clause", "text", title + text) for title in ("", "BSD 3-Clause License\n") for text in (_BSD_3, _BSD_3.translate(_BULLETS))),
    ("Unlicense", "text", _UNLICENSE),
    ("Unlicense", "text", _UNLICENSE.replace("https:", "http:")),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "notice", "SPDX-License-Identifier: BSD-2-Clause"),
]

#: A line that opens with a copyright sign or word.
COPYRIGHT_LINE = r"(?m)^[\x20\t]*(copyright|\(c\)|©)([^a-z0-9\n][^\n]*)?$"
#: Each known licence holds one of these in its canonical form, as does whatever has the same form.
CUES = ("licen", "permission", "redistribution")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words of a-z and 0-9 with single spaces."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    for word, usual in SPELLINGS.items():
        plain = F.regexp_replace(plain, rf"\b{word}\b", usual)
    return plain


def has_cue(text: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(F.lower(text), F.lit(cue))
    return found


def known(spark: SparkSession, licences: DataFrame | None = None) -> DataFrame:
    """digest, licence, kind of ``licences`` (licence, kind, text), or else of the fixed table LICENCES."""
    rows = spark.createDataFrame(LICENCES, "licence string, kind string, text string") if licences is None else licences
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence", "kind").distinct()


def licences_in(spark: SparkSession, folder: str) -> DataFrame:
    """(licence, kind, text) of the files in a folder, a whole licence each; the file's name without ``.txt`` names it."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.txt$", "")
    return files.select(name.alias("licence"), F.lit("text").alias("kind"), "text")


def scan_licences(documents: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """The licences that documents carry: doc_id, licence, kind, n.

    Kind ``text``: the whole document is that licence (n is the number of rows of that doc_id for which it is).
    Kind ``notice``: n lines are a notice of it. Documents without a match have no row; null and empty texts match
    nothing. Rows with the same doc_id, or with none, add up. Other columns are not used. ``licences`` (licence,
    kind, text) takes the place of LICENCES, such as ``licences_in`` a folder of long texts; its texts need no cue, so every
    document and line is then looked up.
    """
    cue = has_cue if licences is None else (lambda text: F.trim(text) != "")
    texts = documents.where(cue(F.col("text"))).select("doc_id", "text")
    # the whole text first, then its lines
    units = texts.select("doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("at", "unit")).where(cue(F.col("unit")))
    units = units.select("doc_id", F.when(F.col("at") == 0, "text").otherwise("notice").alias("kind"), F.sha2(canonical(F.col("unit")), 256).alias("digest"))
    digests = known(documents.sparkSession, licences)
    # LICENCES is a fixed table of some dozens of digests
    found = units.join(F.broadcast(digests) if licences is None else digests, ["digest", "kind"])
    return found.groupBy("doc_id", "licence", "kind").agg(F.count("*").alias("n"))


def _sql(text: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    for word, usual in SPELLINGS.items():
        plain = f"regexp_replace({plain}, '\\b{word}\\b', '{usual}', 'g')"
    return f"sha256({plain})"


def oracle() -> str:
    """The same in DuckDB's SQL, over every document and line."""
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in LICENCES)
    return f"""
        WITH known AS (SELECT DISTINCT {_sql("text")} AS digest, licence, kind FROM (VALUES {rows}) t(licence, kind, text)),
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents),
        units AS (SELECT doc_id, 'text' AS kind, text AS unit FROM documents
                  UNION ALL SELECT doc_id, 'notice', unit FROM lines WHERE lower(unit) LIKE '%licen%' OR lower(unit) LIKE '%permission%'),
        found AS (SELECT doc_id, kind, {_sql("unit")} AS digest FROM units)
        SELECT doc_id, licence, kind, count(*) AS n FROM found JOIN known USING (digest, kind) GROUP BY doc_id, licence, kind
    """
