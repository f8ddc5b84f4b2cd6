"""License scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences, the sentences normalised and looked up among known
licence sentences; the sequence of the identifiers found is then matched against
ordered rules. All of it is one projection over the scan: no shuffle, no Python.

Sentences end at signs and blank lines, and may begin and end at any line: a licence line
below a title or a table row without a full stop is found, and so is a sentence that is
wrapped over lines. At each place the longest known sentence counts.

Defined cases: a null or empty text has no sentences and no licence; a sentence that
occurs again counts again; rules are tried in order and a rule's sentences are used
up, so that a part of a longer licence is not reported a second time; of sentences that
begin at one place the longest wins (ties can't occur); very long texts are read whole, by one
pass of an expression whose work per letter is bounded; rows that share a doc_id or have none are each
reported; an empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (lower case, words only) and their identifiers.
SENTENCES: list[tuple[str, str]] = [
    ("MitName", "released under the mit license"),
    ("MitName", "licensed under the mit license"),
    ("MitName", "this project is licensed under the mit license"),
    ("MitName", "mit license"),
    ("MitName", "the mit license mit"),
    ("MitName", "spdx mit"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIsSoftware", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("AuthorsNotLiable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("ApacheName", "licensed under the apache license version 2_0"),
    ("ApacheName", "licensed under the apache license version 2_0 the license"),
    ("ApacheName", "apache license version 2_0 january 2004"),
    ("ApacheName", "spdx apache 2_0"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("Gpl3Name", "this work is licensed under the gnu general public license version 3"),
    ("Gpl3Name", "licensed under the gnu general public license version 3"),
    ("Gpl3Name", "spdx gpl 3_0 only"),
    ("GplOrLater", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplReceived", "you should have received a copy of the gnu general public license along with this program"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("MplName", "this source code form is subject to the terms of the mozilla public license v 2_0"),
    ("MplName", "spdx mpl 2_0"),
    ("CcByName", "licensed under cc by 4_0"),
    ("CcByName", "this work is licensed under a creative commons attribution 4_0 international license"),
    ("CcByNcName", "licensed under cc by nc 4_0"),
    ("CcByNcName", "this work is licensed under a creative commons attribution noncommercial 4_0 international license"),
    ("CcBySaName", "licensed under cc by sa 4_0"),
    ("PublicDomain", "this is free and unencumbered software released into the public domain"),
    ("AllRights", "all rights reserved"),
    ("GplTerms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("Gpl3Terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Gpl3Only", "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("LgplTerms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("Lgpl3Terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Agpl3Terms", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("Version2Later", "either version 2 of the license or at your option any later version"),
    ("Version21Later", "either version 2_1 of the license or at your option any later version"),
    ("Version3Later", "either version 3 of the license or at your option any later version"),
    ("GplHopeStart", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("LgplHopeStart", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("HopeEnd", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("Gpl2Name", "gnu general public license version 2 june 1991"),
    ("Gpl2Name", "licensed under the gnu general public license version 2"),
    ("Gpl3Name", "gnu general public license version 3 29 june 2007"),
    ("Lgpl21Name", "gnu lesser general public license version 2_1 february 1999"),
    ("Lgpl3Name", "gnu lesser general public license version 3 29 june 2007"),
    ("Agpl3Name", "gnu affero general public license version 3 19 november 2007"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BsdNotLiable", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("BsdHowever", "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("Bsd3Name", "bsd 3 clause license"),
    ("Bsd3Name", "licensed under the bsd 3 clause license"),
    ("Bsd2Name", "bsd 2 clause license"),
    ("Bsd2Name", "licensed under the bsd 2 clause license"),
    ("IscName", "isc license"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("MplName", "this source code form is subject to the terms of the mozilla public license v"),
    ("MplName", "mozilla public license version 2_0"),
    ("EplName", "eclipse public license v 2_0"),
    ("EplName", "this program and the accompanying materials are made available under the terms of the eclipse public license v2_0"),
    ("EplName", "this program and the accompanying materials are made available under the terms of the eclipse public license 2_0 which is available at https"),
    ("ArtisticName", "the artistic license 2_0"),
    ("BoostName", "boost software license version 1_0 august 17th 2003"),
    ("BoostName", "distributed under the boost software license version 1_0"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("Cc0Name", "cc0 1_0 universal"),
    ("CcBySaName", "this work is licensed under a creative commons attribution sharealike 4_0 international license"),
]

# Licences named by an SPDX tag, and the identifier of such a line.
SPDX = {
    "AGPL-3.0-only": "Agpl3Name", "AGPL-3.0-or-later": "Agpl3Name", "Artistic-2.0": "ArtisticName", "BSD-2-Clause": "Bsd2Name",
    "BSD-3-Clause": "Bsd3Name", "BSL-1.0": "BoostName", "CC-BY-4.0": "CcByName", "CC-BY-SA-4.0": "CcBySaName", "CC0-1.0": "Cc0Name",
    "EPL-2.0": "EplName", "GPL-2.0-only": "Gpl2Name", "GPL-2.0-or-later": "Gpl2Name", "GPL-3.0-or-later": "Gpl3Name", "ISC": "IscName",
    "LGPL-2.1-only": "Lgpl21Name", "LGPL-2.1-or-later": "Lgpl21Name", "LGPL-3.0-only": "Lgpl3Name", "LGPL-3.0-or-later": "Lgpl3Name",
    "Unlicense": "PublicDomain", "Zlib": "ZlibGrant",
}
SENTENCES += [(name, "spdx " + re.sub(r"[^a-z0-9_]+", " ", re.sub(r"(\d)\.(\d)", r"\1_\2", tag.lower()))) for tag, name in SPDX.items()]

# Ordered rules, as (licence, identifiers in sequence); other known sentences may not stand between.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["MitName", "MitGrant", "MitNotice", "AsIsSoftware", "AuthorsNotLiable"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsSoftware", "AuthorsNotLiable"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdNotLiable", "BsdHowever"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdNotLiable", "BsdHowever"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["Gpl3Terms", "GplHopeStart", "HopeEnd", "GplReceived"]),
    ("GPL-3.0-or-later", ["GplOrLater", "GplHope", "GplReceived"]),
    ("GPL-2.0-or-later", ["GplTerms", "Version2Later", "GplHopeStart", "HopeEnd", "GplReceived"]),
    ("AGPL-3.0-or-later", ["Agpl3Terms"]),
    ("LGPL-3.0-or-later", ["Lgpl3Terms"]),
    ("LGPL-3.0-or-later", ["LgplTerms", "Version3Later"]),
    ("LGPL-2.1-or-later", ["LgplTerms", "Version21Later"]),
    ("GPL-3.0-or-later", ["GplOrLater"]),
    ("GPL-3.0-or-later", ["Gpl3Terms"]),
    ("GPL-3.0-or-later", ["GplTerms", "Version3Later"]),
    ("GPL-2.0-or-later", ["GplTerms", "Version2Later"]),
    ("GPL-3.0", ["Gpl3Only"]),
    ("Apache-2.0", ["ApacheName", "ApacheComply", "ApacheAsIs"]),
    ("Apache-2.0", ["ApacheName"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("ISC", ["IscGrant"]),
    ("ISC", ["IscName"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant"]),
    ("BSL-1.0", ["BoostName", "BoostGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostName"]),
    ("AGPL-3.0", ["Agpl3Name"]),
    ("LGPL-3.0", ["Lgpl3Name"]),
    ("LGPL-2.1", ["Lgpl21Name"]),
    ("GPL-3.0", ["Gpl3Name"]),
    ("GPL-2.0", ["Gpl2Name"]),
    ("MPL-2.0", ["MplName"]),
    ("EPL-2.0", ["EplName"]),
    ("Artistic-2.0", ["ArtisticName"]),
    ("CC0-1.0", ["Cc0Name"]),
    ("BSD-3-Clause", ["Bsd3Name"]),
    ("BSD-2-Clause", ["Bsd2Name"]),
    ("CC-BY-NC-4.0", ["CcByNcName"]),
    ("CC-BY-SA-4.0", ["CcBySaName"]),
    ("CC-BY-4.0", ["CcByName"]),
    ("Unlicense", ["PublicDomain"]),
    ("MIT", ["MitName"]),
    ("MIT-like-grant", ["MitGrant"]),
    ("BSD-like-grant", ["BsdGrant"]),
    ("NOT-OPEN-RIGHTS-RESERVED", ["AllRights"]),
]

#: Signs that mean lines below are taken out of texts with the capitals.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz "
#: (pattern, replacement), in order: SPDX tags as sentences, points inside numbers kept, blank lines as ends of sentences,
#: other line ends as |, all other signs to spaces, ends of sentences as a point, no spaces at either.
STEPS = [
    (r"spdx[ -]license[ -]identifier[ \t]*:[ \t]*([a-z0-9.+-]+)", r". spdx $1 . "),
    (r"([0-9])\.([0-9])", r"$1_$2"),
    (r"\r?\n[ \t\r]*\n", r" . "),
    (r"[\r\n]+", r"|"),
    (r"[^a-z0-9_.!?;:|]+", r" "),
    (r"[ |]*[.!?;:][.!?;:| ]*", r"."),
    (r" *\|[| ]*", r"|"),
]
#: A known sentence between two ends, words parted by a space or a line's end, the longest first. Ends stand twice, so that neighbours share none.
KNOWN = r"[.|](" + "|".join(s.replace(" ", r"(?: |\|\|)") for _, s in sorted(SENTENCES, key=lambda x: (-len(x[1]), x[1]))) + r")[.|]"


def normalised(text: Column) -> Column:
    """Words with a space, | (a line's end) or . (a sentence's end) between them, in points."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.concat(F.lit("."), F.trim(out, F.lit(" .|")), F.lit("."))


def count_sentences(plain: Column) -> Column:
    return F.when(F.length(plain) > 2, F.regexp_count(plain, F.lit(r"\.")) - 1).otherwise(0)


def identifiers(plain: Column) -> Column:
    """Identifiers of the known sentences, in text order; the table of sentences is a constant of the plan."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES for x in (sentence, name)])
    found = F.regexp_extract_all(F.replace(F.replace(plain, F.lit("."), F.lit("..")), F.lit("|"), F.lit("||")), F.lit(KNOWN), F.lit(1))
    return F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit("||"), F.lit(" "))))


def match_rules(ids: Column) -> tuple[list[tuple[str, Column]], Column]:
    """For each rule how often it applies, in order, each on what the rules before it left; and the rest."""
    rest = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    found = []
    for licence, sequence in RULES:
        mark = "," + ",,".join(sequence) + ","
        found.append((licence, F.regexp_count(rest, F.lit(mark))))
        rest = F.regexp_replace(rest, F.lit(mark), F.lit(",-,"))
    return found, rest


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, licences (distinct, in rule order; none: NONE), n_unmatched."""
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("__s"))
    step = step.select("doc_id", count_sentences(F.col("__s")).cast("long").alias("n_sentences"), identifiers(F.col("__s")).alias("__i"))
    # Most texts hold no known sentence; the rules then have nothing to do.
    found, rest = match_rules(F.col("__i"))
    names = F.array_distinct(F.array_compact(F.array(*[F.when(n > 0, F.lit(licence)) for licence, n in found])))
    names = F.when(F.size("__i") == 0, F.array().cast("array<string>")).otherwise(names)
    unmatched = F.when(F.size("__i") == 0, F.lit(0)).otherwise(F.regexp_count(rest, F.lit(",[A-Z][A-Za-z0-9]*,")))
    return step.select(
        "doc_id",
        "n_sentences",
        F.size("__i").cast("long").alias("n_known"),
        F.array_join("__i", ",").alias("sentence_ids"),
        F.when(F.size(names) == 0, F.lit("NONE")).otherwise(F.array_join(names, ";")).alias("licences"),
        unmatched.cast("long").alias("n_unmatched"),
    )


def op3_license_rules(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern, replacement in STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(replacement.replace('$', chr(92)))}, 'g')"
    known = "MAP([" + ", ".join(quote(s) for _, s in SENTENCES) + "], [" + ", ".join(quote(n) for n, _ in SENTENCES) + "])"
    rest, columns = "CASE WHEN len(ids) = 0 THEN ',,' ELSE ',' || array_to_string(ids, ',,') || ',' END", []
    ctes = [f"r0 AS (SELECT *, {rest} AS rest0 FROM i)"]
    for k, (licence, sequence) in enumerate(RULES):
        mark = quote("," + ",,".join(sequence) + ",")
        ctes.append(f"r{k + 1} AS (SELECT *, contains(rest{k}, {mark}) AS hit{k}, replace(rest{k}, {mark}, ',-,') AS rest{k + 1} FROM r{k})")
        columns.append(f"CASE WHEN hit{k} THEN {quote(licence)} END")
    n = len(RULES)
    names = f"list_filter([{', '.join(columns)}], lambda x: x IS NOT NULL)"
    order = "[" + ", ".join(quote(x) for x in dict.fromkeys(licence for licence, _ in RULES)) + "]"
    names = f"list_filter(list_sort(list_transform(list_distinct({names}), lambda x: list_position({order}, x))), lambda x: true)"
    return f"""
WITH s AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, '.' || trim({out}, ' .|') || '.' AS plain FROM documents),
k AS MATERIALIZED (SELECT {known} AS known),
i AS (SELECT doc_id, CASE WHEN len(plain) > 2 THEN len(plain) - len(replace(plain, '.', '')) - 1 ELSE 0 END AS n_sentences,
 list_transform(regexp_extract_all(replace(replace(plain, '.', '..'), '|', '||'), {quote(KNOWN)}, 1), lambda x: known[replace(x, '||', ' ')]) AS ids FROM s, k),
{", ".join(ctes)}
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,
 CASE WHEN len({names}) = 0 THEN 'NONE' ELSE array_to_string(list_transform({names}, lambda p: {order}[p]), ';') END AS licences,
 CAST(len(regexp_extract_all(rest{n}, ',[A-Z][A-Za-z0-9]*,')) AS BIGINT) AS n_unmatched
FROM r{n}"""


OP3_SQL = _sql()
