"""License scans by sentence rules, in SQL functions alone.

Texts are normalised to words (lower case, letters and digits) and ends: an end is a line end, or punctuation that white
space follows. A known licence sentence, of any length, is found where its words stand between two ends. Ends may also
stand between its words, since notices are wrapped at any word, carry comment marks and hold punctuation; comment marks
are neither letters nor digits and vanish. Sentences have identifiers; a text becomes the sequence of its identifiers,
and each licence has ordered rules of identifiers, possibly with others between. Known sentences are few and fixed, so
they are one pattern of the plan, and the scan is a narrow projection. The statement for DuckDB does the same steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, table
from .spans import let

# Normalised sentences by identifier.
SENTENCES = {
    "mit.name": ["released under the mit license", "licensed under the mit license", "the mit license", "mit license", "distributed under the mit license"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache2.name": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at"],
    "gpl3.name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2.name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl.name": ["this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"],
    "mpl2.name": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "ccbync.name": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby.name": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa.name": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0.name": ["licensed under cc0 1 0", "released under cc0 1 0", "dedicated to the public domain under cc0 1 0"],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense.free": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
    "agpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl.name": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "lgpl.free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "epl2.terms": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "bsl.grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "bsl.name": ["boost software license version 1 0", "distributed under the boost software license version 1 0"],
    "zlib.grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib.notice": ["this notice may not be removed or altered from any source distribution of the licensed software", "this notice may not be removed or altered from any source distribution"],
    "artistic2.name": ["licensed under the artistic license version 2 0", "the artistic license 2 0"],
    "bsd4.ad": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
}


#: Identifiers of licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = ("MIT", "Apache-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"spdx.{x.lower()}": ["spdx license identifier " + " ".join(x.lower().replace("-", " ").replace(".", " ").split())] for x in SPDX}


@dataclass(frozen=True)
class Rule:
    """A licence holds where its sentences stand in this order, others between them allowed."""

    license: str
    sequence: tuple[str, ...]


RULES = (
    Rule("MIT", ("mit.grant", "mit.notice")),
    Rule("MIT", ("mit.name",)),
    Rule("Apache-2.0", ("apache2.name",)),
    Rule("GPL-3.0", ("gpl3.name",)),
    Rule("GPL-3.0-or-later", ("gpl.free",)),
    Rule("GPL-2.0", ("gpl2.name",)),
    Rule("GPL-2.0-or-later", ("gpl2.free",)),
    Rule("LGPL-3.0", ("lgpl.name",)),
    Rule("MPL-2.0", ("mpl2.name",)),
    Rule("CC-BY-NC-4.0", ("ccbync.name",)),
    Rule("CC-BY-4.0", ("ccby.name",)),
    Rule("CC-BY-SA-4.0", ("ccbysa.name",)),
    Rule("CC0-1.0", ("cc0.name",)),
    Rule("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    Rule("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    Rule("ISC", ("isc.grant",)),
    Rule("Unlicense", ("unlicense.free",)),
    Rule("AGPL-3.0-or-later", ("agpl.free",)),
    Rule("AGPL-3.0", ("agpl.name",)),
    Rule("LGPL-3.0-or-later", ("lgpl.free",)),
    Rule("EPL-2.0", ("epl2.terms",)),
    Rule("BSL-1.0", ("bsl.grant",)),
    Rule("BSL-1.0", ("bsl.name",)),
    Rule("Zlib", ("zlib.grant", "zlib.notice")),
    Rule("Artistic-2.0", ("artistic2.name",)),
    Rule("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd4.ad", "bsd.names")),
    *(Rule(x, (f"spdx.{x.lower()}",)) for x in SPDX),
)
#: Where a licence holds, these say less and are left out.
IMPLIED = {"BSD-4-Clause": ("BSD-3-Clause", "BSD-2-Clause"), "BSD-3-Clause": ("BSD-2-Clause",)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps of normalising, each a pattern and what takes its place: ends are marked, other runs become one space, marks with
#: what is around them become two ends, one for the sentence before and one for that after.
STEPS = (("\\n|[.!?:;](?:[\\t\\n\\x0B\\f\\r ]|\\z)", "\x01"), ("[^a-z0-9\\x01]+", " "), (" ?\\x01[ \\x01]*", "\n\n"))
#: A known sentence between two ends; the longest first, so that none hides one that it begins.
KNOWN = {s: k for k, sentences in SENTENCES.items() for s in sentences}
SENTENCE = "\\n(" + "|".join("[ \\n]+".join(s.split()) for s in sorted(KNOWN, key=lambda s: (-len(s.split()), s))) + ")\\n"


def normalised(text: Column) -> Column:
    """Words with single spaces, and two line ends for each end; one at either end of the text."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.concat(F.lit("\n"), F.trim(out), F.lit("\n"))


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.transform(F.regexp_extract_all(normalised(text), F.lit(SENTENCE), F.lit(1)), lambda s: known[F.regexp_replace(s, "[ \\n]+", " ")])


def _pattern(rule: Rule) -> str:
    """The rule over comma-joined identifiers: each in order, others between them allowed."""
    return "(^|,)" + "(,.*,|,)".join(x.replace(".", "[.]") for x in rule.sequence) + "(,|$)"


def licenses(ids: Column) -> Column:
    """The licences whose rules match a sequence of identifiers, in the order of RULES, each once."""
    joined = F.array_join(ids, ",")
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(joined.rlike(_pattern(r)), F.lit(r.license)) for r in RULES])))
    less = F.flatten(F.array(*[F.when(F.array_contains(hits, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in IMPLIED.items()]))
    return F.array_except(hits, less)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, identifiers (array), licenses (array).

    Null and empty texts have none. Rows are kept one for one; other columns are dropped.
    """
    ids = documents(docs).select("doc_id", F.when(F.col("text").rlike(HINT), let(F.col("text"), identifiers)).otherwise(F.array().cast("array<string>")).alias("identifiers"))
    return ids.select("doc_id", "identifiers", F.when(F.size("identifiers") > 0, licenses(F.col("identifiers"))).otherwise(F.array().cast("array<string>")).alias("licenses"))


#: Every known sentence holds one of these, so that a text without them needs no cutting.
HINT = "(?i)licen[sc]e|acknowledgement|notice|permi|redistribut|copyright|cc[^a-z0-9]*by|cc0|public[^a-z0-9]+domain|unencumbered|rights[^a-z0-9]+reserved|free[^a-z0-9]+software"


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("identifiers").cast("long").alias("n_sentences"), F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"))


def op9_sql() -> str:
    """The same steps for DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for (pattern, _), to in zip(STEPS, ("chr(1)", "' '", "chr(10) || chr(10)"), strict=True):
        text = f"regexp_replace({text}, {quoted(pattern)}, {to}, 'g')"
    known = "CASE regexp_replace(s, '[ \\n]+', ' ', 'g') " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in KNOWN.items()) + " END"
    rules = ", ".join(f"CASE WHEN regexp_matches(identifiers, '{_pattern(r)}') THEN '{r.license}' END" for r in RULES)
    order = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(r.license for r in RULES)) + "]"
    drop = " ".join(f"AND NOT (x = '{b}' AND list_contains(hits, '{a}'))" for a, v in IMPLIED.items() for b in v)
    return f"""
WITH found AS (SELECT doc_id, list_transform(regexp_extract_all(chr(10) || trim({text}, ' ') || chr(10), {quoted(SENTENCE)}, 1), lambda s: {known}) AS ids FROM documents),
matched AS (SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS hits FROM (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS identifiers FROM found))
SELECT doc_id, n_sentences, identifiers, array_to_string(list_filter({order}, lambda x: list_contains(hits, x) {drop}), ',') AS licenses FROM matched"""
