"""Licence scan by sentence rules.

A text is cut into sentences at blank lines and at sentence marks before a space.
A single line break, with what a comment puts before its lines, is a space within
a sentence as well as a place where one may start or end: wrapped sentences and
those on lines of their own are both found, the longest first.
A sentence is normalised (lower case; anything but letters, digits, plus, hyphen
and full stops within words becomes one space) and looked up in a table of known
licence sentences, which gives its identifier.  The identifiers, in the order of
the text, are matched against licence rules: each asks for a sequence of
identifiers that appear in its order, with other known sentences between them or
not.  Rules are ordered; a text's licence is the first rule that matches, and all
matching rules are listed.

Everything is DataFrame functions on one row at a time: no shuffle and no
Python.  Tables are literals of the size of the rule set.

Defined cases: a null or empty text has no sentence and no licence (empty lists,
null licence).  Repeated rows are each scanned.  Other columns are carried; where
their names clash the new ones get a `_`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Sentences of public licence notices, by identifier; as the cut leaves them.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-may-not": "you may not use this file except in compliance with the License",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-version-3": "either version 3 of the License, or (at your option) any later version",
    "gpl-version-2": "either version 2 of the License, or (at your option) any later version",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0",
    "ccby4-notice": "Licensed under CC BY 4.0",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0",
    "cc0-notice": "Released under CC0 1.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-lgpl21-later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx-lgpl3-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl3-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-epl2": "SPDX-License-Identifier: EPL-2.0",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx-zlib": "SPDX-License-Identifier: Zlib",
    "spdx-boost": "SPDX-License-Identifier: BSL-1.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
    "agpl3-notice": "This program is licensed under the GNU Affero General Public License, version 3",
    "lgpl21-notice": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
# The standard notices' full sentences, with the identifiers that each stands for.
FULL = (
    (("apache2-notice",), "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    (("apache2-as-is",), "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    (("mit-grant",), SENTENCES["mit-grant"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    (("as-is",), SENTENCES["as-is"] + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    *(
        (ids, ", ".join([*([": ".join(SENTENCES[k] for k in ids[:-1])]), SENTENCES[ids[-1]]]))
        for v in ("gpl-version-3", "gpl-version-2")
        for ids in (("gpl-free", "gpl-redistribute", v), ("gpl-redistribute", v))
    ),
)
# Ordered rules, the longer sequence before its own parts.
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-may-not")),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-obtain", "apache2-url")),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-version-3")),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("GPL-3.0-only", ("spdx-gpl3",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-version-2")),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("BSD-2-Clause", ("spdx-bsd2",)),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("spdx-isc",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Unlicense", ("spdx-unlicense",)),
    ("Zlib", ("zlib-as-is", "zlib-origin")),
    ("Zlib", ("spdx-zlib",)),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("spdx-boost",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("AGPL-3.0-or-later", ("spdx-agpl3-later",)),
    ("LGPL-2.1-only", ("lgpl21-notice",)),
    ("LGPL-2.1-or-later", ("spdx-lgpl21-later",)),
    ("LGPL-3.0-or-later", ("spdx-lgpl3-later",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-2.0", ("spdx-epl2",)),
)

#: What is dropped at a sentence's ends and between words.
GAP = r"[^a-z0-9+.\-]+"
EDGE = r"^[ .\-]+|[ .\-]+$"
#: Replaced in turn in a lower case text: H is a cut, S a single line break.  Each run is
#: entered at its start only, so any run takes linear time.
STEPS = (
    (r"[.!?;](?=\s)", "H"),
    (r"[^a-z0-9+.\-\n\rH]+", " "),
    (r"(?<![ .\-\n\rH])[ .\-]*+(?:H|(?>\r\n|[\n\r])[ .\-]*+[\n\rH])[ .\-\n\rH]*+", "H"),
    (r"(?<![ .\-\n\r])[ .\-]*+[\n\r]++[ .\-]*+", "S"),
)


def normal(text: Column) -> Column:
    """A text in normal form, with its cuts and line breaks."""
    out = F.lower(text)
    for k, (pattern, by) in enumerate(STEPS):
        out = F.regexp_replace(F.concat(F.lit("H"), out, F.lit("H")) if k == 2 else out, pattern, by)
    return out


def known(sentences: dict[str, str]) -> dict[str, str]:
    """Identifiers by normal form.  (The same form as `normal`, for the table's own sentences.)"""
    return {re.sub(EDGE, "", re.sub(GAP, " ", text.lower())): key for key, text in sentences.items()}


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES, full=FULL) -> Column:
    """The identifiers of a text's known sentences, in order."""
    forms = {form: (key,) for form, key in known(sentences).items()}
    for keys, sentence in full:
        forms |= dict.fromkeys(known({"": sentence}), keys)
    table = F.create_map(*[x for form, keys in forms.items() for x in (F.lit(form), F.array(*map(F.lit, keys)))])
    longest_first = sorted(forms, key=len, reverse=True)
    pattern = "(?<=[HS])(?:" + "|".join(re.escape(f).replace(r"\ ", "[ S]") for f in longest_first) + ")(?=[HS])"
    hits = F.regexp_extract_all(normal(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.flatten(F.transform(hits, lambda x: F.try_element_at(table, F.translate(x, "S", " "))))


def matching(ids: Column, rules=RULES) -> Column:
    """The licences of all rules that match, in the rules' order, each once."""
    joined = F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|"))
    hits = [F.when(joined.rlike("".join(rf"\|{key}(?=\|)" + (".*" if k < len(keys) - 1 else "") for k, key in enumerate(keys))), F.lit(name)) for name, keys in rules]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns with sentence_ids, licences (all that match) and licence (the first); a name
    that a document has already gets a `_`.

    Few texts hold a known sentence, so the rules see only those."""
    ids, every, first = (fresh(docs.columns, n) for n in ("sentence_ids", "licences", "licence"))
    rows = docs.withColumn(ids, identifiers(F.col(f"`{text}`")))
    found = F.when(F.size(ids) > 0, matching(F.col(ids))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn(every, found).withColumn(first, F.try_element_at(every, F.lit(1)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences and licence, as texts, of every document."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licences", " ").alias("licences"),
        "licence",
    )


def oracle(docs: str = "documents") -> str:
    """The report in DuckDB's SQL, whose patterns have no look-around: marks are doubled instead,
    so that two sentences side by side each have their own."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    forms = {form: (key,) for form, key in known(SENTENCES).items()}
    for keys, sentence in FULL:
        forms |= dict.fromkeys(known({"": sentence}), keys)
    table = ", ".join(f"({text(form)}, {j}, {text(key)})" for form, keys in forms.items() for j, key in enumerate(keys))
    pattern = "[HS](" + "|".join(re.escape(f).replace(r"\ ", "(?: |SS)") for f in sorted(forms, key=len, reverse=True)) + ")[HS]"
    rules = ", ".join(
        f"({k}, {text(name)}, {text(''.join(chr(92) + '|' + key + ('(' + chr(92) + '|.*)?' if i < len(keys) - 1 else chr(92) + '|') for i, key in enumerate(keys)))})"
        for k, (name, keys) in enumerate(RULES)
    )
    return rf"""
WITH known(form, j, id) AS (VALUES {table}), rules(k, name, pattern) AS (VALUES {rules}),
marked AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), '[.!?;]([ \t\n\r\f\x0B])', 'H\1', 'g') AS x FROM {docs}),
plain AS (SELECT r, doc_id, 'H' || regexp_replace(x, '[^a-z0-9+.\-\n\rH]+', ' ', 'g') || 'H' AS x FROM marked),
cut AS (SELECT r, doc_id, regexp_replace(regexp_replace(x, '[ .\-]*(?:H|[\n\r][ .\-]*[\n\rH])[ .\-\n\rH]*', 'H', 'g'), '[ .\-]*[\n\r]+[ .\-]*', 'S', 'g') AS x FROM plain),
hits AS (SELECT r, doc_id, regexp_extract_all(replace(replace(x, 'H', 'HH'), 'S', 'SS'), {text(pattern)}, 1) AS found FROM cut),
one AS (SELECT r, replace(unnest(found), 'SS', ' ') AS form, generate_subscripts(found, 1) AS i FROM hits),
hit AS (SELECT o.r, o.i, k.j, k.id FROM one o JOIN known k ON o.form = k.form),
ids AS (SELECT r, count(*) AS n, string_agg(id, ' ' ORDER BY i, j) AS ids, '|' || string_agg(id, '|' ORDER BY i, j) || '|' AS joined FROM hit GROUP BY r),
names AS (SELECT i.r, u.name, min(u.k) AS k FROM ids i JOIN rules u ON regexp_matches(i.joined, u.pattern) GROUP BY i.r, u.name),
lists AS (SELECT r, string_agg(name, ' ' ORDER BY k) AS names, arg_min(name, k) AS first FROM names GROUP BY r)
SELECT c.doc_id, coalesce(i.n, 0)::BIGINT AS n_sentences, coalesce(i.ids, '') AS sentence_ids,
       coalesce(l.names, '') AS licences, l.first AS licence
FROM hits c LEFT JOIN ids i ON c.r = i.r LEFT JOIN lists l ON c.r = l.r
"""
