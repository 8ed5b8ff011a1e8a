"""Licence notices, found by the sentences they are made of (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.  The SQL knows these.
SENTENCES = {
    "all rights reserved": "rights-reserved",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-header",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-disclaimer",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by nc 4 0": "ccbync4-notice",
    "licensed under cc by 4 0": "ccby4-notice",
    "licensed under cc by sa 4 0": "ccbysa4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
}

# Rules in order; a rule is a run of identifiers, then its licence and terms.
RULES = [
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause", "permissive"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause", "permissive"),
    (("mit-grant", "mit-condition", "mit-disclaimer"), "MIT", "permissive"),
    (("mit-grant", "mit-condition"), "MIT", "permissive"),
    (("apache2-header", "apache2-comply", "apache2-copy"), "Apache-2.0", "permissive"),
    (("apache2-header", "apache2-comply"), "Apache-2.0", "permissive"),
    (("gpl-free", "gpl3-later"), "GPL-3.0-or-later", "copyleft"),
    (("gpl-free", "gpl2-later"), "GPL-2.0-or-later", "copyleft"),
    (("gpl3-later",), "GPL-3.0-or-later", "copyleft"),
    (("gpl2-later",), "GPL-2.0-or-later", "copyleft"),
    (("apache2-header",), "Apache-2.0", "permissive"),
    (("apache2-notice",), "Apache-2.0", "permissive"),
    (("mit-notice",), "MIT", "permissive"),
    (("mit-grant",), "MIT", "permissive"),
    (("gpl3-notice",), "GPL-3.0-only", "copyleft"),
    (("ccbync4-notice",), "CC-BY-NC-4.0", "restricted"),
    (("ccbysa4-notice",), "CC-BY-SA-4.0", "copyleft"),
    (("ccby4-notice",), "CC-BY-4.0", "permissive"),
    (("mpl2-notice",), "MPL-2.0", "copyleft"),
    (("rights-reserved",), "All-rights-reserved", "restricted"),
]

#: Ends of sentences: stops before white space or the end, and line ends.
ENDS = r"[.!?;:]+(?:[\x09-\x0D\x20]+|\z)|\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of the standard texts and headers as they are written there; "..." is a name of one to twelve words.
STANDARD = [
    ('The ASF licenses this file to you under the Apache License, Version 2.0 (the "License")', "apache2-header"),
    ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache2-copy"),
    ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "apache2-copy"),
    ("This project is licensed under the MIT License", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "mit-grant"),
    ("The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software", "mit-condition"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "mit-disclaimer"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "gpl3-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl2-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License", "gpl3-notice"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 3", "gpl3-notice"),
    *[
        (f"This work is licensed under {name}", identifier)
        for short, long, identifier in (("CC BY-NC 4.0", "Attribution-NonCommercial 4.0 International", "ccbync4-notice"), ("CC BY-SA 4.0", "Attribution-ShareAlike 4.0 International", "ccbysa4-notice"), ("CC BY 4.0", "Attribution 4.0 International", "ccby4-notice"))
        for name in (short, long, f"a Creative Commons {long} License", f"the Creative Commons {long} License")
    ],
    ("Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("Neither the name of ... nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl2-notice"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "mpl2-copy"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mpl2-copy"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl21-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "lgpl3-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl3-later"),
    ("This library is free software", "lgpl-free"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc-grant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc-grant"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "zlib-grant"),
    ("This software is provided 'as-is', without any express or implied warranty", "zlib-disclaimer"),
    ("This is free and unencumbered software released into the public domain", "unlicense-grant"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "unlicense-free"),
    ("Distributed under the Boost Software License, Version 1.0", "boost-notice"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following", "boost-grant"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "epl2-notice"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl2-notice"),
    ("To the extent possible under law, ... has waived all copyright and related or neighboring rights to this work", "cc0-waiver"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "bsd-source"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-advertising"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "apache2-warranty"),
    ("Apache License Version 2.0, January 2004", "apache2-title"),
    ("\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document", "apache2-terms"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl3-title"),
    ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gpl2-title"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lgpl21-title"),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lgpl3-title"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl3-title"),
    ("Mozilla Public License Version 2.0", "mpl2-title"),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "gnu-verbatim"),
    *[(f"SPDX-License-Identifier: {name}", identifier) for name, identifier in (
        ("MIT", "mit-notice"), ("Apache-2.0", "apache2-notice"), ("BSD-2-Clause", "bsd2-spdx"), ("BSD-3-Clause", "bsd3-spdx"), ("GPL-3.0-only", "gpl3-notice"), ("GPL-3.0-or-later", "gpl3-later"), ("GPL-2.0-only", "gpl2-only"), ("GPL-2.0-or-later", "gpl2-later"),
        ("LGPL-2.1-or-later", "lgpl21-later"), ("LGPL-3.0-or-later", "lgpl3-later"), ("AGPL-3.0-or-later", "agpl3-later"), ("MPL-2.0", "mpl2-notice"), ("ISC", "isc-grant"), ("Zlib", "zlib-grant"), ("Unlicense", "unlicense-grant"), ("BSL-1.0", "boost-notice"), ("EPL-2.0", "epl2-notice"), ("CC0-1.0", "cc0-waiver"))],
]

# Rules beyond those of the notices above, tried after the longer and before the shorter
# of them; an identifier in brackets may be missing.
MORE_RULES = [
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), "BSD-4-Clause", "permissive"),
    (("gpl3-title", "[gnu-verbatim]"), "GPL-3.0-only", "copyleft"),
    (("gpl2-title", "[gnu-verbatim]"), "GPL-2.0-only", "copyleft"),
    (("lgpl21-title", "[gnu-verbatim]"), "LGPL-2.1-only", "copyleft"),
    (("lgpl3-title", "[gnu-verbatim]"), "LGPL-3.0-only", "copyleft"),
    (("agpl3-title", "[gnu-verbatim]"), "AGPL-3.0-only", "copyleft"),
    (("apache2-title", "[apache2-terms]"), "Apache-2.0", "permissive"),
    (("mpl2-title",), "MPL-2.0", "copyleft"),
    (("mpl2-notice", "mpl2-copy"), "MPL-2.0", "copyleft"),
    (("lgpl-free", "lgpl21-later"), "LGPL-2.1-or-later", "copyleft"),
    (("lgpl-free", "lgpl3-later"), "LGPL-3.0-or-later", "copyleft"),
    (("gpl-free", "lgpl21-later"), "LGPL-2.1-or-later", "copyleft"),
    (("gpl-free", "lgpl3-later"), "LGPL-3.0-or-later", "copyleft"),
    (("gpl-free", "agpl3-later"), "AGPL-3.0-or-later", "copyleft"),
    (("lgpl21-later",), "LGPL-2.1-or-later", "copyleft"),
    (("lgpl3-later",), "LGPL-3.0-or-later", "copyleft"),
    (("agpl3-later",), "AGPL-3.0-or-later", "copyleft"),
    (("gpl2-only",), "GPL-2.0-only", "copyleft"),
    (("isc-grant",), "ISC", "permissive"),
    (("[zlib-disclaimer]", "zlib-grant"), "Zlib", "permissive"),
    (("unlicense-grant", "[unlicense-free]"), "Unlicense", "permissive"),
    (("boost-grant",), "BSL-1.0", "permissive"),
    (("boost-notice",), "BSL-1.0", "permissive"),
    (("epl2-notice",), "EPL-2.0", "copyleft"),
    (("cc0-waiver",), "CC0-1.0", "permissive"),
    (("bsd2-spdx",), "BSD-2-Clause", "permissive"),
    (("bsd3-spdx",), "BSD-3-Clause", "permissive"),
]
ALL_RULES = MORE_RULES + RULES


def marked(sentence: str) -> str:
    """A sentence as ``normal_form`` gives it; stops in it are optional there, and so is '...'."""
    words = re.sub(r"[^0-9a-z|*]+", " ", re.sub(r"[.!?;:]+(?=\s|$)", "|", sentence.replace("...", "*").lower()))
    return re.sub(r" ?\| ?", "|", words).strip(" |")


#: All sentences that are looked for; '|' is a stop inside a sentence, '*' a name.
KNOWN = SENTENCES | {marked(s): i for s, i in STANDARD}


def normal_form(text: Column) -> Column:
    """The whole text as words of lower-case ASCII letters and digits, joined by '|' where a sentence
    stops, else by a line end where a line does, else by a space; comment signs are left out."""
    form = F.regexp_replace(F.translate(text, UPPER + "|", LOWER + " "), r"[.!?;:]+(?=[\x09-\x0D\x20]|\z)", "|")
    form = F.regexp_replace(F.concat(F.lit("\n"), form, F.lit("\n")), r"[^0-9a-z|\n]+", " ")
    form = F.regexp_replace(form, r" ?\n ?(?:(?:rem|dnl) )?", "\n")
    return F.regexp_replace(F.regexp_replace(form, r"[ \n]*\|[ \n|]*", "|"), r"[ \n]*\n[ \n]*", "\n")


def sentence_pattern(sentences) -> str:
    """One alternation of the sentences over ``normal_form``, longest first: each from one end of a
    sentence or line to another, wrapped over lines in any way."""
    one = lambda s: s.replace("* ", "*|").replace(" ", "[ \\n]").replace("|", "[ \\n|]").replace("*", "[0-9a-z]+(?:[ \\n|][0-9a-z]+){0,11}?")
    return r"(?<=[\n|])(?:" + "|".join(one(s) for s in sorted(sentences, key=lambda s: (-len(s), s))) + r")(?=[\n|])"


def sentence_ids(text: Column, sentences: dict[str, str] = KNOWN) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    plain = {s.replace("|", " "): i for s, i in sentences.items() if "*" not in s}
    known = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    named = [(s.replace("|", " ").replace("*", ".*"), i) for s, i in sentences.items() if "*" in s]
    found = F.regexp_extract_all(normal_form(text), F.lit(sentence_pattern(sentences)), F.lit(0))

    def identifier(s: Column) -> Column:
        s = F.translate(s, "\n|", "  ")
        return F.coalesce(F.try_element_at(known, s), *[F.when(s.rlike(f"^{p}$"), i) for p, i in named])

    return F.transform(found, identifier)


def rule_pattern(rules=RULES) -> str:
    """One alternation in rule order over '<id><id>...'; the leftmost, then the first rule wins."""
    one = lambda i: f"(?:<{i[1:-1]}>)?" if i[0] == "[" else f"<{i}>"
    return "|".join("".join(map(one, ids)) for ids, _, _ in rules)


def rule_runs(rules) -> dict[str, str]:
    """Licence of every run of identifiers that a rule matches, with and without what may be missing."""
    runs: dict[str, str] = {}
    for ids, lic, _ in rules:
        forms = [""]
        for i in ids:
            forms = [f + x for f in forms for x in ([f"<{i[1:-1]}>", ""] if i[0] == "[" else [f"<{i}>"])]
        for f in forms:
            runs.setdefault(f, lic)
    return runs


def hint(sentences) -> str:
    """Words, one of which is in every known sentence: a text without any of them holds none.  Each is
    the word that most of the sentences without one so far have."""
    left, words = [set(s.replace("|", " ").replace("*", " ").split()) for s in sentences], []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in s:
                counts[w] = counts.get(w, 0) + (len(w) > 4)
        words.append(max(sorted(counts), key=lambda w: (counts[w], len(w))))
        left = [s for s in left if words[-1] not in s]
    return "(?i)" + "|".join(words)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = KNOWN, rules=ALL_RULES) -> DataFrame:
    """Licences of every whole text, wrapped or not, in comments or not.

    Returns key, n_sentences (known licence sentences, repeats included), sentence_ids (in order,
    comma-joined), licenses (distinct, sorted, comma-joined), n_matches (rules matched, left to
    right without overlap) and terms: restricted if any licence is, else copyleft if any is, else
    permissive, else none.  Row-wise: no shuffle.  Null and empty texts have no sentence; repeated
    rows and ties give a row each; extra columns are left out.
    """
    runs = F.create_map(*[F.lit(x) for pair in rule_runs(rules).items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for lic, kind in {lic: kind for _, lic, kind in rules}.items() for x in (lic, kind)])
    nothing = F.array().cast("array<string>")
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key), F.when(body.rlike(hint(sentences)), sentence_ids(body, sentences)).otherwise(nothing).alias("_ids"))
    matched = found.withColumn("_runs", F.when(F.size("_ids") > 0, F.regexp_extract_all(F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">")), F.lit(rule_pattern(rules)), F.lit(0))).otherwise(nothing))
    named = matched.withColumn("_lic", F.transform("_runs", lambda r: F.try_element_at(runs, r)))
    terms = F.transform("_lic", lambda x: F.try_element_at(kinds, x))
    return named.select(
        key,
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("_lic")), ",").alias("licenses"),
        F.size("_runs").cast("long").alias("n_matches"),
        F.when(F.array_contains(terms, "restricted"), "restricted").when(F.array_contains(terms, "copyleft"), "copyleft").when(F.array_contains(terms, "permissive"), "permissive").otherwise("none").alias("terms"),
    )


def oracle() -> str:
    """DuckDB SQL of ``scan_licenses`` over the documents, whose notices stand on one line each: it
    splits at line ends, and knows ``SENTENCES`` alone."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in SENTENCES.items()) + "}"
    runs = "MAP {" + ", ".join(f"{quoted(''.join(f'<{i}>' for i in ids))}: {quoted(lic)}" for ids, lic, _ in RULES) + "}"
    has = lambda kind: "len(list_intersect(lic, [" + ", ".join(quoted(x) for x in dict.fromkeys(lic for _, lic, k in RULES if k == kind)) + "])) > 0"
    return f"""
    WITH parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), {quoted(ENDS)}) AS parts FROM documents),
    ids AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: {known}[trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^0-9a-z]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids FROM parts),
    runs AS (SELECT doc_id, ids, regexp_extract_all('<' || array_to_string(ids, '><') || '>', {quoted(rule_pattern())}) AS runs FROM ids),
    lics AS (SELECT doc_id, ids, list_transform(runs, lambda r: {runs}[r]) AS lic FROM runs)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
        coalesce(array_to_string(list_sort(list_distinct(lic)), ','), '') AS licenses, CAST(len(lic) AS BIGINT) AS n_matches,
        CASE WHEN {has('restricted')} THEN 'restricted' WHEN {has('copyleft')} THEN 'copyleft' WHEN {has('permissive')} THEN 'permissive' ELSE 'none' END AS terms
    FROM lics"""
