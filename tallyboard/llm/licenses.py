"""Licence scans by sentence rules, with DataFrame functions.

A text is cut into pieces (at line ends and after . ! ? ; : before white space), each normalised
(lower case, comment marks and punctuation to spaces, blanks collapsed). A known licence sentence is
one piece or, wrapped, a run of lines of one paragraph: a run ends where a sentence does and at blank
lines (comment marks alone are blank). Of known sentences that begin at one place the longest counts.
Each becomes its identifier, all else vanishes, and what remains is a sequence of identifiers. Ordered
rules - longer sequences first - match runs of that sequence; what one rule took, a later one cannot
take again. A sentence that names a version has an identifier of its own, so a licence is named only
where the text says which one. Texts without any of the anchor words, one of which every known
sentence holds, are not cut.

Cases: texts are read whole, whatever their length. A null or empty text has no sentences, licences or identifiers. Repeated sentences and rows
count each. An empty table gives an empty result. Only id and text are read, so other columns' names
never clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, as printed in the licences' own texts and usual notices.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-short-title": "MIT License",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software",
    "lgpl-free": "This library is free software",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "either-3": "either version 3 of the License, or (at your option) any later version.",
    "either-21": "either version 2.1 of the License, or (at your option) any later version.",
    "either-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11-notice": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-granted": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-title": "Boost Software License - Version 1.0",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
    "apache-plain-notice": "Licensed under the Apache License 2.0.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "version-3": "Version 3, 29 June 2007",
    "version-21": "Version 2.1, February 1999",
    "version-2": "Version 2, June 1991",
    "agpl-version-3": "Version 3, 19 November 2007",
    "only-2": "version 2 of the License.",
    "only-21": "version 2.1 of the License.",
    "only-3": "version 3 of the License.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-name": "Mozilla Public License, v. 2.0",
    "mpl11-title": "Mozilla Public License Version 1.1",
    "mpl11-name": "Mozilla Public License, v. 1.1",
    "bsd2-title": "BSD 2-Clause License",
    "bsd3-title": "BSD 3-Clause License",
    "isc-title": "ISC License",
    "zlib-title": "zlib License",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-title": "Eclipse Public License - v 1.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-work": "This work is licensed under a CC0 1.0 Universal License.",
    "unlicense-title": "The Unlicense",
    "eupl-notice": "Licensed under the EUPL, Version 1.2",
    "artistic-title": "The Artistic License 2.0",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "ofl-title": "SIL OPEN FONT LICENSE",
}

#: Licences that a tag names, by their short identifiers.
TAGGED = (
    "0BSD", "AFL-3.0", "AGPL-1.0-only", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause",
    "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BlueOak-1.0.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FSFAP", "GFDL-1.3-or-later",
    "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0",
    "PostgreSQL", "Python-2.0", "Ruby", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
SENTENCES |= {f"tag-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in TAGGED}

#: Ordered rules: licence and the sentence identifiers that stand in a row. Full texts come before notices.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-short-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-obtain", "apache-basis", "apache-limits")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-redistribute")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute", "either-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-redistribute")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute", "either-2")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl3-redistribute")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-redistribute", "either-3")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-redistribute")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl21-redistribute")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-redistribute", "either-21")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-redistribute")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-redistribute", "either-3")),
    ("GPL-2.0-only", ("gpl-free", "gpl2-only")),
    ("GPL-2.0-only", ("gpl-free", "gpl-redistribute", "only-2")),
    ("GPL-3.0-only", ("gpl-free", "gpl-redistribute", "only-3")),
    ("LGPL-2.1-only", ("lgpl-free", "lgpl-redistribute", "only-21")),
    ("GPL-3.0", ("gpl-title", "version-3")),
    ("GPL-2.0", ("gpl-title", "version-2")),
    ("LGPL-3.0", ("lgpl-title", "version-3")),
    ("LGPL-2.1", ("lgpl-title", "version-21")),
    ("AGPL-3.0", ("agpl-title", "agpl-version-3")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("Zlib", ("zlib-provided", "zlib-granted")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-header",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-short-title",)),
    ("MIT", ("mit-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-distributed",)),
    ("WTFPL", ("wtfpl-title",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("reserved",)),
    ("Apache-2.0", ("apache-plain-notice",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("MPL-1.1", ("mpl11-title",)),
    ("MPL-1.1", ("mpl11-name",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("ISC", ("isc-title",)),
    ("Zlib", ("zlib-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-work",)),
    ("Unlicense", ("unlicense-title",)),
    ("EUPL-1.2", ("eupl-notice",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("OFL-1.1", ("ofl-title",)),
) + tuple((name, (f"tag-{name.lower()}",)) for name in TAGGED)

#: Every known sentence holds one of these, in lower case.
ANCHORS = ("licen", "version", "cc0", "permission", "copyright", "warrant", "free software", "redistribut", "rights reserved", "public domain", "as is")

#: Signs that end no sentence: an abbreviation's point and the colon of a tag; and what stands for them.
SHORT = ((" v. ", " v "), ("license-identifier: ", "license-identifier "))
END = r"[.!?;:]+\s+"
CUT = rf"\n|{END}"
NOISE = r"[^a-z0-9]+"


def _normal(sentence: str) -> str:
    return re.sub(NOISE, " ", sentence.lower()).strip()


def _cut(text: str) -> list[str]:
    low = text.lower()
    for sign, form in SHORT:
        low = low.replace(sign, form)
    return [x for s in re.split(CUT, low) if (x := _normal(s))]


def known() -> dict[str, str]:
    """Identifier of each known normalised sentence, which must be one piece of the cut."""
    pieces = {i: _cut(s) for i, s in SENTENCES.items()}
    out = {x: i for i, parts in pieces.items() for x in parts}
    if any(len(p) != 1 for p in pieces.values()) or len(out) < len(SENTENCES) or not all(any(a in s.lower() for a in ANCHORS) for s in SENTENCES.values()):
        raise ValueError("licence sentences must be single ones, differ and hold an anchor")
    return out


def sentence_ids(text: Column) -> Column:
    """Array of identifiers of the known sentences of a text, in order."""
    sentences = known()
    ids = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    # lower-cased text has no capitals: S stands for an end of sentence or paragraph, L for one of a line
    whole = F.lower(text)
    for sign, form in SHORT:
        whole = F.replace(whole, F.lit(sign), F.lit(form))
    marked = F.concat(F.lit("S"), F.replace(F.regexp_replace(whole, END, "S"), F.lit("\n"), F.lit("L")), F.lit("S"))
    marked = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9SL]+", " "), " *([SL]) *", "$1")
    marked = F.regexp_replace(marked, "L*S[SL]*|LL+", "S")
    one_of = "|".join(x.replace(" ", "[ L]") for x in sorted(sentences, key=len, reverse=True))
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[SL])(?:{one_of})(?=[SL])"), F.lit(0))
    has = F.lower(text).rlike("|".join(a.replace(" ", NOISE) for a in ANCHORS))
    return F.when(has, F.transform(found, lambda s: F.element_at(ids, F.replace(s, F.lit("L"), F.lit(" "))))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, n_sentences (known ones), sentence_ids and licenses (both joined by commas).

    licenses lists each rule's licence once for each match, in the rules' order.
    """
    out = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("_ids"))
    out = out.select(id_col, F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"))
    # identifiers stand between bars, so neighbours never share one and a match is a plain substring
    line = F.concat(F.lit("|"), F.replace(F.col("sentence_ids"), F.lit(","), F.lit("||")), F.lit("|"))
    out = out.withColumn("_line", F.when(F.col("n_sentences") > 0, line).otherwise(F.lit(""))).withColumn("_found", F.lit(""))
    for name, ids in (r for r in rules if len(r[1]) > 1):
        # a step a rule: the next one reads what this one left
        run = "".join(f"|{i}|" for i in ids)
        out = out.withColumn("_rest", F.replace(F.col("_line"), F.lit(run), F.lit("/")))
        times = F.floor((F.length("_line") - F.length("_rest")) / (len(run) - 1)).cast("int")
        out = out.withColumn("_found", F.concat("_found", F.repeat(F.lit(f"{name},"), times))).withColumn("_line", F.col("_rest")).drop("_rest")
    # rules of one sentence take nothing from each other: what is left is looked up, in the rules' order
    place = {ids[0]: i for i, (_, ids) in reversed([*enumerate(rules)]) if len(ids) == 1}
    places = F.create_map(*[F.lit(x) for i, k in place.items() for x in (i, k)])
    names = F.array(*[F.lit(name) for name, _ in rules])
    left = F.transform(F.regexp_extract_all("_line", F.lit(r"\|([^|/]+)\|"), F.lit(1)), lambda i: F.try_element_at(places, i))
    alone = F.transform(F.sort_array(F.array_compact(left)), lambda k: F.concat(F.get(names, k), F.lit(",")))
    out = out.withColumn("_found", F.concat("_found", F.array_join(alone, "")))
    return out.select(id_col, "n_sentences", "sentence_ids", F.rtrim(F.col("_found"), F.lit(",")).alias("licenses"))
