"""Operator 9, licence scans by sentence rules.

A text is normalised once: words, and between them line ends and sentence ends. A known sentence is found where it begins and ends at
either, the longest first; line ends may lie between its words (wrapped notices), sentence ends only where its own spelling has
one ('GNU; without'). So notices on lines of their own and wrapped ones are found side by side, in the order of the text. The sequence of their
identifiers is matched against ordered rules, each of which takes its identifiers out of the sequence. All of it
happens inside a row, as column functions: no shuffle and no group.

Nulls: a null or empty text has no sentence and no result row; a null doc_id keeps its row. Repeated rows give repeated results. Sentences and lines
that speak of a licence and are no part of a known sentence are counted. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPHS = r"[.!?;:]+(?:[ \t\n\r]|\z)|\n[ \t\r]*\n"
MENTION = r"(^| )licen[sc](e|es|ed|ing)( |$)"

#: Sentences of public licence texts and notices, normalised, with their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "spdx license identifier mit": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "spdx license identifier apache 2 0": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "spdx license identifier gpl 3 0 or later": "gpl3-notice",
    "spdx license identifier gpl 2 0 only": "gpl2-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "licensed under the mozilla public license version 2 0": "mpl2-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under cc by 4 0": "cc-by4",
    "licensed under cc by sa 4 0": "cc-by-sa4",
    "licensed under cc by nc 4 0": "cc-by-nc4",
    "licensed under cc by nd 4 0": "cc-by-nd4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4",
    "to the extent possible under law the author has waived all copyright and related rights to this work": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

#: How the known sentences with a sentence end inside are spelled.
SPELLED = {
    "spdx license identifier mit": "SPDX-License-Identifier: MIT",
    "spdx license identifier apache 2 0": "SPDX-License-Identifier: Apache-2.0",
    "spdx license identifier gpl 3 0 or later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx license identifier gpl 2 0 only": "SPDX-License-Identifier: GPL-2.0-only",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: What is looked up: 'or later' is not 'only'.
KNOWN = SENTENCES | {"spdx license identifier gpl 3 0 or later": "gpl3-grant"}
#: Stands for a sentence end in a normalised text.
END = "\u0001"

#: (licence, identifiers in a row), most specific first; a rule takes its identifiers away from those below it.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gnu-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gnu-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl3-notice",)),
    ("AGPL-3.0-only", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
)


def _pattern(identifiers) -> str:
    return "".join(f",{x}," for x in identifiers)


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip()


def normalised(text: Column) -> Column:
    """Words in lower case; between them blanks, line ends, and END where a sentence ends."""
    ended = F.regexp_replace(F.translate(text, UPPER + END, LOWER + " "), PARAGRAPHS, END)
    return F.regexp_replace(ended, f"[^a-z0-9\n{END}]+", " ")


def spellings(known) -> str:
    """One pattern for the sentences of `known` in a normalised text, the longest first."""
    found = set()
    for s in known:
        parts = [plain(x).split() for x in re.split(PARAGRAPHS.replace(r"\z", r"\Z"), SPELLED.get(s, s))]
        found.add(f"[ \n{END}]+".join("[ \n]+".join(x) for x in parts if x))
    return "|".join(sorted(found - {""}, key=lambda x: (-len(x), x)))


def pattern(known) -> str:
    """Finds the sentences of `known` from one end of a sentence or line to another."""
    return f"(?<![^\n{END}]) ?(?:{spellings(known)})(?= ?(?:[\n{END}]|\\z))"


def hint(known) -> str:
    """A pattern found in every text that has a sentence of `known` or speaks of a licence: a word of each sentence, as few words as do."""
    left, words = [set(s.split()) for s in known if s and not re.search("licen[sc]", s)], []
    while left:
        # a long word, which ordinary texts hold least, of as many sentences as there is one
        words.append(max(sorted(set.union(*left)), key=lambda w: (len(w) > 7, sum(w in s for s in left), len(w))))
        left = [s for s in left if words[-1] not in s]
    return "(?i)" + "|".join(["licen[sc]", *words])


def scan(docs: DataFrame, known=None, rules=RULES) -> DataFrame:
    """doc_id, licenses, sentences (identifiers in their order) and n_unknown of every document that names a licence. `known`: identifiers of sentences as they are spelled."""
    known = known or KNOWN
    names = {plain(s): i for s, i in known.items()}
    find, wanted = pattern(known), F.col("text").rlike(hint(names))
    names = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = docs.where(wanted).select("doc_id", normalised(F.col("text")).alias("plain"))
    found = F.transform(F.regexp_extract_all("plain", F.lit(find), F.lit(0)), lambda s: F.try_element_at(names, F.trim(F.regexp_replace(s, f"[ \n{END}]+", " "))))
    unknown = F.size(F.filter(F.split(F.regexp_replace("plain", find, ""), f"[\n{END}]"), lambda s: s.rlike(MENTION)))
    rows = rows.select("doc_id", unknown.cast("long").alias("n_unknown"), found.alias("ids"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_pattern(p)).alias("pattern")) for n, p in rules])
    begin = F.struct(F.when(F.size("ids") > 0, F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))).otherwise("").alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(state, rule):
        return F.struct(F.replace(state["rest"], rule["pattern"], F.lit("")).alias("rest"),
                        F.when(F.contains(state["rest"], rule["pattern"]), F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    matched = F.aggregate(table, begin, apply, lambda state: F.array_distinct(state["names"]))
    return rows.where((F.size("ids") > 0) | (F.col("n_unknown") > 0)).select(
        "doc_id", F.array_join(matched, ";").alias("licenses"), F.array_join("ids", ";").alias("sentences"), "n_unknown")


def _sql() -> str:
    """DuckDB has no look-around: every line and sentence end is doubled, so that two sentences side by side have an end each."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in KNOWN.items()) + "}"
    end, ends = "' || chr(1) || '", "[\\n\\x01]"
    find = f"{ends} ?(?:{spellings(KNOWN)}) ?{ends}".replace(END, "\\x01").replace("\n", "\\n")
    steps = "SELECT doc_id, n_unknown, ids, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',,') || ',' ELSE '' END AS rest, []::VARCHAR[] AS names FROM named"
    for name, p in RULES:
        p = _pattern(p)
        steps = (f"SELECT doc_id, n_unknown, ids, replace(rest, '{p}', '') AS rest, CASE WHEN contains(rest, '{p}') AND NOT list_contains(names, '{name}') "
                 f"THEN list_append(names, '{name}') ELSE names END AS names FROM ({steps})")
    return f"""
WITH ended AS (SELECT doc_id, regexp_replace(replace(translate(text, '{UPPER}', '{LOWER}'), chr(1), ' '), '{PARAGRAPHS}', chr(1), 'g') AS t FROM documents),
doubled AS (SELECT doc_id, chr(1) || regexp_replace(regexp_replace(t, '[^a-z0-9\\n\\x01]+', ' ', 'g'), '({ends})', '\\1\\1', 'g') || chr(1) AS t FROM ended),
named AS (
  SELECT doc_id, list_transform(regexp_extract_all(t, '{find}'), lambda s: {known}[trim(regexp_replace(s, '[ \\n\\x01]+', ' ', 'g'))]) AS ids,
         len(list_filter(string_split_regex(regexp_replace(t, '{find}', '{end}', 'g'), '{ends}'), lambda s: regexp_matches(s, '{MENTION}')))::BIGINT AS n_unknown FROM doubled)
SELECT doc_id, array_to_string(names, ';') AS licenses, array_to_string(ids, ';') AS sentences, n_unknown FROM ({steps}) WHERE len(ids) > 0 OR n_unknown > 0"""


SQL = _sql()
