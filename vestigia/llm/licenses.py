"""Licence recognition by sentences: each sentence of a text, normalised, is looked up among known licence sentences; the
sequence of their identifiers is then matched against ordered rules. A rule takes the identifiers it matches out of the sequence,
so that a general rule does not fire on what a special one has explained. A known sentence is found alone, wrapped over lines and inside
comment blocks: comment leaders are dropped, and a line end may stand between any two of its words.

Everything happens inside the row; no shuffle. A text without any of the marker words has no known sentence and is not split for
the look-up.

Rows: null, empty and blank texts have no sentences. Rows that repeat an id are judged each by its own text. Texts are read whole; a
sentence found twice gives two identifiers, and each licence is named once. Other columns pass through `recognised`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.llm.common import lower_ascii, table

# Sentences of public licences (normalised before use) with the identifier of each.
SENTENCES = [
    ("ApacheRef", "Licensed under the Apache License, Version 2.0"),
    ("ApacheRef", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("ApacheRef", "Released under the Apache License, Version 2.0"),
    ("ApacheComply", "You may not use this file except in compliance with the License"),
    ("ApacheRefComply", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                        "with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MitRef", "Released under the MIT License"),
    ("MitRef", "Licensed under the MIT License"),
    ("MitRef", "This software is released under the MIT License"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                 "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
                 "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                  "Software"),
    ("MitAsIs", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("Gpl3Ref", "This work is licensed under the GNU General Public License, version 3"),
    ("Gpl3Ref", "Licensed under the GNU General Public License, version 3"),
    ("Gpl2Ref", "This work is licensed under the GNU General Public License, version 2"),
    ("Gpl2Ref", "Licensed under the GNU General Public License, version 2"),
    ("Gpl3Plus", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                 "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Gpl2Plus", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                 "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GplUseful", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                  "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GplSee", "See the GNU General Public License for more details"),
    ("LgplRef", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BsdPre", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
               "conditions are met:"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                   "derived from this software without specific prior written permission"),
    ("BsdRef", "Licensed under the BSD License"),
    ("MplRef", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CcByNcRef", "Licensed under CC BY-NC 4.0"),
    ("CcByNcSaRef", "Licensed under CC BY-NC-SA 4.0"),
    ("CcByNdRef", "Licensed under CC BY-ND 4.0"),
    ("CcBySaRef", "Licensed under CC BY-SA 4.0"),
    ("CcByRef", "Licensed under CC BY 4.0"),
    ("Cc0Ref", "Licensed under CC0 1.0"),
    ("AllRights", "All rights reserved"),
]
# Rules in order: identifiers end with a semicolon.
RULES = [
    ("Apache-2.0", "(ApacheRefComply;|ApacheRef;ApacheComply;)(ApacheCopy;)?(ApacheAsIs;)?(ApacheSee;)?"),
    ("GPL-3.0-or-later", "Gpl3Plus;(GplUseful;)?(GplSee;)?"),
    ("GPL-2.0-or-later", "Gpl2Plus;(GplUseful;)?(GplSee;)?"),
    ("BSD-3-Clause", "BsdPre;BsdSource;BsdBinary;BsdEndorse;"),
    ("BSD-2-Clause", "BsdPre;BsdSource;BsdBinary;"),
    ("MIT", "MitGrant;(MitNotice;)?(MitAsIs;)?"),
    ("Apache-2.0", "ApacheRef;"),
    ("MIT", "MitRef;"),
    ("GPL-3.0-only", "Gpl3Ref;"),
    ("GPL-2.0-only", "Gpl2Ref;"),
    ("LGPL-3.0-only", "LgplRef;"),
    ("BSD", "BsdRef;"),
    ("MPL-2.0", "MplRef;"),
    ("CC-BY-NC-SA-4.0", "CcByNcSaRef;"),
    ("CC-BY-NC-4.0", "CcByNcRef;"),
    ("CC-BY-ND-4.0", "CcByNdRef;"),
    ("CC-BY-SA-4.0", "CcBySaRef;"),
    ("CC-BY-4.0", "CcByRef;"),
    ("CC0-1.0", "Cc0Ref;"),
    ("Proprietary", "AllRights;"),
]
MARKERS = ["licens", "permission", "redistribut", "warrant", "copyright", "rights reserved"]
SENTENCE_END = r"[.!?]+(?:[ \t\r]+|$)|\n+"
# A line goes on in the next one if that begins in lower case, or both in upper case.
WRAPPED = [(r"([A-Za-z0-9,;:)\x22\x27])[ \t\r]*\n[ \t]*([a-z(\x22])", "{1} {2}"), (r"([A-Z,])[ \t\r]*\n[ \t]*([A-Z][A-Z])", "{1} {2}")]
# A line comment ends where a line without its mark begins.
LAST_COMMENT = r"((?:^|\n)[ \t]*+(?:#|//|;|--|%)[^\n]*+)(?=\n[ \t]*+[A-Za-z(])"
# What stands before and behind the text of a line in a comment.
LEADER = r"(^|\n)[ \t\r*/#;%!|>-]*+(?:(?:REM|rem|dnl)[ \t]++)?"
BORDER = r"(?<![ \t\r*/#|])[ \t\r*/#|]++(?=\n|(?![\s\S]))"
# Marks in the reduced text: a sentence ends at the first; at the second, a line end, it may end or go on.
END, LINE = "\x01", "\x02"
ENDS = r"(?<![.!?])[.!?]++(?![^ \t\r\n])|/\*|\*/|<!--|-->"
NOT_WORD = "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    """The same normal form as the expressions give, for the table."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).split())


def known_sentences() -> dict[str, str]:
    return {normalised(s): i for i, s in SENTENCES}


def _unwrapped(text: Column) -> Column:
    for pattern, with_ in WRAPPED:
        text = F.regexp_replace(text, pattern, with_.format(None, "$1", "$2"))
    return text


def _reduced(text: Column) -> Column:
    """Words of the text in lower case with marks for ends of sentences and lines, each with a blank on both sides."""
    apart = F.regexp_replace(F.translate(text, END + LINE, "  "), LAST_COMMENT, "$1\n")
    plain = F.regexp_replace(F.regexp_replace(apart, BORDER, ""), LEADER, "$1")
    marked = F.regexp_replace(F.regexp_replace(lower_ascii(_unwrapped(plain)), ENDS, f" {END} "), r"\n[ \t\r\n]*+", f" {LINE} ")
    return F.regexp_replace(F.concat(F.lit(f"{LINE} "), marked, F.lit(f" {LINE} ")), f"[^a-z0-9{END}{LINE}]+", " ")


def sentence_pattern() -> str:
    """The known sentences in a reduced text, the longer first. Lines may end between any two words; a dot before a blank is met only
    where the known sentence has one."""
    found = {}
    for _, sentence in SENTENCES:
        words = re.sub(f"[^a-z0-9{END}]+", " ", re.sub(ENDS, f" {END} ", sentence.lower())).strip(f" {END}").split(" ")
        found[f" (?:{LINE} )*+".join(f"{END}?" if w == END else w for w in words).replace(f"{END}? ", f"(?:{END} )?")] = len(words)
    return f"(?<=[{END}{LINE}] )(?:{'|'.join(sorted(found, key=lambda p: (-found[p], p)))})(?= [{END}{LINE}])"


def _identifiers(text: Column) -> Column:
    known = known_sentences()
    look_up = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    hits = F.regexp_extract_all(_reduced(text), F.lit(sentence_pattern()), F.lit(0))
    return F.transform(hits, lambda s: F.try_element_at(look_up, F.regexp_replace(s, NOT_WORD, " ")))


def recognised(docs: DataFrame) -> DataFrame:
    """`docs` with `sentence_ids` (an array), `licenses` (an array, in the order of the rules) and `n_unmatched` identifiers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = lower_ascii(text)
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    none = F.array().cast("array<string>")
    found = docs.withColumn("sentence_ids", F.when(marked, _identifiers(text)).otherwise(none))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])
    start = F.struct(F.concat(F.array_join("sentence_ids", ";"), F.lit(";")).alias("rest"), none.alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["rest"], rule["pattern"])
        return F.struct(F.when(hit, F.regexp_replace(acc["rest"], rule["pattern"], "")).otherwise(acc["rest"]).alias("rest"),
                        F.when(hit, F.array_union(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"))

    some = F.size("sentence_ids") > 0
    matched = F.when(some, F.aggregate(rules, start, apply)).otherwise(F.struct(F.lit("").alias("rest"), none.alias("names")))
    found = found.withColumn("_m", matched)
    return found.withColumns({
        "licenses": F.col("_m")["names"],
        "n_unmatched": F.size(F.filter(F.split(F.col("_m")["rest"], ";"), lambda x: x != "")).cast("long")}).drop("_m")


def op3_license_sentences(spark: SparkSession, folder: str) -> DataFrame:
    found = recognised(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ";").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"), "n_unmatched")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known_sentences().items())
    steps, last = [], "r0"
    for k, (name, pattern) in enumerate(RULES, 1):
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, regexp_replace(rest, {quote(pattern)}, '', 'g') AS rest, CASE WHEN regexp_matches(rest, "
            f"{quote(pattern)}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names "
            f"FROM {last})")
        last = f"r{k}"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = "text"
    for pattern, with_ in WRAPPED:
        text = f"regexp_replace({text}, '{pattern}', '{with_.format(None, chr(92) + '1', chr(92) + '2')}', 'g')"
    return f"""
WITH known(s, id) AS (VALUES {values}),
sent AS (SELECT doc_id, unnest(regexp_split_to_array({text}, '{SENTENCE_END}')) AS s,
  generate_subscripts(regexp_split_to_array({text}, '{SENTENCE_END}'), 1) AS k FROM documents),
ided AS (SELECT doc_id, k, id FROM (SELECT doc_id, k, trim(regexp_replace({lower.format('s')}, '{NOT_WORD}', ' ', 'g')) AS s FROM sent)
  JOIN known USING (s)),
g AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM ided GROUP BY doc_id),
r0 AS (SELECT doc_id, ids, array_to_string(ids, ';') || ';' AS rest, []::VARCHAR[] AS names FROM g),
{', '.join(steps)}
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ';'), '') AS sentence_ids,
  coalesce(array_to_string(names, ','), '') AS licenses, coalesce(len(list_filter(string_split(rest, ';'), lambda x: x <> '')), 0)::BIGINT
  AS n_unmatched
FROM documents d LEFT JOIN {last} USING (doc_id)
"""


ORACLE = _oracle()
