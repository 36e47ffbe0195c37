"""Licence scan by sentences and ordered rules (operator 8).

A text is normalised (ASCII lower case, letters and digits, single spaces) with
its breaks kept: ends of sentences and line feeds. Known licence sentences are
found where they begin and end at a break; within them any break may stand for a
space, so that wrapped and indented texts and comments match too. The identifiers found, in order, are then matched against licence
rules: the first rule whose run of identifiers occurs claims them, and later
rules see what is left. Only DataFrame functions are used; nothing shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, in normalised form.
SENTENCES: dict[str, str] = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-you-may": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-licensed": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-licensed": "licensed under the gnu lesser general public license version 3",
    "agpl-licensed": "licensed under the gnu affero general public license version 3",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}
#: Licence rules in the order in which they are tried.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-header", "apache-you-may", "apache-obtain", "apache-law", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-2.0-only", ("gpl2-licensed",)),
    ("LGPL-3.0-only", ("lgpl-licensed",)),
    ("AGPL-3.0-only", ("agpl-licensed",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-all-rights-reserved", ("all-rights",)),
)
#: Identifiers that a tag "SPDX-License-Identifier" may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx-{x}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()) for x in SPDX}
RULES += tuple((x, (f"spdx-{x}",)) for x in SPDX)
#: Every known sentence holds one of these, so texts without any need no cutting.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "rights", "free software", "unencumbered", "without any", "in no event")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
_END = rf"([.!?;:]){SPACE}+"


def normalise(sentence: str) -> str:
    """The form in which sentences are compared."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()


def _pattern(sentences: dict[str, str]) -> str:
    """Known sentences between two breaks, the longest first."""
    longest = sorted(sentences.values(), key=len, reverse=True)
    return r"(?<=\n)(?:" + "|".join(x.replace(" ", r"[ \n]") for x in longest) + r")(?=\n)"


def license_rules(
    docs: DataFrame,
    text: str = "text",
    out: str = "licence",
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
    hints: tuple[str, ...] = HINTS,
) -> DataFrame:
    """``docs`` with a struct column ``out``: ``sequence`` (identifiers of the known
    sentences, in order), ``matched`` (licences of the rules that match, in rule
    order) and ``left`` (identifiers that no rule claims).

    A sentence begins and ends at ``. ! ? ; :`` before white space, at a line
    feed, or at an end of the text, and may itself hold such breaks; of those
    that begin at one place the longest counts, and none overlap. Signs before
    a line's first letter or digit (comment leaders) count as white space.
    Unknown sentences between known ones do not break a rule's run. A rule
    claims every place where it occurs.

    NULL and empty texts give empty arrays. A column already named ``out`` is
    replaced; all other columns and repeated rows stay as they are. The tables
    of sentences and rules are constants of the plan, their size is fixed.
    """
    for name, sentence in sentences.items():
        if sentence != normalise(sentence) or not any(h in sentence for h in hints):
            raise ValueError(f"sentence {name} is not in normal form or has none of the hints")
    known = F.create_map(*[F.lit(x) for k, v in sentences.items() for x in (v, k)])
    lowered = F.translate(F.col(text), UPPER, LOWER)
    broken = F.regexp_replace(F.regexp_replace(lowered, _END, "\n"), r"[^a-z0-9\n]+", " ")
    broken = F.regexp_replace(F.concat(F.lit("\n"), broken, F.lit("\n")), r" ?\n[ \n]*", "\n")
    found = F.regexp_extract_all(broken, F.lit(_pattern(sentences)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    # "free software" etc. may be broken over white space in the text, so hints are looked for word by word
    maybe = lowered.rlike("|".join(sorted({h.split(" ")[0] if " " in h else h for h in hints})))
    none = F.array().cast("array<string>")
    sequence = F.when(maybe, ids).otherwise(none)
    marked = F.concat(F.lit(""), F.array_join(F.transform("__ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{x}>" for x in run)).alias("run")) for n, run in rules])
    start = F.struct(marked.alias("left"), none.alias("matched"))

    def step(state, rule):
        hit = F.contains(state["left"], rule["run"])
        left = F.when(hit, F.replace(state["left"], rule["run"], F.lit("|"))).otherwise(state["left"])
        found = F.when(hit, F.concat(state["matched"], F.array(rule["name"]))).otherwise(state["matched"])
        return F.struct(left.alias("left"), found.alias("matched"))

    empty = F.struct(F.lit("").alias("left"), none.alias("matched"))
    state = F.when(F.size("__ids") > 0, F.aggregate(table, start, step)).otherwise(empty)
    left = F.filter(F.split(F.regexp_replace(F.col("__state.left"), r"\||^<|>$", ""), "><|<|>"), lambda x: x != "")
    found = docs.withColumn("__ids", sequence).withColumn("__state", state)
    result = F.struct(
        F.col("__ids").alias("sequence"), F.array_distinct("__state.matched").alias("matched"), left.alias("left")
    )
    return found.withColumn(out, result).drop("__ids", "__state")


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(v)}: {quoted(k)}" for k, v in SENTENCES.items()) + "}"
    steps, hits = [], []
    for i, (name, run) in enumerate(RULES):
        pattern = quoted("".join(f"<{x}>" for x in run))
        steps.append(
            f"s{i} AS (SELECT *, contains(left_{i}, {pattern}) AS hit_{i}, replace(left_{i}, {pattern}, '|') AS left_{i + 1} "
            f"FROM {f's{i - 1}' if i else 'marked'})"
        )
        same = [f"coalesce(hit_{k}, false)" for k in range(i) if RULES[k][0] == name]
        hits.append(f"CASE WHEN hit_{i} AND NOT ({' OR '.join(same) or 'false'}) THEN {quoted(name)} END")
    # each break is doubled, so that neighbouring sentences have one each
    pattern = "\\n(?:" + "|".join(x.replace(" ", "(?: |\\n\\n)") for x in sorted(SENTENCES.values(), key=len, reverse=True)) + ")\\n"
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_replace(chr(10) || regexp_replace(regexp_replace(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_END}', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g') || chr(10),
    ' ?\\n[ \\n]*', chr(10) || chr(10), 'g') AS broken
  FROM documents),
ids AS (
  SELECT doc_id, list_transform(regexp_extract_all(broken, '{pattern}', 0), lambda s: {known}[trim(replace(replace(s, chr(10) || chr(10), ' '), chr(10), ' '))]) AS ids
  FROM cut),
marked AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS left_0 FROM ids),
{', '.join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ' '), '') AS sequence, concat_ws(' ', {', '.join(hits)}) AS licences
FROM s{len(RULES) - 1}"""
