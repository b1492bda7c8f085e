"""Licence scans: known licence sentences, then ordered rules over their sequence. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of usual licence notices, normalised (lower case, runs of other characters than letters
# and digits are one blank), by sentence identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-notice": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
    ),
    "apache-use": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at",),
    "apache-basis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
    ),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions",
    ),
    "mit-condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-disclaimer": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
    ),
    "gpl3-notice": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ),
    "gpl-grant": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose",
    ),
    "gpl2-notice": ("licensed under the gnu general public license version 2",),
    "lgpl-notice": ("licensed under the gnu lesser general public license version 3",),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "cc-by-notice": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "cc-by-sa-notice": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
}

#: licence and the sentence identifiers that must follow each other; earlier rules take their sentences first
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-notice", "apache-use")),
    ("MIT", ("mit-grant", "mit-condition", "mit-disclaimer")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-grant",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("LGPL-3.0-only", ("lgpl-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
)

#: every known sentence holds one of these, so other texts need no splitting
HINTS = ("licen", "permission", "copyright", "warrant", "redistribut", "compliance", "subject to the terms")
#: between two words of a known sentence: blanks, line ends and stops alike
_GAP = r"[^a-z0-9]++"
#: in the gap before or behind a known sentence: a line end, or one of . ! ? ; : before a blank
_STOP = r"[^a-z0-9]*?(?:[\n\r]|[.!?;:][\x09-\x0D\x20])"


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def sentence_pattern() -> str:
    """Group 1: a known sentence that begins and ends at a stop, a line end or an end of the text.

    Stops and line ends inside of it do not matter: official notices have some ("free software: you can", "v. 2.0").
    """
    texts = sorted((t for texts in SENTENCES.values() for t in texts), key=lambda t: (-len(t), t))
    known = "|".join(t.replace(" ", _GAP) for t in texts)
    begin = rf"(?:^[^a-z0-9]*+|(?<=[a-z0-9])(?={_STOP})[^a-z0-9]++)"
    return rf"{begin}({known})(?=[^a-z0-9]*+\z|{_STOP})"


def recognised(c: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(sentence_pattern()), F.lit(1)), lambda s: F.try_element_at(known, normalised(s)))


def matched(ids: Column) -> Column:
    """Licences of the rules that match, in rule order, each once; a matched run of identifiers is used up."""
    rules = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(",," + ",,".join(s) + ",,").alias("run")) for n, s in RULES])
    start = F.struct(F.concat(F.lit(",,"), F.array_join(ids, ",,"), F.lit(",,")).alias("rest"), F.expr("cast(array() as array<string>)").alias("found"))

    def apply(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["run"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["run"], F.lit(",,|,,"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["licence"]))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(rules, start, apply, lambda acc: acc["found"])


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids (list, in order), licences (list, in rule order).

    A known sentence counts where it begins and ends at a stop, a line end or an end of the text, so it may run over line ends, and
    neither a notice nor the copyright line above a grant needs a full stop. Null, empty and other texts without a
    known sentence have empty lists. Repeated rows give repeated rows; other columns are ignored. One scan, no shuffle.
    """
    none = F.expr("cast(array() as array<string>)")
    hinted = F.coalesce(F.lower("text").rlike("|".join(HINTS)), F.lit(False))
    rows = docs.select("doc_id", F.when(hinted, recognised(F.col("text"))).otherwise(none).alias("sentence_ids"))
    return rows.withColumn("licences", F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))).otherwise(none))


def licence_sql() -> str:
    known = "MAP {" + ", ".join(f"'{t}': '{n}'" for n, texts in SENTENCES.items() for t in texts) + "}"
    hints = "|".join(map(re.escape, HINTS)).replace("\\ ", " ")
    pieces = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '[\x09-\x0D\x20]+', ' ', 'g'), '([.!?;:]) ', E'\\1\n', 'g'), E'\n'),
  lambda s: k.m[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL)"""
    rest, found = "',,' || array_to_string(ids, ',,') || ',,'", "[]::VARCHAR[]"
    steps = [f"r0 AS (SELECT doc_id, ids, {rest} AS rest, {found} AS found FROM i)"]
    for n, (name, run) in enumerate(RULES):
        mark = ",," + ",,".join(run) + ",,"
        steps.append(
            f"r{n + 1} AS (SELECT doc_id, ids, replace(rest, '{mark}', ',,|,,') AS rest, CASE WHEN contains(rest, '{mark}') AND NOT list_contains(found, '{name}') "
            f"THEN list_append(found, '{name}') ELSE found END AS found FROM r{n})"
        )
    return rf"""WITH k AS (SELECT {known} AS m),
w AS (SELECT doc_id, {pieces.format("coalesce(text, '')")} AS whole,
 flatten(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\n\r]+'), lambda x: regexp_matches(lower(x), '{hints}')), lambda l: {pieces.format("l")})) AS lined
 FROM documents, k),
i AS (SELECT doc_id, CASE WHEN len(lined) > len(whole) THEN lined ELSE whole END AS ids FROM w),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licences FROM r{len(RULES)}"""
