"""Licence scans by sentence rules: sentences to identifiers, identifier sequences to ordered licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (letters and digits, lower case).
SENTENCES = {
    1: "released under the mit license",
    2: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    3: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    4: "licensed under the apache license version 2 0",
    5: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    6: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    7: "this work is licensed under the gnu general public license version 3",
    8: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    9: "you should have received a copy of the gnu general public license along with this program",
    10: "licensed under cc by 4 0",
    11: "licensed under cc by nc 4 0",
    12: "licensed under cc by sa 4 0",
    13: "this work is licensed under a creative commons attribution 4 0 international license",
    14: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    15: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    16: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    17: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    18: "this source code form is subject to the terms of the mozilla public license v 2 0",
    19: "this is free and unencumbered software released into the public domain",
    20: "all rights reserved",
    21: "licensed under the apache license version 2",
}

#: Ordered rules (licence, identifiers in sequence): the first whose sequence occurs names the licence.
RULES = [
    ("BSD-3-Clause", (14, 15, 16, 17)),
    ("BSD-2-Clause", (14, 15, 16)),
    ("MIT", (2, 3)),
    ("Apache-2.0", (5, 6)),
    ("GPL-3.0-or-later", (8,)),
    ("GPL-3.0", (7,)),
    ("Apache-2.0", (4,)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (21,)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("CC-BY-NC-4.0", (11,)),
    ("CC-BY-SA-4.0", (12,)),
    ("CC-BY-4.0", (10,)),
    ("CC-BY-4.0", (13,)),
    ("MPL-2.0", (18,)),
    ("Unlicense", (19,)),
    ("All-Rights-Reserved", (20,)),
]


def _rule_cases(seq: str, value: str, contains: str, rules) -> str:
    whens = [f"WHEN {contains}({seq}, ',{','.join(map(str, ids))},') THEN " + (f"'{name}'" if value == "name" else str(k)) for k, (name, ids) in enumerate(rules, 1)]
    return f"CASE {' '.join(whens)} END"


#: Marks of a line end within a paragraph, and of the end of a sentence, in ``joined_lines``.
SOFT, HARD = "\x01", "\x02"


def joined_lines(text: Column, sentences: dict[int, str]) -> Column:
    """``text`` in normal form, sentences parted by ``HARD``: known ones also where they run over line ends.

    Every step goes once over the text. Blanks and signs are one blank before line ends are looked at, so
    a line of a comment mark only is blank.
    """
    marker = r"(\A|[.!?:;,\n][ \t*#/;\"')-]{0,8}\n)[ \t*#/;-]{0,16}\(?(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{2,5})[.)](?=[ \t])"
    known = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(sentences.values(), key=len, reverse=True))
    steps = [
        (f"[{SOFT}{HARD}]", " "),
        (r"\r\n?", "\n"),
        (marker, f"$1{HARD}"),
        (r"\b([vV])\.[ \t\n]+(?=[0-9])", "$1 "),
        (r"[.!?]+(?:[ \t\n]|\z)", HARD),
        (r"\n[ \t*#/;-]{0,16}\n(?=[ \t*#/;-]{0,16}https?://[^ \t\n]+[ \t]*(?:\n|\z))", "\n"),
        (f"[^A-Za-z0-9\n{HARD}]+", " "),
        (r"\n(?: ?\n)+", HARD),
        (f"[ \n]*{HARD}[ \n{HARD}]*", HARD),
        (r" ?\n ?", SOFT),
    ]
    for pattern, to in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    parted = F.regexp_replace(F.lower(text), F.lit(f"(?<=^|[{SOFT}{HARD}]) ?({known}) ?(?=$|[{SOFT}{HARD}])"), F.lit(f"{HARD}$1{HARD}"))
    return F.translate(parted, SOFT, " ")


def scan_licenses(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text", wrapped: bool = False) -> DataFrame:
    """``doc_id, n_sentences, n_license_sentences, sequence, rule, license`` of every whole text.

    A sentence ends at a line end, or at ``.!?`` before white space or the end of the text. ``sequence``
    lists the identifiers in order, a run of unknown sentences as one 0, so a rule matches sentences that
    follow one another. ``rule`` counts the rules from 1; it and ``license`` are null where none matches.
    A null or empty text has no sentences. Rows are judged one by one: ties, repeated rows and null ids
    change nothing, an empty table gives no rows, other columns are ignored.

    ``wrapped`` reads texts as they are published: a line end within a paragraph ends no sentence, unless
    the line or lines beside it are a known sentence whole; blank lines do, but not before a line that is an
    address only. Markers such as ``1.`` or ``(a)`` at the head of an item, and the dot of ``v. 2``, count
    for nothing.
    """
    text = f"coalesce(`{text_col}`, '')"
    ends = rf"regexp_replace({text}, '[.!?]+([ \\t\\r\\n]|\\z)', '\n')"
    plain = rf"transform(split({ends}, '\\n'), x -> trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' '))))"
    if wrapped:
        docs = docs.select(id_col, joined_lines(F.expr(text), sentences).alias("__joined"))
        plain = f"transform(split(__joined, '{HARD}'), x -> trim(x))"
    table = ", ".join(f"'{s}', {k}" for k, s in sentences.items())
    known = f"transform(filter({plain}, x -> x <> ''), x -> coalesce(map({table})[x], 0))"
    kept = "filter(k, (x, i) -> x <> 0 OR coalesce(get(k, i - 1), 1) <> 0)"
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"element_at(transform(array({known}), k -> named_struct('n', cast(size(k) as bigint), 'known', cast(size(filter(k, x -> x <> 0)) as bigint), 's', concat(',', array_join({kept}, ','), ','))), 1)").alias("f"))
    flat = found.select("doc_id", F.col("f.n").alias("n_sentences"), F.col("f.known").alias("n_license_sentences"), F.col("f.s").alias("sequence"))
    return flat.withColumns({"rule": F.expr(_rule_cases("sequence", "rule", "contains", rules)).cast("long"), "license": F.expr(_rule_cases("sequence", "name", "contains", rules))})


#: The same in DuckDB.
ORACLE = rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[.!?]+([ \t\r\n]|\z)', chr(10), 'g'), chr(10)),
           lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))), lambda x: x <> '') AS s FROM documents),
k AS (SELECT doc_id, list_transform(s, lambda x: CASE x {" ".join(f"WHEN '{s}' THEN {k}" for k, s in SENTENCES.items())} ELSE 0 END) AS k FROM s),
q AS (SELECT doc_id, CAST(len(k) AS BIGINT) AS n_sentences, CAST(len(list_filter(k, lambda x: x <> 0)) AS BIGINT) AS n_license_sentences,
      ',' || coalesce(array_to_string(list_filter(k, lambda x, i: x <> 0 OR i = 1 OR k[i - 1] <> 0), ','), '') || ',' AS sequence FROM k)
SELECT *, CAST({_rule_cases("sequence", "rule", "contains", RULES)} AS BIGINT) AS rule, {_rule_cases("sequence", "name", "contains", RULES)} AS license FROM q
"""
