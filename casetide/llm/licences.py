"""Licence scans in DataFrame operations alone: Dice coefficients of word bigrams against templates.

The units of a text are its lines, its paragraphs (between blank lines) and the text as a whole. Units and templates
are normalised alike: ASCII letters folded, everything but letters and digits of ASCII as one space. A unit carries
a licence when twice the number of distinct word bigrams it shares with one of the licence's templates is at least
``THRESHOLD`` of the two sizes' sum.

Two exact prunings come first. A unit below that bound with a template must hold more than THRESHOLD / (2 - THRESHOLD)
of its bigrams, so one without any of the template's anchor words (chosen so that bigrams with an anchor are more
than the rest allowed to miss) can't match: most texts end at one regular expression. And a template is compared only
if the unit's size lies between THRESHOLD / (2 - THRESHOLD) and its inverse times the template's.

Everything is one map over the rows: no shuffle, no skew. Null and empty texts, and units of fewer than two words,
carry no licence (nulls in the result). Repeated rows give a row each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by licence (fixed values: the customary wording of each).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words too common to be anchors.
COMMON = frozenset("a an and any as at be by for from in is it of on or that the this to under with you".split())


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchors(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words without which no unit reaches ``threshold`` with any template: bigrams that hold one are too many to miss."""
    chosen: set[str] = set()
    for _, text in templates:
        words = template_words(text)
        bigrams = _bigrams(words)
        n = len(bigrams)
        covered = lambda w, b=bigrams: sum(bool(w & set(x.split())) for x in b)
        while 2 * (n - covered(chosen)) / (2 * n - covered(chosen)) >= threshold - 1e-12:  # what a unit without them could reach
            rest = sorted(set(words) - chosen, key=lambda w, c=covered: (w in COMMON, w.isdigit(), -c({w}), -len(w), w))
            chosen.add(rest[0])
    return sorted(chosen)


def _word_pattern(words: list[str]) -> str:
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _distinct_bigrams(words: Column) -> Column:
    pair = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair))


def _matches(bigrams: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Structs (dice, licence) of the templates that a unit with these distinct bigrams reaches."""
    literal = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams"))
        for name, b in ((name, _bigrams(template_words(text))) for name, text in templates)
    ])
    ratio, size = threshold / (2 - threshold), F.size(bigrams)
    near = F.filter(literal, lambda t: (size >= t["size"] * ratio) & (size * ratio <= t["size"]))
    scored = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(bigrams, t["bigrams"])) * 2.0 / (size + t["size"])).alias("dice"), t["name"].alias("licence")))
    return F.filter(scored, lambda m: m["dice"] >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, licence and dice of the best match, licences (all, ``;`` between), or nulls."""
    text = F.col("text")
    pattern = _word_pattern(anchors(templates, threshold))
    units = F.concat(F.split(text, r"\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text))
    held = F.array_distinct(F.transform(F.filter(units, lambda u: u.rlike(pattern)), normalised))
    words = F.filter(F.transform(held, lambda u: F.split(u, " ")), lambda w: F.size(w) >= 2)
    # each transform hands the next a value, so that none is computed again inside a lambda
    matches = F.flatten(F.transform(F.transform(words, _distinct_bigrams), lambda b: _matches(b, templates, threshold)))
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    found = rows.select(id_col, F.when(text.rlike(pattern), matches).alias("matches"))
    best = F.array_max("matches")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ";")
    return found.select(id_col, best["licence"].alias("licence"), F.round(best["dice"], 6).alias("dice"), F.nullif(names, F.lit("")).alias("licences"))


def oracle_sql() -> str:
    """Brute force in DuckDB: every unit against every template, without pruning."""
    values = ",\n".join("('%s', '%s')" % (name, " ".join(template_words(text))) for name, text in TEMPLATES)
    return f"""
WITH t AS (SELECT name, string_split(words, ' ') AS w FROM (VALUES {values}) v(name, words)),
tb AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM t),
u AS (SELECT DISTINCT doc_id, trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS unit
      FROM (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS unit FROM documents)),
w AS (SELECT doc_id, string_split(unit, ' ') AS w FROM u),
ub AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, name, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS dice FROM ub CROSS JOIN tb),
g AS (SELECT doc_id, max({{'dice': dice, 'licence': name}}) AS best, string_agg(DISTINCT name, ';' ORDER BY name) AS licences
      FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT d.doc_id, g.best.licence AS licence, round(g.best.dice, 6) AS dice, g.licences FROM documents d LEFT JOIN g USING (doc_id)
"""
