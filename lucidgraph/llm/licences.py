"""Licence scans with DataFrame functions only: Dice coefficient of word bigrams between normalised text and templates."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.shared import table

# Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case; every run of other characters than a-z and 0-9 one space; a space at either end."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), F.lit(" "))


def template_words(text: str) -> list[str]:
    lower = "".join(c.lower() if c in _UPPER else c for c in text)
    return "".join(c if c in _LOWER or c in "0123456789" else " " for c in lower).split()


class Template:
    """A template's distinct bigrams, the size bounds for a Dice coefficient of ``least`` and the bigrams to look for.

    Dice >= least bounds a window's number of bigrams from both sides, and so the number of shared bigrams from below
    (``overlap``). Whatever the window, it then has one of any ``len(bigrams) - overlap + 1`` bigrams of the
    template; the longest ones are looked for (``needles``), being rare in prose.
    """

    def __init__(self, name: str, text: str, least: float):
        self.name, own = name, template_words(text)
        if len(own) < 2:
            raise ValueError(f"template {name!r} has fewer than two words")
        self.words = len(own)
        self.bigrams = sorted({f"{a} {b}" for a, b in zip(own, own[1:])})
        n = len(self.bigrams)
        self.smallest, self.largest = math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)
        self.overlap = math.ceil(least * (n + self.smallest) / 2 - 1e-9)
        self.needles = sorted(self.bigrams, key=lambda b: (-len(b), b))[: n - self.overlap + 1]


def _best(t: Template, pairs: str) -> str:
    """SQL for the largest Dice coefficient of a window of at most t.words words that starts at a bigram of ``t``."""
    own = "array(" + ", ".join(f"'{b}'" for b in t.bigrams) + ")"
    window = f"array_distinct(slice(p, i + 1, {t.words - 1}))"
    dice = f"element_at(transform(array({window}), w -> if(size(w) BETWEEN {t.smallest} AND {t.largest}, 2D * size(array_intersect(w, {own})) / ({len(t.bigrams)} + size(w)), 0D)), 1)"
    starts = f"filter(transform(p, (x, i) -> if(array_contains({own}, x), i, -1)), i -> i >= 0)"
    return f"element_at(transform(array({pairs}), p -> coalesce(array_max(transform({starts}, i -> {dice})), 0D)), 1)"


def find_licences(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without the text, plus ``n_words`` and ``licences``: array of (dice, name), best first.

    A document has a template if a window of it - as many words as the template has, fewer at the end of the text,
    starting at one of the template's bigrams - reaches a Dice coefficient of ``least`` over distinct bigrams. The
    whole text is looked at. Null and empty texts have no words and no licence. Ties come by name. Repeated rows are
    judged each; an empty table gives an empty result. No shuffle.
    """
    base = docs.drop(*[c for c in ("n_words", "licences", "_norm") if c != text])
    rows = base.withColumn("_norm", normalised(F.col(text))).drop(text)
    # btrim and a space at either end: n words have n + 1 spaces, and an empty text has two
    spaces = F.length("_norm") - F.length(F.translate("_norm", " ", ""))
    rows = rows.withColumn("n_words", F.when(F.length("_norm") <= 2, F.lit(0)).otherwise(spaces - 1).cast("long"))
    pairs = "element_at(transform(array(split(btrim(_norm), ' ')), w -> transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat_ws(' ', x, w[i + 1]))), 1)"
    found = []
    for t in (Template(name, body, least) for name, body in sorted(templates.items())):
        gate = " OR ".join(f"contains(_norm, ' {n} ')" for n in t.needles)
        found.append(f"if(n_words > {t.smallest} AND ({gate}), {_best(t, pairs)}, 0D)")
    named = ", ".join(f"named_struct('dice', {f}, 'name', '{name}')" for f, name in zip(found, sorted(templates)))
    # struct order is ascending: the coefficient is negated for the sort
    best = f"transform(sort_array(transform(filter(array({named}), x -> x.dice >= {least - 1e-9}), x -> named_struct('less', -x.dice, 'name', x.name))), x -> named_struct('dice', -x.less, 'name', x.name))"
    return rows.withColumn("licences", F.expr(best)).drop("_norm")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.get("licences", F.lit(0))["name"].alias("licence"),
        F.round(F.get("licences", F.lit(0))["dice"], 6).alias("dice"),
        F.array_join(F.transform("licences", lambda x: x["name"]), ",").alias("licences"),
    )


def _sql(least: float = 0.8) -> str:
    rows = ", ".join(f"('{t.name}', {t.words}, {t.smallest}, {t.largest}, [{', '.join(repr(b) for b in t.bigrams)}])" for t in (Template(k, v, least) for k, v in sorted(TEMPLATES.items())))
    return rf"""
WITH t(name, words, smallest, largest, own) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, len(w) AS n_words, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM d),
b AS (SELECT DISTINCT unnest(own) AS bigram FROM t),
s AS (SELECT rid, p, i, p[i] AS bigram FROM (SELECT rid, p, unnest(range(1, len(p) + 1)) AS i FROM p) WHERE p[i] IN (SELECT bigram FROM b)),
c AS (SELECT s.rid, t.name, 2 * len(list_intersect(list_distinct(s.p[s.i:s.i + t.words - 2]), t.own)) / (len(t.own) + len(list_distinct(s.p[s.i:s.i + t.words - 2])))::DOUBLE AS dice,
             len(list_distinct(s.p[s.i:s.i + t.words - 2])) BETWEEN t.smallest AND t.largest AS fits
      FROM s JOIN t ON list_contains(t.own, s.bigram)),
m AS (SELECT rid, name, max(dice) AS dice FROM c WHERE fits GROUP BY rid, name HAVING max(dice) >= {least} - 1e-9),
a AS (SELECT rid, arg_min(name, (-dice, name)) AS licence, max(dice) AS dice, string_agg(name, ',' ORDER BY dice DESC, name) AS licences FROM m GROUP BY rid)
SELECT doc_id, n_words, licence, round(dice, 6) AS dice, coalesce(licences, '') AS licences FROM p LEFT JOIN a USING (rid)
"""


OP7_SQL = _sql()
