"""Licence notices in texts, by Dice's coefficient over word bigrams of lines and of runs of words.

DataFrame functions only. A line is lower-cased, everything but a-z and 0-9 becomes
one space, and its distinct word bigrams are compared with those of each template.
So are those of runs of words anywhere in the text, across line breaks and within
lines, that begin and end with a bigram of the template (any other run has a better
one within it) and have at most (2 - d) / d times as many bigrams. Lines that match a
licence as a whole are left out of its runs, and of runs that overlap the best counts.
Two bounds spare comparisons without losing a match at the threshold d: the sizes
must lie within d / (2 - d) of each other, and since a match shares at least
d / (2 - d) of a template's bigrams, a line must hold one of any
n - ceil(n d / (2 - d)) + 1 of them; the longest are tried first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Wording of common licence notices.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "all-rights-reserved": ["All rights reserved."],
}


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of each template."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            w = plain_words(text)
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def clue(rows: list[tuple[str, list[str]]], dice: float = DICE) -> str:
    """Pattern of bigrams of which a line that reaches `dice` with any template holds one."""
    wanted: set[str] = set()
    for _, bigrams in rows:
        need = math.ceil(len(bigrams) * dice / (2 - dice) - 1e-9)
        wanted |= set(sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - need + 1])
    return r"\b(?:" + "|".join(sorted(wanted)) + r")\b"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _runs(pairs: Column, hits: Column, rows: list[tuple[str, list[str]]], dice: float) -> Column:
    """Best runs of words per licence: license, dice and the line where each begins, as in `hits`.

    `pairs` holds the bigrams of a text (b) and the lines of their two words (first, last).
    """
    known = F.array(*(
        F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(math.ceil(len(b) * dice / (2 - dice) - 1e-9)).alias("need"), F.lit(math.floor(len(b) * (2 - dice) / dice + 1e-9)).alias("most"))
        for n, b in rows
    ))
    every = F.array(*(F.lit(b) for b in sorted({b for _, bigrams in rows for b in bigrams})))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["b"].alias("b"), p["first"].alias("first"), p["last"].alias("last")))
    near = F.filter(placed, lambda p: F.array_contains(every, p["b"]))

    def best(near: Column, t: Column) -> Column:
        settled = F.transform(F.filter(hits, lambda h: h["license"] == t["license"]), lambda h: h["line"])
        own = F.filter(near, lambda p: F.array_contains(t["bigrams"], p["b"]) & ~F.array_contains(settled, p["first"]) & ~F.array_contains(settled, p["last"]))

        def scored(p: Column, q: Column) -> Column:
            run = F.array_distinct(F.transform(F.slice(pairs, p["at"] + 1, q["at"] - p["at"] + 1), lambda x: x["b"]))
            share = lambda r: F.lit(2.0) * F.size(F.array_intersect(r, t["bigrams"])) / (F.size(r) + F.size(t["bigrams"]))
            return F.struct((-_let(run, share)).alias("less"), p["at"].alias("start"), (q["at"] + 2).alias("end"), p["first"].alias("line"), t["license"].alias("license"))

        def begun(own: Column) -> Column:
            ends = lambda p, i: F.filter(F.slice(own, i + t["need"], t["most"]), lambda q: (q["at"] - p["at"] < t["most"]) & ~F.exists(settled, lambda m: m.between(p["first"], q["last"])))
            found = F.flatten(F.transform(own, lambda p, i: F.transform(ends(p, i), lambda q: scored(p, q))))
            return F.filter(found, lambda r: r["less"] <= -dice)

        return _let(own, begun)

    none = F.array().cast("array<struct<less:double,start:int,end:int,line:int,license:string>>")
    found = _let(near, lambda near: F.array_sort(F.flatten(F.transform(known, lambda t: best(near, t)))))

    def step(kept: Column, r: Column) -> Column:
        met = F.exists(kept, lambda k: (k["license"] == r["license"]) & (k["start"] < r["end"]) & (r["start"] < k["end"]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(r)))

    return F.transform(F.aggregate(found, none, step), lambda r: F.struct(r["license"].alias("license"), (-r["less"]).alias("dice"), r["line"].alias("line")))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))


def license_matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row per row of `docs` and licence: doc_id, license, dice, n_lines, first_line.

    `docs` needs doc_id and text; other columns are ignored. dice is the best of the
    lines and runs of words that reach the threshold, n_lines the number of lines that
    match or in which a matching run begins, and first_line the first one's number,
    from 0. Null and blank texts, and texts of fewer than two words, match nothing.
    Repeated rows give repeated results.
    """
    rows = template_rows(templates)
    known = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in rows))
    bound = dice / (2 - dice)
    text, wanted = F.col("text").cast("string"), clue(rows, dice)
    held = docs.where(normalised(text).rlike(wanted)).select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split(text, "\n", -1), normalised).alias("plain"))

    def bigrams(plain: Column) -> Column:
        w = F.split(plain, " ")
        return F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))

    def compared(x: Column) -> Column:
        size = F.size(x["bigrams"])
        near = F.filter(known, lambda t: (size >= F.size(t["bigrams"]) * bound) & (F.size(t["bigrams"]) >= size * bound))
        share = lambda t: F.lit(2.0) * F.size(F.array_intersect(x["bigrams"], t["bigrams"])) / (size + F.size(t["bigrams"]))
        scored = F.transform(near, lambda t: F.struct(t["license"].alias("license"), share(t).alias("dice"), x["line"].alias("line")))
        return F.filter(scored, lambda s: s["dice"] >= dice)

    lines = F.filter(F.transform("plain", lambda x, i: F.struct(i.alias("line"), x.alias("plain"))), lambda x: x["plain"].rlike(wanted))
    words = F.flatten(F.transform("plain", lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    held = held.select("doc_id", F.transform(lines, lambda x: F.struct(x["line"].alias("line"), bigrams(x["plain"]).alias("bigrams"))).alias("lines"), words.alias("words"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, rest), F.slice("words", 2, rest), lambda a, b: F.struct(F.concat_ws(" ", a["w"], b["w"]).alias("b"), a["line"].alias("first"), b["line"].alias("last")))
    both = _let(pairs, lambda p: _let(F.flatten(F.transform("lines", compared)), lambda h: F.concat(h, _runs(p, h, rows, dice))))
    held = held.select("doc_id", both.alias("hits")).where(F.size("hits") > 0)

    def told(name: Column) -> Column:
        own = F.filter("hits", lambda h: h["license"] == name)
        return F.struct(
            name.alias("license"), F.array_max(F.transform(own, lambda h: h["dice"])).alias("dice"), F.size(F.array_distinct(F.transform(own, lambda h: h["line"]))).cast("long").alias("n_lines"),
            F.array_min(F.transform(own, lambda h: h["line"])).cast("long").alias("first_line"),
        )

    names = F.array_distinct(F.transform("hits", lambda h: h["license"]))
    return held.select("doc_id", F.explode(F.transform(names, told)).alias("m")).select("doc_id", "m.*")


def oracle() -> str:
    rows = template_rows()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, b))}])" for n, b in rows)
    return f"""
WITH t(license, bigrams) AS (VALUES {values}
), l AS (
  SELECT doc_id, x.i AS line, string_split(trim(regexp_replace(lower(x.t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (
    SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {{'i': i - 1, 't': t}})) AS x FROM documents)
), b AS (
  SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS bigrams FROM l WHERE len(w) > 1
), s AS (
  SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(b.bigrams, t.bigrams)) / (len(b.bigrams) + len(t.bigrams))::DOUBLE AS dice
  FROM b JOIN t ON len(b.bigrams) BETWEEN len(t.bigrams) * 0.6 AND len(t.bigrams) / 0.6
)
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT line) AS n_lines, min(line) AS first_line
FROM s WHERE dice >= {DICE} GROUP BY doc_id, license"""
