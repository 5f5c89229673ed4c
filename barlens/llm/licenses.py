"""Licence notices in texts: Dice coefficient of word bigrams against templates, with DataFrame functions only."""

from __future__ import annotations

import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from barlens.llm.common import table

LEAST_DICE = 0.8
#: Customary notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
}

#: Compared with runs of words only: the texts of MIT and ISC, the conditions of BSD-3-Clause, a paragraph of the Unlicense, and how the texts of long licences begin.
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
            "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. "
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                     "and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."],
    "Unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the "
                "creation of, or owns Covered Software."],
}

#: Words that most texts have: not used to tell which texts are searched, unless no other will do.
COMMON = set("a an and any are as at be by for from has have if in into is it its may no not of on or other that the their this to under use with you all free source terms without 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    """Words of a normalised template."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, sorted."""
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Bigram counts of a unit that can reach the coefficient with n bigrams: 2 min / (a + b) is its largest value."""
    fits = [m for m in range(1, int(n * (2 - least) / least) + 2) if 2 * min(m, n) >= least * (m + n) - 1e-9]
    return min(fits), max(fits)


def least_common(n: int, least: float) -> int:
    """Bigrams of a template of n that a run with the coefficient has at least: 2 c / (n + n) is its largest value with c of them."""
    return min(c for c in range(1, n + 1) if c >= least * n - 1e-9)


def gate_words(sets: list[list[str]], least: float) -> list[str]:
    """Words of which every run that reaches a template has one: so many bigrams of each template hold one of them that no run can do without all."""
    words = sorted({w for b in sets for x in b for w in x.split()})
    found, open_ = [], [(set(b), len(b) - least_common(len(b), least) + 1) for b in sets]
    while open_:
        gain = {w: (1e-6 if w in COMMON else 1.0) * sum(min(need, sum(w in x.split() for x in b)) / need for b, need in open_) for w in words}
        w = max(words, key=lambda w: (gain[w], w))
        found.append(w)
        rest = [({x for x in b if w not in x.split()}, need - sum(w in x.split() for x in b)) for b, need in open_]
        open_ = [(b, need) for b, need in rest if need > 0]
    return found


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _runs(flat: list[tuple], least: float) -> Column:
    """Per template the best run of words that counts beside what lines and the whole text have found.

    A run shorter than the template counts as one of its size: a part of a notice without the word that tells the licence is not a hit.
    A run that reaches the coefficient can be cut to begin at a bigram of the template and reaches it still, so runs begin there.  A bigram
    is new in a run if it did not occur since the run's first, which one sort tells for all runs.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(x) for x in b]).alias("b"), F.lit(len(b)).alias("n"),
                               F.lit(least_common(len(b), least)).alias("c"), F.lit(most).alias("most")) for name, b, most in flat])
    lines = F.transform(F.split("_text", "\n"), lambda u, at: F.transform(F.filter(F.split(u, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), at.alias("line"))))

    def marked(w: Column) -> Column:
        b = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(F.concat_ws(" ", w[i]["w"], w[i + 1]["w"]).alias("b"), i.alias("i"),
                                                                               w[i]["line"].alias("first"), w[i + 1]["line"].alias("last")))
        return _let(F.array_sort(b), lambda s: F.array_sort(F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"), F.when((j > 0) & (F.get(s, j - 1)["b"] == x["b"]), F.get(s, j - 1)["i"]).otherwise(-1).alias("before"), x["b"].alias("b"), x["first"], x["last"]))))

    def best(m: Column, t: Column, held: Column) -> Column:
        """The largest coefficient of the runs that begin with a bigram of the template."""
        def grown(s: Column, x: Column, begin: Column) -> Column:
            new = x["before"] < begin["i"]
            a, c = s["a"] + new.cast("int"), s["c"] + (new & x["own"]).cast("int")
            d = 2.0 * c / (F.greatest(a, t["n"]) + t["n"])
            counts = (held == 0.0) | ((x["last"] > begin["first"]) & (d > held + 1e-9))
            return F.struct(a.alias("a"), c.alias("c"), F.greatest(s["d"], F.when(counts, d).otherwise(0.0)).alias("d"))
        zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0.0).alias("d"))
        return F.array_max(F.transform(F.filter(m, lambda x: x["own"]), lambda begin: F.aggregate(
            F.slice(m, begin["i"] + 1, t["most"]), zero, lambda s, x: grown(s, x, begin), lambda s: s["d"])))

    def scored(m: Column, t: Column) -> Column:
        own = F.transform(m, lambda x: F.struct(x["i"], x["before"], x["first"], x["last"], F.array_contains(t["b"], x["b"]).alias("own")))
        held = F.coalesce(F.array_max(F.filter("_found", lambda x: x["name"] == t["name"])["dice"]), F.lit(0.0))
        return F.struct(F.coalesce(_let(held, lambda h: _let(own, lambda o: best(o, t, h))), F.lit(0.0)).alias("dice"), t["name"].alias("name"))

    def over(m: Column) -> Column:
        near = _let(F.array_distinct(m["b"]), lambda b: F.filter(kinds, lambda t: F.size(F.array_intersect(t["b"], b)) >= t["c"]))
        return F.filter(F.transform(near, lambda t: scored(m, t)), lambda x: x["dice"] >= least - 1e-9)
    none = F.array().cast("array<struct<dice:double,name:string>>")
    words = gate_words([b for _, b, _ in flat], least)
    gate = _let(F.concat(F.lit(" "), "_whole", F.lit(" ")), lambda p: reduce(or_, [p.contains(f" {w} ") for w in words]))
    best_runs = _let(F.flatten(lines), lambda w: F.when(F.size(w) >= 2, _let(marked(w), over)).otherwise(none))
    return F.when(gate, best_runs).otherwise(none)


def licence_hits(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST_DICE, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_hits, licences, best, best_dice.

    Units are the lines of a text and the whole text.  A unit is lower-cased, everything but a-z and 0-9 becomes one
    blank, and its distinct word bigrams are compared with those of each template: 2 * common / (a + b).  Units whose number of
    words, or of different words at their beginning, rules out every template are left before bigrams are made, and a template
    is compared only with units within its own size bounds.  ``n_hits`` counts pairs of a distinct unit and a template.
    Runs of words, within a line or over line ends, are units too, of as many bigrams at most as the size bounds of the template and its own repetitions
    allow, and a shorter run than the template counts as one of its size; a template counts once, with its best run.  A run counts if neither a line nor the whole text reaches its identifier, or if it goes over
    a line end and has a larger coefficient than these.  Documents are searched for runs only if they have one of the words without which no template can be
    reached.  ``texts`` (TEXTS beside the given templates) are compared with runs only.
    ``licences`` lists identifiers reached by any unit, sorted; ``best`` has the largest coefficient (ties: the first identifier).

    All of it is one projection with higher-order functions over arrays: no join, no shuffle, no Python.
    Null and empty texts have no hits (n_hits 0, empty list, null best); texts of any length are read whole; repeated rows
    are scanned each; an empty table gives no rows; other columns are not read.
    """
    flat = [(name, b, *size_bounds(len(b), least)) for name in sorted(templates) for t in templates[name] if (b := template_bigrams(t))]
    lo, hi = (min(x[2] for x in flat), max(x[3] for x in flat)) if flat else (1, 0)
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text, "[^a-z0-9\\n]+", " ").alias("_text"))
    read = read.select("doc_id", "_text", F.regexp_replace("_text", "[ \n]+", " ").alias("_whole"))
    units = F.concat(F.split("_text", "\n"), F.array("_whole"))
    units = F.array_distinct(F.transform(units, lambda u: F.trim(u)))
    # m distinct bigrams need m + 1 words and 2 m + 1 characters; each word after the first that is new makes a new bigram
    units = F.filter(units, lambda u: F.length(u) >= 2 * lo + 1)
    words = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: (F.size(w) > lo) & (F.size(F.array_distinct(F.slice(w, 1, 4 * (hi + 1)))) <= hi + 1))

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1])))
    sets = F.filter(F.transform(words, bigrams), lambda b: F.size(b).between(lo, hi))

    def dice(b: Column, name: str, t: list[str], least_n: int, most_n: int) -> Column:
        d = 2.0 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in t]))) / (F.size(b) + len(t))
        return F.struct(F.when(F.size(b).between(least_n, most_n), d).otherwise(0.0).alias("dice"), F.lit(name).alias("name"))
    found = F.filter(F.flatten(F.transform(F.col("_sets"), lambda b: F.array(*[dice(b, *x) for x in flat]))), lambda x: x["dice"] >= least - 1e-9)
    if not flat:
        found = F.array().cast("array<struct<dice:double,name:string>>")
    texts = texts if texts is not None else TEXTS if templates is TEMPLATES else {}
    kinds = [(name, b, size_bounds(len(b), least)[1] + len(words_of(t)) - 1 - len(b)) for some in (templates, texts) for name in sorted(some) for t in some[name] if (b := template_bigrams(t))]
    out = read.select("doc_id", "_text", "_whole", sets.alias("_sets")).select("doc_id", "_text", "_whole", found.alias("_found"))
    if kinds:
        out = out.select("doc_id", F.concat("_found", _runs(kinds, least)).alias("_found"))
    best = F.array_min(F.transform("_found", lambda x: F.struct((-x["dice"]).alias("d"), x["name"].alias("name"))))
    return out.select("doc_id", F.size("_found").cast("long").alias("n_hits"), F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["name"]))).alias("licences"),
                      best["name"].alias("best"), (-best["d"]).alias("best_dice"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    out = licence_hits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_hits", F.concat_ws(",", "licences").alias("licences"), "best", F.round("best_dice", 9).alias("best_dice"))


def _sql() -> str:
    rows = [(i, name, template_bigrams(t)) for i, (name, t) in enumerate((n, t) for n in sorted(TEMPLATES) for t in TEMPLATES[n])]
    values = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in b)}])" for i, name, b in rows)
    return f"""
WITH t(nr, name, bigrams) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
             '[^a-z0-9\\n]+', ' ', 'g') AS text FROM documents),
u AS (SELECT DISTINCT r, trim(unit) AS unit FROM (
        SELECT r, unnest(string_split(text, chr(10))) AS unit FROM d UNION ALL SELECT r, regexp_replace(text, '[ \\n]+', ' ', 'g') FROM d)),
w AS (SELECT r, unit, string_split(unit, ' ') AS w FROM u WHERE len(string_split(unit, ' ')) > 1),
b AS (SELECT r, unit, list_distinct([concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))]) AS b FROM w),
h AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) AS dice FROM b, t
      WHERE 2 * least(len(b), len(bigrams)) >= {LEAST_DICE} * (len(b) + len(bigrams)) - 1e-9),
g AS (SELECT r, count(*) AS n_hits, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, arg_min(name, (-dice, name)) AS best, max(dice) AS best_dice
      FROM h WHERE dice >= {LEAST_DICE} - 1e-9 GROUP BY r)
SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(licences, '') AS licences, best, round(best_dice, 9) AS best_dice FROM d LEFT JOIN g USING (r)
"""


OP6_SQL = _sql()
