"""License scans: normalised text against licence templates by Dice coefficient over word bigrams, in DataFrame operations only.

Units are the whole text, its paragraphs (parted by blank lines), its lines, and windows of words. Two bounds prune before a coefficient is
computed: a text that shares fewer bigrams with a template than any matching unit must is skipped with all its units,
and a unit is compared with the templates of fitting size only, as Dice >= t needs sizes within t / (2 - t) of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices and headers of common public licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


#: What parts paragraphs: empty lines, and lines of comment marks alone.
_BLANK = r"\n[\x20\x09\r]*(?:[#*/;%!-]+[\x20\x09\r]*)?\n\s*"
#: Most bigrams of the templates that are scanned at once, as they become literals of the plan.
BOUND = 20_000


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """Normalised words: lower case, runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(text: Column) -> Column:
    """Pairs of neighbouring words, in order."""
    pairs = lambda w, n: F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return _let(_words(text), lambda w: pairs(w, F.greatest(F.size(w) - 1, F.lit(0))))


def _bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(_pairs(text))


def _named(kind: str, parts: Column) -> Column:
    return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("part")))


def _best(grams: Column, share: float) -> Column:
    """The template of fitting size with the highest coefficient, of the column `templates`; null if none fits."""
    n = F.size(grams)
    fitting = F.filter("templates", lambda t: (t["m"] >= n * share - 1e-9) & (t["m"] <= n / share + 1e-9))
    dice = lambda t: 2.0 * F.size(F.array_intersect(t["grams"], grams)) / (t["m"] + n)
    return F.array_max(F.transform(fitting, lambda t: F.struct(dice(t).alias("dice"), (-t["template"]).alias("order"), t["license"].alias("license"))))


def _windows(t: Column, least: float, share: float) -> Column:
    """Runs of `pairs` that reach `least` with a template. Such a run that starts or ends with a pair not of the template
    reaches more without it, so runs between two of its pairs are enough; they hold m * share of them at least."""
    need = F.ceil(t["m"] * share - 1e-9).cast("int")
    longest = F.floor(t["n"] / share + 1e-9).cast("int")

    def run(start, end):
        grams = F.array_distinct(F.slice("pairs", start + 1, end - start + 1))
        return _let(grams, lambda g: _let(F.size(F.array_intersect(t["grams"], g)), lambda x: F.struct((-x).alias("fewer"), (-2.0 * x / (t["m"] + F.size(g))).alias("worse"), t["template"].alias("template"), start.alias("start"), end.alias("end"), t["license"].alias("license"))))

    ends = lambda at, start, i: F.filter(F.slice(at, i + need, longest), lambda end: end - start < longest)
    hits = F.filter(F.transform("pairs", lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
    runs = _let(hits, lambda at: F.flatten(F.transform(at, lambda start, i: F.transform(ends(at, start, i), lambda end: run(start, end)))))
    return F.filter(runs, lambda w: w["worse"] <= -least)


def _disjoint(windows: Column) -> Column:
    """The windows that share the most with their template, then the closest, without those that overlap a better one."""
    meets = lambda w, k: (w["start"] <= k["end"]) & (k["start"] <= w["end"])
    add = lambda kept, w: F.when(F.exists(kept, lambda k: meets(w, k)), kept).otherwise(F.concat(kept, F.array(w)))
    return F.aggregate(F.array_sort(windows), F.slice(windows, 1, 0), add)


def scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, bound: int = BOUND) -> DataFrame:
    """doc_id, unit, unit_no, license, template, dice: the best template of every unit with a coefficient of `least` or more.

    unit is document, paragraph, line or window; unit_no counts from 0. Windows are runs of words of any length, numbered
    by their first word; they do not overlap, and tell the licences that no other unit of the text tells. templates: (licence, text), numbered from 0; ties go to
    the smaller number. Null and blank texts, and units of one word, match nothing. Repeated rows are each returned.
    Texts of any length are scanned whole. Templates of more than `bound` bigrams are scanned in parts, each over all texts, and
    every unit gets the best over the parts; windows of different parts may overlap. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    known = [r for r in given.select("template", "license", _bigrams(F.col("text")).alias("grams"), F.size(_pairs(F.col("text"))).alias("n")).collect() if r.grams]
    parts, size = [[]], 0
    for r in known:
        if parts[-1] and size + len(r.grams) > bound:
            parts.append([])
            size = 0
        parts[-1].append(r)
        size += len(r.grams)
    if len(parts) == 1:
        return _scan(docs.select("doc_id", "text"), ["doc_id"], known, least)
    of = ["doc_id", "__text"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__text"))
    hits = [_scan(rows, of, part, least) for part in parts]
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    every = every.groupBy(every.columns).agg(F.count("*").alias("n"))  # of rows alike
    fields = F.struct("license", "template", "dice", "n")
    units = every.filter("unit <> 'window'").groupBy(*of, "unit", "unit_no").agg(F.min_by(fields, F.struct(-F.col("dice"), "template")).alias("u"))
    units = units.select(*of, "unit", "unit_no", "u.*")
    told = units.select(*of, "license").distinct()
    windows = every.filter("unit = 'window'").alias("w").join(told.alias("t"), (F.col("w.__text") == F.col("t.__text")) & F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.license") == F.col("t.license")), "left_anti")
    out = units.union(windows.select(units.columns))
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "unit", "unit_no", "license", "template", "dice")


def _scan(docs: DataFrame, of: list[str], known: list, least: float) -> DataFrame:
    """scan over templates within the bound; the columns `of` are carried along."""
    vocabulary = sorted({g for r in known for g in r.grams})
    table = F.array(*[F.struct(F.lit(r.template).alias("template"), F.lit(r.license).alias("license"), F.array(*map(F.lit, r.grams)).alias("grams"), F.lit(len(r.grams)).alias("m"), F.lit(r.n).alias("n")) for r in known])
    share = least / (2 - least)

    # a matching unit has x bigrams at least, so 2x / (x + m) >= t: it shares ceil(t m / (2 - t)) with a template of m
    fewest = min((len(r.grams) * share for r in known), default=0)
    hits = F.array_intersect(_bigrams(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    shared = docs.select(*of, "text", F.explode(F.array(hits)).alias("hits")).filter(F.size("hits") >= fewest - 1e-9)
    possible = F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], F.col("hits"))) >= t["m"] * share - 1e-9)
    shared = shared.select(*of, "text", F.explode(F.array(possible)).alias("templates")).filter(F.size("templates") > 0)

    every = F.concat(_named("document", F.array("text")), _named("paragraph", F.split("text", _BLANK)), _named("line", F.split("text", r"\r?\n")))
    rows = shared.select(*of, "text", "templates", F.explode(F.array(_pairs(F.col("text")))).alias("pairs"))
    units = F.filter(F.transform(every, lambda u: F.struct(u["unit"].alias("unit"), u["unit_no"].alias("unit_no"), _let(_bigrams(u["part"]), lambda g: _best(g, share)).alias("best"))), lambda u: u["best"]["dice"] >= least)
    rows = rows.select(*of, F.explode(F.array(units)).alias("units"), _disjoint(F.flatten(F.transform("templates", lambda t: _windows(t, least, share)))).alias("windows"))
    told = F.transform("units", lambda u: u["best"]["license"])
    one = lambda unit, no, license, order, dice: F.struct(unit.alias("unit"), no.alias("unit_no"), license.alias("license"), (-order).alias("template"), dice.alias("dice"))
    out = F.concat(
        F.transform("units", lambda u: one(u["unit"], u["unit_no"], u["best"]["license"], u["best"]["order"], u["best"]["dice"])),
        F.transform(F.filter("windows", lambda w: ~F.array_contains(told, w["license"])), lambda w: one(F.lit("window"), w["start"], w["license"], -w["template"], -w["worse"])),
    )
    return rows.select(*of, F.explode(out).alias("u")).select(*of, "u.unit", "u.unit_no", "u.license", "u.template", "u.dice")
