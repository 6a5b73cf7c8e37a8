"""Licence scans: Dice coefficient of word bigrams against licence templates.

Each line of a text, and the whole text if it has several lines, is normalised
(lower case, letters and digits, single spaces) and compared as a multiset of word
bigrams with the templates.  Dice >= t needs sizes a, b with
a * t / (2 - t) <= b <= a * (2 - t) / t, so a line only meets the templates that its
number of bigrams allows: an equi-join on that number with a small table of literals
(templates times sizes).

``windows`` finds notices that are wrapped over lines or stand in a line with other
prose: windows of words over the whole normalised text.  A window that reaches
the threshold lacks at most so many of a template's bigrams, so of any larger number
of them it holds one.  Those with telling words are the anchors; only texts with such
a word, and in them only stretches around an anchor, are compared.  The same holds for lines and
whole texts, so texts without any telling word are read and searched, but not cut into lines.
DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

THRESHOLD = 0.8
#: Notices by SPDX identifier (fixed values).
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # phrases of licence texts and of the headers that licences ask for
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("Apache-2.0", "use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty."),
)
#: Words that tell little; any words may stand here, only the cost depends on them.
FREQUENT = frozenset(
    "a all and any are as author available be by code copy either except extent file for form free from general has in into is it law made may no not of on part person "
    "possible provided public source terms that the this to under use version with without work you".split()
)
_DROP = r"[^\p{L}\p{N}\n]+"


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def allowed_sizes(n: int, threshold: float) -> range:
    """Sizes whose Dice coefficient with a multiset of n can reach the threshold."""
    return range(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


def most_missing(n: int, threshold: float) -> int:
    """How many of a template's n bigrams a window that reaches the threshold may lack."""
    return n - min((math.ceil(threshold * (n + a) / 2 - 1e-9) for a in allowed_sizes(n, threshold)), default=0)


def anchors(wanted: Sequence[list[str]], threshold: float) -> tuple[list[str], list[list[str]]]:
    """Words, and bigrams of each template that hold one of them: more than a matching window may lack.

    The words are chosen one by one: the one that brings all templates nearest to enough anchors, long words
    counting for more since they are rarer in prose.
    """
    # repeats of a bigram are lacking together or not at all
    kinds = [sorted(set(b)) for b in wanted]
    need = [min(len(k), most_missing(len(b), threshold) + 1) for b, k in zip(wanted, kinds)]
    words: list[str] = []

    def held(chosen):
        return [[g for g in k if any(w in chosen for w in g.split())] for k in kinds]

    def gain(w):
        return sum(min(n, len(h)) for n, h in zip(need, held({*words, w}))) - sum(min(n, len(h)) for n, h in zip(need, held(set(words))))

    while any(len(h) < n for n, h in zip(need, held(set(words)))):
        left = sorted({w for k in kinds for g in k for w in g.split()} - set(words))
        words.append(max(left, key=lambda w: (gain(w) > 0, gain(w) * (0 if w in FREQUENT or w.isdigit() else max(1, len(w) - 3)), gain(w))))
    # the bigrams with the longest telling words are enough
    return words, [sorted(h, key=lambda g: (-max(len(w) for w in g.split() if w in words), g))[:n] for n, h in zip(need, held(set(words)))]


def _common(have, want):
    """Size of the common part of two multisets."""
    each = F.transform(F.array_distinct(want), lambda b: F.least(F.size(F.filter(have, lambda x: x == b)), F.size(F.filter(want, lambda x: x == b))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _pairs(words):
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))))


def _windows(docs: DataFrame, met: DataFrame, found, telling, threshold: float) -> DataFrame:
    """(doc_id, key, license, dice, first, last, from, to): the best window about each anchor, by lines and by bigrams.

    Anchors on a line that matches by itself (``met``) are left out: no window may touch such a line.
    """
    found = [(name, b) for _, name, b in found]
    known = [(g, name, len(b), min(allowed_sizes(len(b), threshold)), max(allowed_sizes(len(b), threshold)), b) for (name, b), held in zip(found, telling) for g in held]
    table = docs.sparkSession.createDataFrame(known, "anchor string, license string, size int, low int, high int, want array<string>")
    # the longest window of the templates that an anchor speaks for
    longest: dict[str, int] = {}
    for r in known:
        longest[r[0]] = max(longest.get(r[0], 1), r[4])
    reaches = F.create_map(*[F.lit(v) for pair in sorted(longest.items()) for v in pair])
    reach = lambda x: F.element_at(reaches, x["anchor"])
    lines = F.transform(F.split(F.regexp_replace(F.lower(F.col("text")), _DROP, " "), "\n"), lambda t: F.filter(F.split(t, " "), lambda w: w != ""))
    # words must be an array of its own: a field of an array of structs would be cut out again for every word
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), lines.alias("by_line"))
    rows = rows.select("doc_id", "key", F.flatten("by_line").alias("words"), F.flatten(F.transform("by_line", lambda ws, i: F.array_repeat(i, F.size(ws)))).alias("lines"))
    rows = rows.withColumn("grams", _pairs(F.col("words")))
    places = F.filter(F.transform("grams", lambda g, i: F.struct(g.alias("anchor"), (i + 1).alias("at"))), lambda x: x["anchor"].isin(sorted(longest)))
    # what stands around an anchor is cut out before the rows are multiplied
    start = lambda x: F.greatest(F.lit(1), x["at"] - (reach(x) - 1))
    about = F.transform(places, lambda x: F.struct(x["anchor"].alias("anchor"), x["at"].alias("at"), start(x).alias("start"), F.slice("grams", start(x), x["at"] - start(x) + reach(x)).alias("near"), F.slice("lines", start(x), x["at"] - start(x) + reach(x) + 1).alias("lines")))
    rows = rows.select("doc_id", "key", F.explode(about).alias("a")).select("doc_id", "key", "a.*").withColumn("line", F.element_at("lines", F.col("at") - F.col("start") + 1))
    lone = met.where("not whole").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("line").alias("_l")).distinct()
    rows = rows.join(lone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("line") == F.col("_l")), "left_anti").drop("line")
    rows = rows.join(F.broadcast(table), "anchor").withColumn("c", F.col("at") - F.col("start") + 1)
    # a best window begins and ends with a bigram of the template
    held = F.filter(F.sequence(F.lit(1), F.size("near")), lambda k: F.array_contains(F.col("want"), F.element_at("near", k)))
    rows = rows.withColumn("held", held)
    # no more of the template can be in a window than held places are
    bound = lambda i, j, a, b: 2 * (b - a + 1) >= threshold * (j - i + 1 + F.col("size")) - 1e-9
    fits = lambda i, j: (j >= F.col("c")) & (j - i + 1 >= F.col("low")) & (j - i + 1 <= F.col("high"))
    ends = F.transform("held", lambda k, at: F.struct(k.alias("k"), at.alias("at")))
    rows = rows.withColumn("ends", ends)
    spans = F.flatten(F.transform(F.filter("ends", lambda i: i["k"] <= F.col("c")), lambda i: F.transform(F.filter("ends", lambda j: fits(i["k"], j["k"]) & bound(i["k"], j["k"], i["at"], j["at"])), lambda j: F.struct(i["k"].alias("i"), j["k"].alias("j")))))
    rows = rows.withColumn("spans", spans)
    dice = lambda s: 2.0 * _common(F.slice("near", s["i"], s["j"] - s["i"] + 1), F.col("want")) / (s["j"] - s["i"] + 1 + F.col("size"))
    best = F.array_max(F.transform("spans", lambda s: F.struct(dice(s).alias("dice"), (-s["i"]).alias("i"), s["j"].alias("j"))))
    # by way of a generator, so that the optimizer doesn't work all this out again in the filter, place by place
    rows = rows.select("*", F.explode_outer(F.array(best)).alias("best")).where(F.col("best.dice") >= threshold)
    i, j = -F.col("best.i"), F.col("best.j")
    return rows.select("doc_id", "key", "license", F.col("best.dice").alias("dice"), F.element_at("lines", i).alias("first"), F.element_at("lines", j + 1).alias("last"), (F.col("start") + i - 1).alias("from"), (F.col("start") + j).alias("to"))


def _apart(windows):
    """How many of the windows (from, to: its words, both included; dice) stand apart: of those that overlap the best counts."""
    ordered = F.array_sort(F.transform(windows, lambda w: F.struct(w["from"].alias("from"), (-w["dice"]).alias("d"), w["to"].alias("to"))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"), F.lit(0.0).cast("double").alias("d"))

    def step(s, w):
        after, better = w["from"] > s["to"], w["d"] < s["d"]
        return F.struct((s["n"] + after.cast("long")).alias("n"), F.when(after | better, w["to"]).otherwise(s["to"]).alias("to"), F.when(after | better, w["d"]).otherwise(s["d"]).alias("d"))

    return F.aggregate(ordered, none, step, lambda s: s["n"])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """(doc_id, license, dice, n_matches): one row for each distinct doc_id of ``docs``.

    ``license`` is the best match's (the highest Dice, then the least name), null if nothing reaches the
    threshold; ``n_matches`` counts lines that match some template.  With ``windows`` notices that are no line of
    their own count too: windows of words that touch no matching line, each stretch of text once.  Rows of one
    doc_id (null is one) are one document.  Null and empty texts match nothing.
    Further columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = [(i, name, b) for i, (name, text) in enumerate(templates) if (b := bigrams(text))]
    words, telling = anchors([b for _, _, b in found], threshold)
    rows = [(n, i, name, len(b), b) for i, name, b in found for n in allowed_sizes(len(b), threshold)]
    table = spark.createDataFrame(rows, "n int, template int, license string, size int, want array<string>")
    ids = docs.select("doc_id").distinct()
    # whatever matches holds an anchor; in a lambda, so that the text is lowered once and not for each word
    docs = docs.where(F.exists(F.array(F.lower(F.col("text"))), lambda t: reduce(or_, (t.contains(w) for w in words), F.lit(False))))
    text = F.regexp_replace(F.lower(F.col("text")), _DROP, " ")
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.translate(text, "\n", " ")))).otherwise(lines)
    # the whole text stands for all lines
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(lines).alias("n_lines"), F.posexplode(units).alias("line", "t"))
    rows = rows.withColumn("words", F.filter(F.split("t", " "), lambda w: w != "")).withColumn("n", F.size("words") - 1)
    low, high = min((r[0] for r in rows_of(found, threshold)), default=1), max((r[0] for r in rows_of(found, threshold)), default=0)
    rows = rows.where((F.col("n") >= low) & (F.col("n") <= high))
    rows = rows.select("doc_id", "key", "line", (F.col("line") == F.col("n_lines")).alias("whole"), "n", _pairs(F.col("words")).alias("have"))
    # a table of literals: templates times the sizes they allow
    met = rows.join(F.broadcast(table), "n").where(F.arrays_overlap("have", "want"))
    met = met.select("doc_id", "key", "line", "whole", "license", (2.0 * _common(F.col("have"), F.col("want")) / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= threshold)
    if windows:
        met = Scratch(spark).save(met)
        spot = "struct<first: int, last: int, from: int, to: int, dice: double, license: string>"
        lone = met.select("doc_id", "key", "line", "whole", "license", "dice", F.lit(None).cast(spot).alias("w"))
        wide = _windows(docs, met, found, telling, threshold).select("doc_id", "key", F.lit(None).cast("int").alias("line"), F.lit(False).alias("whole"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"), F.struct("first", "last", "from", "to", "dice", "license").cast(spot).alias("w"))
        rank = F.when(F.col("line").isNotNull(), F.struct((-F.col("dice")).alias("d"), F.col("license")))
        each = lone.unionByName(wide).groupBy("doc_id", "key").agg(F.min(rank).alias("b"), F.collect_set("line").alias("lines"), F.max("whole").alias("whole"), F.collect_set("w").alias("ws"))
        free = F.filter("ws", lambda w: ~F.col("whole") & ~F.exists("lines", lambda x: (x >= w["first"]) & (x <= w["last"])))
        each = each.withColumn("ws", free)
        each = each.withColumn("b", F.least("b", F.array_min(F.transform("ws", lambda w: F.struct((-w["dice"]).alias("d"), w["license"].alias("license"))))))
        best = each.groupBy("doc_id").agg(F.min("b").alias("b"), (F.size(F.array_distinct(F.flatten(F.collect_list("lines")))) + F.sum(_apart(F.col("ws")))).alias("n_matches"))
    else:
        best = met.groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("d"), F.col("license"))).alias("b"), F.count_distinct("line").alias("n_matches"))
    best = best.select(F.col("doc_id").alias("_d"), F.col("b.license").alias("license"), (-F.col("b.d")).alias("dice"), "n_matches")
    return ids.join(best, F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "license", "dice", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


def rows_of(found, threshold):
    return [(n,) for _, _, b in found for n in allowed_sizes(len(b), threshold)]


def scan_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    sizes = [n for (n,) in rows_of([(i, name, bigrams(text)) for i, (name, text) in enumerate(templates)], threshold)]
    quoted = ", ".join("({}, '{}', {})".format(i, name, "[" + ", ".join(f"'{x}'" for x in bigrams(text)) + "]") for i, (name, text) in enumerate(templates))
    return rf"""
WITH p AS (SELECT * FROM (VALUES {quoted}) AS p(template, license, want)),
x AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, string_split(t, chr(10)) AS ls, t FROM x),
m AS (SELECT doc_id, CASE WHEN len(ls) > 1 THEN list_append(ls, replace(t, chr(10), ' ')) ELSE ls END AS ls FROM l),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM m),
w AS (SELECT doc_id, line, list_filter(string_split(s, ' '), lambda x: x <> '') AS words FROM u),
b AS (SELECT doc_id, line, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS have FROM w WHERE len(words) - 1 BETWEEN {min(sizes)} AND {max(sizes)}),
j AS (SELECT doc_id, line, license, 2.0 * list_sum(list_transform(list_distinct(want), lambda y: least(len(list_filter(have, lambda x: x = y)), len(list_filter(want, lambda x: x = y)))))
    / (len(have) + len(want)) AS dice FROM b JOIN p ON len(have) * {threshold} <= len(want) * (2 - {threshold}) + 1e-9 AND len(want) * {threshold} <= len(have) * (2 - {threshold}) + 1e-9),
g AS (SELECT doc_id, max(dice) AS dice, arg_min(license, (-dice, license)) AS license, count(DISTINCT line) AS n_matches FROM j WHERE dice >= {threshold} GROUP BY doc_id)
SELECT d.doc_id, g.license, round(g.dice, 6) AS dice, coalesce(g.n_matches, 0) AS n_matches
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""
