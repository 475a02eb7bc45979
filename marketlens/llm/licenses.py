"""Licence scan by Dice coefficient over word bigrams, in DataFrame operations.

A text's units are its lines and its paragraphs of several lines, and the runs
of neighbouring words anywhere in it, for notices that share their line with
other text or are wrapped in comment marks.  A unit and a
template are normalised alike (lower case, letters and digits only) and compared
by ``2 |a & b| / (|a| + |b|)`` over their sets of word bigrams.  To reach a
threshold t, a unit's set must have between ``t / (2 - t)`` and ``(2 - t) / t``
times the template's size: units outside the bounds of all templates are cut
before their bigrams are made, as are units without a word that a match must
hold; candidate templates outside a unit's bounds are cut before the shared
bigrams are counted.

Of the runs around a notice the best begins and ends with a bigram of the
template, so only those are compared, where as many of the template's bigrams as
a match needs lie within the longest run a match may have.  A run's size is its
shared bigrams and the places of its others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Notices of common public licences, as (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text):
    """Normalised words; none for a text without letters or digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda w: w != "")


def pairs_of(w):
    """The neighbouring pairs of words, in order."""
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def bigrams(w):
    """Set of the neighbouring pairs of words."""
    return F.array_distinct(pairs_of(w))


def units(text):
    """Lines, and the paragraphs (between blank lines) of several lines."""
    text = F.coalesce(text, F.lit(""))
    several = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda p: F.trim(p).contains("\n"))
    return F.concat(F.split(text, "\n", -1), several)


def anchors(sets: list[list[str]], percent: int) -> list[str]:
    """Words of which every match of a template holds one.  A match shares at
    least ``t / (2 - t)`` of the template's bigrams; more of them than a match
    may miss hold an anchor.  Long words come first, as they are rare."""
    out = set()
    for grams in sets:
        may_miss = len(grams) - -(-percent * len(grams) // (200 - percent))
        held: set[str] = set()
        for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
            if len(held) > may_miss:
                break
            held.update(g for g in grams if word in g.split(" "))
            out.add(word)
    return sorted(out)


def run_matches(docs: DataFrame, by_gram: DataFrame, least: int, rare: list[str], percent: int) -> DataFrame:
    """(doc_id, license, n_units, b): notices among the runs of words of whole
    texts.  Runs that overlap are one place."""
    w = F.filter(F.transform(F.array("text"), words),
                 lambda w: (F.size(w) - 1 >= least) & F.exists(w, lambda x: x.isin(rare)))
    text = ["doc_id", "body", "template", "license", "template_size"]
    size = F.col("template_size")
    need = F.ceil(size * percent / (200 - percent)).cast("int")            # shared bigrams of a match, at least
    most = F.floor(size * (200 - percent) / percent).cast("int")           # places of a run, at most
    held = (docs.select("doc_id", F.xxhash64("text").alias("body"), F.explode(F.transform(w, pairs_of)).alias("g"))
            .select("doc_id", "body", F.posexplode("g").alias("at", "gram")).join(by_gram, "gram")
            .groupBy(text).agg(F.sort_array(F.collect_set(F.struct("at", "gram"))).alias("p"))    # of one text
            .withColumn("need", need).withColumn("most", most).where(F.size("p") >= F.col("need")))
    at = lambda k: F.get("p", k)["at"]
    starts = F.filter(F.sequence(F.lit(0), F.size("p") - F.col("need")),
                      lambda k: at(k + F.col("need") - 1) - at(k) < F.col("most"))
    near = held.select(*text, "need", "p", "most", F.explode(starts).alias("k")).select(
        *text, "need", F.filter(F.slice("p", F.col("k") + 1, F.col("most")), lambda x: x["at"] - at(F.col("k")) < F.col("most")).alias("p"))

    def run(j):                                                            # from the first to the j-th shared place
        shared = F.size(F.array_distinct(F.transform(F.slice("p", F.lit(1), j), lambda x: x["gram"])))
        return F.struct(shared.alias("shared"), (shared + at(j - 1) - at(F.lit(0)) + 1 - j).alias("unit_size"), at(j - 1).alias("end"))

    found = (near.select(*text, at(F.lit(0)).alias("start"), F.explode(F.transform(F.sequence("need", F.size("p")), run)).alias("r"))
             .select(*text, "start", "r.*").where(F.col("shared") * 200 >= percent * (F.col("unit_size") + size)))
    before = Window.partitionBy("doc_id", "body", "license").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("end").over(before)
    best = F.struct((F.col("shared") * 2 / (F.col("unit_size") + size)).alias("dice"), (-F.col("template")).alias("t"),
                    (-F.col("start")).alias("u"), F.col("shared").cast("long").alias("shared"), "unit_size", "template_size")
    return (found.withColumn("new", (last.isNull() | (F.col("start") > last)).cast("long"))
            .groupBy("doc_id", "license").agg(F.sum("new").alias("n_units"), F.max(best).alias("b")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """One row per (doc_id, license) found: ``n_units`` (distinct unit places),
    and ``shared``, ``unit_size``, ``template_size`` and ``dice`` of the best
    match.  Lines and paragraphs come before runs: where one matches, the best of
    them is given; ``n_units`` is their number or that of the places of runs,
    whichever is larger.

    Reads ``docs(doc_id, text)``; null and empty texts match nothing, units and
    templates of under two words have no bigram and match nothing.  A unit that
    reaches the threshold for templates of several licences counts for each.
    Rows that share a doc_id are counted together."""
    spark = docs.sparkSession
    listed = (spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)],
                                    "template int, license string, body string")
              .select("template", "license", bigrams(words(F.col("body"))).alias("grams"))
              .withColumn("template_size", F.size("grams")).where("template_size > 0"))
    sets = [r[0] for r in listed.select("grams").collect()]            # one row per template, a parameter
    known = sorted({g for grams in sets for g in grams})
    least = -(-percent * min(map(len, sets), default=1) // (200 - percent))
    most = (200 - percent) * max(map(len, sets), default=1) // percent
    rare = anchors(sets, percent)
    # Each step's value is bound once, as the element of an array of one: as columns, the optimiser would write the
    # steps out anew in every filter over them.  Of n words there are at most n - 1 bigrams; repeats make the set
    # smaller, so only the lower bound holds for words.
    w = F.filter(F.transform(F.array("body"), words),
                 lambda w: (F.size(w) - 1 >= least) & F.exists(w, lambda x: x.isin(rare)))
    sized = F.transform(F.filter(F.transform(w, bigrams), lambda g: F.size(g) <= most), lambda g: F.struct(
        F.size(g).alias("unit_size"), F.filter(g, lambda x: x.isin(known)).alias("grams")))
    unit = (docs.select("doc_id", F.posexplode(units(F.col("text"))).alias("unit", "body"))
            .where(F.char_length("body") >= 2 * least + 1)
            .select("doc_id", "unit", F.xxhash64("body").alias("body"), F.explode(sized).alias("u"))
            .select("doc_id", "unit", "body", "u.unit_size", F.explode("u.grams").alias("gram")))
    # the templates are a parameter of a few dozen texts, not data
    by_gram = F.broadcast(listed.select("template", "license", "template_size", F.explode("grams").alias("gram")))
    fits = (F.col("unit_size") * (200 - percent) >= percent * F.col("template_size")) & (
        F.col("unit_size") * percent <= (200 - percent) * F.col("template_size"))
    pairs = (unit.join(by_gram, "gram").where(fits).groupBy("doc_id", "unit", "body", "template", "license", "unit_size", "template_size")
             .agg(F.countDistinct("gram").alias("shared"))        # a repeated row's grams count once
             .where(F.col("shared") * 200 >= percent * (F.col("unit_size") + F.col("template_size"))))
    dice = F.col("shared") * 2 / (F.col("unit_size") + F.col("template_size"))
    best = F.struct(dice.alias("dice"), (-F.col("template")).alias("t"), (-F.col("unit")).alias("u"),
                    "shared", "unit_size", "template_size")
    whole = pairs.groupBy("doc_id", "license").agg(F.countDistinct("unit").alias("n_units"), F.max(best).alias("b"))
    either = whole.withColumn("whole", F.lit(1)).union(
        run_matches(docs.select("doc_id", "text"), by_gram, least, rare, percent).withColumn("whole", F.lit(0)))
    return (either.groupBy("doc_id", "license").agg(F.max("n_units").alias("n_units"), F.max(F.struct("whole", "b")).alias("b"))
            .select("doc_id", "license", "n_units", "b.b.shared", F.col("b.b.unit_size").cast("long").alias("unit_size"),
                    F.col("b.b.template_size").cast("long").alias("template_size"), "b.b.dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(templates: list[tuple[str, str]] = TEMPLATES, percent: int = 80) -> str:
    """DuckDB SQL for the rows of :func:`scan_licenses`, by definition: every
    unit against every template, without bounds."""
    listed = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(templates))
    return f"""
WITH t AS (SELECT * FROM (VALUES {listed}) v(template, license, body)),
lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l,
    list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), lambda p: contains(trim(p), chr(10))) AS p
    FROM documents),
u AS (SELECT doc_id, generate_subscripts(list_concat(l, p), 1) - 1 AS unit, unnest(list_concat(l, p)) AS body FROM lined),
tw AS (SELECT template, license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
uw AS (SELECT doc_id, unit, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM u),
tg AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS g FROM
    (SELECT template, license, w, unnest(range(1, len(w))) AS i FROM tw)),
ug AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS g FROM
    (SELECT doc_id, unit, w, unnest(range(1, len(w))) AS i FROM uw)),
ts AS (SELECT template, count(*) AS template_size FROM tg GROUP BY 1),
us AS (SELECT doc_id, unit, count(*) AS unit_size FROM ug GROUP BY 1, 2),
m AS (SELECT doc_id, unit, template, license, count(*) AS shared FROM ug JOIN tg USING (g) GROUP BY 1, 2, 3, 4),
d AS (SELECT m.*, unit_size, template_size, shared * 2 / (unit_size + template_size)::DOUBLE AS dice
    FROM m JOIN ts USING (template) JOIN us USING (doc_id, unit)
    WHERE shared * 200 >= {percent} * (unit_size + template_size)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, template, unit) AS k FROM d),
n AS (SELECT doc_id, license, count(DISTINCT unit) AS n_units FROM d GROUP BY 1, 2)
SELECT doc_id, license, n_units, shared, unit_size, template_size, dice FROM r JOIN n USING (doc_id, license) WHERE k = 1"""
