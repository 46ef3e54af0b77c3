"""Licence scan: a trained paragraph classifier with an unknown class and a comparison with templates.

Paragraphs are lines, and runs of lines that stand together: a notice that is wrapped over lines is read as one, without
the comment signs at their edges. A line takes part where it holds a key word (``key_words``: a word of the notices that plain prose
seldom has) or enough of a notice's word pairs, a run, wherever it begins and ends, where it holds enough of them.

Paragraphs are scored by a multinomial logistic regression on word n-grams, which is trained
on the notices below and on lines that are none. Only n-grams of its vocabulary have a weight, so
scoring is a join of a paragraph's n-grams with a table of bounded size and a sum. The odds of a licence are calibrated on held-out
lines (Platt scaling); a paragraph that is more likely none is of the unknown class, and a prediction
counts when the paragraph shares enough word pairs with a notice of the family. Built-in expressions only.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hiresift.dims import STOP_WORDS
from hiresift.functions.text import let, str_array
from hiresift.session import cut

UNKNOWN = "unknown"
# Usual notices of well-known licences.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC BY-SA 4.0 unless otherwise noted.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
}
# Lines that talk of licences and terms without granting one, and plain prose.
OTHERS = [
    "The driver lost the licence after the accident.", "A fishing license costs ten euros at the office.",
    "Please read the terms of use before you sign up.", "All rights reserved.", "Version 2.0 was released in May.",
    "The general public is welcome at the free concert.", "This work was done under the supervision of the board.",
    "She studied at MIT before she joined the company.", "The Apache helicopter landed at noon.",
    "Permission was granted to leave the room.", "The software is free of charge for students.",
    "He was licensed to practise medicine in 1999.", "Released under the bridge, the fish swam away.",
    "The files were copied to the new disk.", "The terms of the contract are as follows.",
    "This file is part of the annual report.", "Common creatures of the forest", "Use in source form is not common here.",
    "The quick brown fox jumps over the lazy dog.", "Der Vertrag steht unter keiner Lizenz.", "Le texte est sous presse.",
    "We met under the old tree and talked about the weather.", "The licence plate was stolen last night.",
]
FIXES = ["{}", "# {}", "// {}", "{} All rights reserved.", "Copyright 2024 Example. {}", "Note: {}"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.](?=\s|$)", " "), " +"), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    n = F.size(words)
    joined = F.transform(F.sequence(F.lit(0), n - size),
                         lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, joined).otherwise(F.array().cast("array<string>"))


def grams_of(words: Column) -> Column:
    """Words, word pairs and word triples of an array of words."""
    return F.concat(words, _grams(words, 2), _grams(words, 3))


class Model:
    """Small tables: weights (gram, class, weight), classes with their intercepts, and the calibration (slope, shift) of the log odds."""

    def __init__(self, classes: list[str], intercepts: list[float], grams: list[str], matrix, calibration: tuple[float, float]):
        self.classes, self.intercepts, self.grams, self.matrix, self.calibration = classes, intercepts, grams, matrix, calibration


def train(spark: SparkSession, vocabulary: int = 4000, l2: float = 0.001) -> Model:
    """Fit on notices and other lines in several framings; every third framing is held out and calibrates the odds of a licence."""
    classes = [UNKNOWN, *NOTICES]
    lines = [(float(classes.index(f)), text) for f, notices in NOTICES.items() for text in notices]
    lines += [(0.0, text) for text in OTHERS]
    rows = [(y, fix.format(text), i % 3 == 2) for y, text in lines for i, fix in enumerate(FIXES)]
    # Beginnings of notices that name no family belong to no family.
    rows += [(0.0, text, False) for text in ("Licensed under the", "This work is licensed under the", "Released under the",
                                             "License, version", "Version 2.0", "4.0", "Copyright 2024 Example.", "Note:")]
    values = ", ".join(f"({y}D, '{_quoted(t)}', {str(h).lower()})" for y, t, h in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(label, line, held)")
    table = table.withColumn("grams", grams_of(words_of(F.col("line"))))
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, binary=True)
    counted = counter.fit(table)
    vectors = counted.transform(table)
    fitted = LogisticRegression(regParam=l2, maxIter=200, family="multinomial").fit(vectors.filter(~F.col("held")))
    odds = fitted.transform(vectors.filter("held")).select(
        (F.col("label") > 0).cast("double").alias("label"),
        vector_to_array("probability")[0].alias("p")).select("label", array_to_vector(F.array(F.ln((1 - F.col("p")) / F.col("p")))).alias("features"))
    platt = LogisticRegression(regParam=0.01, maxIter=100).fit(odds)
    return Model(classes, [float(x) for x in fitted.interceptVector], list(counted.vocabulary),
                 fitted.coefficientMatrix.toArray(), (float(platt.coefficients[0]), float(platt.intercept)))


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def plain_words(text: str) -> list[str]:
    """``words_of`` for one of our own notices."""
    return [w for w in re.sub(r"[^\w.+-]+|[.](?=\s|$)", " ", text.lower()).replace("_", " ").split(" ") if w]


def _texts_with(texts: list[str]) -> Counter:
    return Counter(w for t in texts for w in set(plain_words(t)))


# Words that tell nothing about licences: stop words, words that the other lines use as often as the notices, and "mit",
# the German "with".
_USED = _texts_with([n for notices in NOTICES.values() for n in notices])
COMMON = frozenset(STOP_WORDS) | {w for w, n in _texts_with(OTHERS).items() if n >= _USED[w]} | {"mit"}


def key_words(confirm: float) -> list[str]:
    """Words of notices that plain prose seldom has, so many that a paragraph without one cannot hold the share ``confirm`` of a
    notice's word pairs, or only such pairs as consist of common words ("released under the").

    Words of the most notices come first.
    """
    pairs = _pairs_of_notices()
    keys: set[str] = set()
    while True:
        left = [(p, [x for x in p if not keys & set(x)]) for p in pairs]
        uses = Counter(w for p, without in left if len(without) >= confirm * len(p) for w in {w for x in without for w in x} - COMMON)
        if not uses:
            return sorted(keys)
        keys.add(min(uses, key=lambda w: (-uses[w], w)))


def common_pairs(confirm: float) -> set[tuple[str, str]]:
    """The word pairs of common words by which a paragraph without a key word could hold the share ``confirm`` of a notice."""
    keys = set(key_words(confirm))
    left = [(p, {x for x in p if not keys & set(x)}) for p in _pairs_of_notices()]
    return {x for p, without in left if len(without) >= confirm * len(p) for x in without}


def _pairs_of_notices() -> list[set[tuple[str, str]]]:
    return [set(zip(w, w[1:])) for notices in NOTICES.values() for w in map(plain_words, notices)]


_EDGES = r"^[\s*#/;%!>|<-]+|[\s*#/|<>-]+$"


def _texts_of(pairs: set[tuple[str, str]]) -> Column:
    return str_array(sorted(" ".join(x) for x in pairs))


def holds_enough(pairs: Column, confirm: float) -> Column:
    """Whether the word pairs are the share ``confirm`` of some notice's."""
    notices = _pairs_of_notices()

    def of_some(held: Column) -> Column:
        return reduce(lambda x, y: x | y, [F.size(F.array_intersect(held, _texts_of(p))) >= confirm * len(p) for p in notices])

    held = F.array_intersect(pairs, _texts_of(set().union(*notices)))
    return F.when(F.size(held) > 0, let(held, of_some)).otherwise(F.lit(False))


def may_hold_notice(text: Column, confirm: float) -> Column:
    """Whether a text has a key word or a pair of ``common_pairs``, also across a line break; others hold no paragraph."""
    return F.regexp_like(F.lower(text), F.lit("|".join([_key_pattern(confirm), *(
        rf"(?<![\p{{L}}\p{{N}}]){re.escape(a)}[^\p{{L}}\p{{N}}]+{re.escape(b)}(?![\p{{L}}\p{{N}}])" for a, b in sorted(common_pairs(confirm)))])))


def _key_pattern(confirm: float) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, sorted(key_words(confirm), key=len, reverse=True)))})(?![\p{{L}}\p{{N}}])"


def paragraphs_of(text: Column, confirm: float) -> Column:
    """An array of (paragraph, last, hot, line): the numbers of the first and last line, whether a line has a key word, and the text.

    They are all lines, and all runs of two or more lines, none blank, that can hold a notice: a run begins and ends at any line that has a
    word pair of a notice in it, or one across the break that it adds. All but the last line of a run have fewer words (one at least for a line)
    than two of the longest notices; a stretch without a blank line is a run as a whole as well. Row by row, without a shuffle.
    """
    notices = _pairs_of_notices()
    span, known = 2 * max(map(len, notices)), _texts_of(set().union(*notices))
    clean = F.transform(F.split(F.translate(text, "\x1c\x1d\x1e", "   "), "\n"), lambda x: F.regexp_replace(x, _EDGES, ""))
    split = F.transform(clean, lambda x: F.struct(x.alias("x"), words_of(x).alias("w")))

    def marked(lines: Column) -> Column:
        def mark(line: Column, i: Column) -> Column:
            after = F.get(lines, i + 1)["w"]
            # a line without words carries the pair across on to the next one
            open_ = (F.size(line["w"]) == 0) | (F.size(after) == 0) | F.array_contains(
                known, F.concat_ws(" ", F.element_at(line["w"], -1), F.get(after, F.lit(0))))
            return F.struct(line["x"].alias("x"), F.greatest(F.size(line["w"]), F.lit(1)).alias("n"),
                            F.arrays_overlap(_grams(line["w"], 2), known).alias("inside"), F.coalesce(open_, F.lit(False)).alias("open"))
        return F.transform(lines, mark)

    def at(lines: Column) -> Column:
        hot = lambda x: F.regexp_like(F.lower(x), F.lit(_key_pattern(confirm)))
        single = F.transform(lines, lambda m, i: F.struct(
            i.cast("long").alias("paragraph"), i.cast("long").alias("last"), hot(m["x"]).alias("hot"), m["x"].alias("line")))
        begins = F.filter(F.transform(lines, lambda m, i: F.when((m["x"] != "") & (m["inside"] | m["open"]), i)), lambda i: i.isNotNull())

        def from_(i: Column) -> Column:
            def ends(near: Column) -> Column:
                def fits(k: Column) -> Column:
                    upto = F.slice(near, 1, k)
                    return ((F.get(near, k)["inside"] | F.get(near, k - 1)["open"]) & (F.get(near, k)["x"] != "") & ~F.exists(upto, lambda m: m["x"] == "")
                            & (F.aggregate(upto, F.lit(0), lambda n, m: n + m["n"]) < span))
                places = F.filter(F.when(F.size(near) > 1, F.sequence(F.lit(1), F.size(near) - 1)).otherwise(F.array().cast("array<int>")), fits)
                return F.transform(places, lambda k: F.struct(
                    i.cast("long").alias("paragraph"), (i + k).cast("long").alias("last"), F.lit(False).alias("hot"),
                    F.array_join(F.transform(F.slice(near, 1, k + 1), lambda m: m["x"]), " ").alias("line")))
            return let(F.slice(lines, i + 1, span + 1), ends)

        # whole stretches: the text is split at its blank lines
        joined = F.array_join(F.transform(lines, lambda m, i: F.when(
            m["x"] != "", F.concat(F.lit("\x1d"), i.cast("string"), F.lit("\x1d"), m["x"], F.lit("\x1c"))).otherwise(F.lit("\x1e"))), "")
        count = lambda r: F.length(F.regexp_replace(r, "[^\x1c]", "")).cast("long")
        first = lambda r: F.regexp_extract(r, "^\x1d(\\d+)", 1).cast("long")
        whole = F.transform(F.filter(F.split(joined, "\x1e"), lambda r: count(r) > 1), lambda r: F.struct(
            first(r).alias("paragraph"), (first(r) + count(r) - 1).alias("last"), F.lit(False).alias("hot"),
            F.trim(F.regexp_replace(r, "\x1d\\d+\x1d|\x1c", " ")).alias("line")))
        return F.concat(F.filter(single, lambda r: r["line"] != ""), F.flatten(F.transform(begins, from_)), whole)

    return let(let(split, marked), at)


def _paragraphs(docs: DataFrame, confirm: float) -> DataFrame:
    """doc_id, row, paragraph, last, wrapped, line: the lines with a key word, and the lines and runs that hold enough of a notice."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    found = chosen.filter(may_hold_notice(F.col("text"), confirm)).select("doc_id", "row", F.explode(paragraphs_of(F.col("text"), confirm)).alias("p"))
    rows = found.select("doc_id", "row", "p.*")
    # the words are bound: split once, not for each pair
    kept = rows.filter(F.col("hot") | let(words_of(F.col("line")), lambda w: holds_enough(_grams(w, 2), confirm)))
    return kept.select("doc_id", "row", "paragraph", "last", (F.col("paragraph") < F.col("last")).alias("wrapped"), "line")


def scan(docs: DataFrame, model: Model, confirm: float = 0.5) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (number of its first line, from 0), wrapped, family, probability, similarity, confirmed, line.

    A paragraph is a line of the text, or a run of lines (``paragraphs_of``; wrapped); a run gives no row where one of its own lines is confirmed in
    the run's family, and of overlapping runs of a family the most similar one does. family is the licence class of highest score if the calibrated probability of a licence is one half or more,
    else 'unknown' (equal scores: the class that is listed first); paragraphs whose best class is no licence give no row. similarity is the largest share of a notice's
    word pairs that the paragraph holds, and confirmed says that it reaches confirm. Null and empty texts have no
    paragraphs; of a very long text each paragraph is scored on its own. Repeated rows give repeated result rows, null ids stay null, and extra columns are not read. The weights
    are broadcast: at most vocabulary times classes numbers.
    """
    spark = docs.sparkSession
    # few rows are left here; they are written, so that their numbers stay what they are (a stretch as a whole may be one of the runs as well)
    lines = cut(_paragraphs(docs, confirm).dropDuplicates(["row", "paragraph", "last"]))
    scored = lines.withColumn("words", words_of(F.col("line")))
    classes = len(model.classes)
    # One row for each gram with its weights as an array; a line's grams that have no weight drop out in the join.
    weights = spark.createDataFrame(
        [(g, [float(x) for x in model.matrix[:, i]]) for i, g in enumerate(model.grams)], "gram string, w array<double>")
    key = ["row", "paragraph", "last"]
    grams = scored.select(*key, F.explode(F.array_distinct(grams_of(F.col("words")))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(*[
        (F.sum(F.get("w", F.lit(c))) + model.intercepts[c]).alias(f"z{c}") for c in range(classes)])
    z = [F.col(f"z{c}") for c in range(classes)]
    top = F.greatest(*z[1:])
    odds = top + F.ln(reduce(lambda a, b: a + b, [F.exp(x - top) for x in z[1:]])) - z[0]
    slope, shift = model.calibration
    best = F.coalesce(*[F.when(x == top, F.lit(name)) for x, name in zip(z[1:], model.classes[1:])])
    judged = sums.filter(top > z[0]).select(*key, best.alias("best"), (1 / (1 + F.exp(-(slope * odds + shift)))).alias("probability"))
    judged = scored.join(judged, key).withColumn("pairs", F.array_distinct(_grams(F.col("words"), 2)))
    similarity = F.lit(0.0)
    for family, notices in NOTICES.items():
        each = []
        for notice in notices:
            template = F.array_distinct(_grams(words_of(F.lit(notice)), 2))
            each.append(F.size(F.array_intersect("pairs", template)) / F.greatest(F.size(template), F.lit(1)))
        similarity = F.when(F.col("best") == family, F.greatest(*each)).otherwise(similarity)
    judged = judged.withColumn("similarity", similarity).withColumn("confirmed", F.col("similarity") >= confirm)
    lines, runs = judged.filter("not wrapped"), judged.filter("wrapped and confirmed")
    # a run says nothing new where a line of its own is confirmed in its family
    own = lines.filter("confirmed").select("row", "best", F.col("paragraph").alias("alone"))
    runs = runs.join(own, (runs["row"] == own["row"]) & (runs["best"] == own["best"]) & own["alone"].between(runs["paragraph"], runs["last"]), "left_anti")
    # of runs that overlap the most similar one stays, then the shortest, then the first
    order = Window.partitionBy("row", "best").orderBy("paragraph", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(reach >= F.col("paragraph"), 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    first = Window.partitionBy("row", "best", "group").orderBy(F.desc("similarity"), F.col("last") - F.col("paragraph"), "paragraph")
    runs = runs.withColumn("place", F.row_number().over(first)).filter("place = 1")
    judged = lines.unionByName(runs.select(*lines.columns))
    return judged.select(
        "doc_id", "paragraph", "wrapped", F.when(F.col("probability") >= 0.5, F.col("best")).otherwise(UNKNOWN).alias("family"),
        "probability", "similarity", "confirmed", "line")
