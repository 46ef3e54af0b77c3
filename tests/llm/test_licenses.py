"""Licence scan: wrapped headers, plain scoring and screening, odd texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hiresift.llm import licenses

GPL = """#!/bin/sh
#
# frobnicate - turn things over
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

echo done"""
MIT = """/*
 * Permission is hereby granted, free of charge, to any person
 * obtaining a copy of this software and associated
 * documentation files (the "Software"), to deal in it.
 */
int main() { return 0; }"""
APACHE = """// Licensed under the Apache License, Version 2.0
// (the "License"); you may not use this file except
// in compliance with the License."""
BSD = """; Redistribution and use in source and binary forms, with
; or without modification, are permitted provided that the
; following conditions are met:"""


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark)


def confirmed(rows):
    return {(r.doc_id, r.family) for r in rows if r.confirmed}


def test_single_lines_and_odd_rows(docs, model):
    notes = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    text = "\n".join(f"Some words of prose\n{n}\nmore of them" for n in notes)
    rows = licenses.scan(docs([(1, text), (1, text), (2, None), (3, ""), (None, "The licence plate of my car is dirty.")]), model).collect()
    assert [r.doc_id for r in rows] == [1] * 8 and all(r.confirmed and not r.wrapped and r.similarity == 1 for r in rows)
    assert sorted((r.paragraph, r.family, r.line) for r in rows) == sorted([(3 * i + 1, f, n) for i, (n, f) in enumerate(notes.items())] * 2)
    assert licenses.scan(docs([]), model).count() == 0


def test_wrapped_headers_are_confirmed(docs, model):
    found = licenses.scan(docs([(1, GPL), (2, MIT), (3, APACHE), (4, BSD), (5, GPL.replace("\n", "\r\n"))]), model).collect()
    assert confirmed(found) == {(1, "GPL"), (2, "MIT"), (3, "Apache-2.0"), (4, "BSD"), (5, "GPL")}
    # no line of this one holds half of the notice
    (bsd,) = [r for r in found if r.doc_id == 4 and r.confirmed]
    assert bsd.wrapped and bsd.paragraph == 0 and bsd.line.startswith("Redistribution and use") and ";" not in bsd.line
    assert all("#" not in r.line for r in found)


def test_notices_of_two_families_side_by_side(docs, model):
    text = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\n\n" + GPL
    assert confirmed(licenses.scan(docs([(1, text)]), model).collect()) == {(1, "Apache-2.0"), (1, "MIT"), (1, "GPL")}


def test_prose_and_very_long_texts(docs, model):
    rng = random.Random(4)
    prose = "\n".join(" ".join(rng.choice(["the", "tree", "terms", "copy", "of", "free", "river", "general", "public", "under"]) for _ in range(9)) for _ in range(3000))
    long = prose + "\n" + GPL + "\n" + prose
    rows = licenses.scan(docs([(1, prose), (2, long), (3, "license " * 20_000)]), model).collect()
    assert confirmed(rows) == {(2, "GPL")}
    assert all(3004 <= r.paragraph <= 3007 for r in rows if r.confirmed)


def test_key_words_are_in_whatever_could_be_confirmed():
    for share in (0.3, 0.5, 0.9):
        keys = set(licenses.key_words(share))
        for notice in (n for notices in licenses.NOTICES.values() for n in notices):
            pairs = set(zip(licenses.plain_words(notice), licenses.plain_words(notice)[1:]))
            without = [p for p in pairs if not keys & set(p)]
            assert len(without) < share * len(pairs) or all(w in licenses.COMMON for p in without for w in p)
        assert not keys & licenses.COMMON


def test_words_equal_the_plain_split(spark):
    texts = [n for notices in licenses.NOTICES.values() for n in notices] + licenses.OTHERS
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.words_of(F.col("t")).alias("w")).collect()
    assert all(r.w == licenses.plain_words(r.t) for r in rows)


def test_scores_equal_a_plain_sum(docs, model):
    """Probability, family and similarity of single lines, by loops over the model's numbers."""
    texts = [n for notices in licenses.NOTICES.values() for n in notices] + licenses.OTHERS + ["Licensed by nobody under version 2.0", "mit license?"]
    rows = licenses.scan(docs(list(enumerate(texts))), model).collect()
    got = {r.doc_id: r for r in rows if not r.wrapped}
    weights = {g: model.matrix[:, i] for i, g in enumerate(model.grams)}
    keys = set(licenses.key_words(0.5))
    pairs_of = lambda w: set(zip(w, w[1:]))
    for i, text in enumerate(texts):
        w = licenses.plain_words(re.sub(r"^[\s*#/;%!>|<-]+|[\s*#/|<>-]+$", "", text))
        grams = {" ".join(w[a:a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)}
        if not keys & set(w) or not grams & set(weights):
            assert i not in got
            continue
        z = [b + sum(weights[g][c] for g in grams if g in weights) for c, b in enumerate(model.intercepts)]
        if max(z[1:]) <= z[0]:
            assert i not in got
            continue
        odds = math.log(sum(math.exp(x) for x in z[1:])) - z[0]
        probability = 1 / (1 + math.exp(-(model.calibration[0] * odds + model.calibration[1])))
        best = model.classes[1 + max(range(len(z) - 1), key=lambda c: z[c + 1])]
        similarity = max(len(pairs_of(w) & pairs_of(t)) / max(1, len(pairs_of(t))) for t in map(licenses.plain_words, licenses.NOTICES[best]))
        assert got[i].probability == pytest.approx(probability) and got[i].similarity == pytest.approx(similarity)
        assert got[i].family == (best if probability >= 0.5 else "unknown")


def test_held_out_framings_are_told_apart(docs, model):
    notices = [(f, n) for f, ns in licenses.NOTICES.items() for n in ns]
    rows = licenses.scan(docs([(i, f"NB! {n} Thanks.") for i, (_, n) in enumerate(notices)] + [(1000 + i, f"NB! {t} Thanks.") for i, t in enumerate(licenses.OTHERS)]), model).collect()
    found = {r.doc_id: r.family for r in rows if r.confirmed and r.family != "unknown"}
    assert sum(found.get(i) == f for i, (f, _) in enumerate(notices)) >= 0.95 * len(notices)
    assert not any(i >= 1000 for i in found)


def test_notices_anywhere_in_a_run_of_lines(docs, model):
    """Runs that begin, end or go on with lines without a key word, notices amid prose lines, and two families in one stretch."""
    narrow = "\n".join(["# You should", "# have received", "# a copy", "# of the", "# GNU", "# General", "# Public", "# License", "# along with this", "# program."])
    prose = "the river runs by the old tree\nand we talked about the weather"
    amid = f"{prose}\nRedistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met\n{prose}"
    both = ("This program is free software: you can redistribute it\nand/or modify it under the terms of the\nGNU General Public License as published by the\nFree Software Foundation\n"
            "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met")
    far = f"Licensed under the BSD 3-Clause License.\n\n{prose}\n\n{BSD}"
    found = licenses.scan(docs([(1, narrow), (2, amid), (3, both), (4, far), (5, prose * 50)]), model).collect()
    assert confirmed(found) == {(1, "GPL"), (2, "BSD"), (3, "GPL"), (3, "BSD"), (4, "BSD")}
    (run,) = [r for r in found if r.doc_id == 2 and r.wrapped]
    assert run.paragraph == 2 and run.similarity == 1 and run.line.endswith("conditions are met")
    # a line that is confirmed does not hide a notice at another place of the text
    assert sorted((r.paragraph, r.wrapped) for r in found if r.doc_id == 4 and r.confirmed) == [(0, False), (5, True)]


def test_every_run_that_holds_enough_is_a_paragraph(docs):
    """Against all runs of short texts."""
    notices = licenses._pairs_of_notices()
    every = set().union(*notices)
    rng = random.Random(7)
    words = [w for x in sorted(every)[::9] for w in x] + ["river", "tree", ".", "+"]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(2, 9)):
            notice = rng.choice([n for ns in licenses.NOTICES.values() for n in ns]).split()
            a = rng.randrange(len(notice))
            lines.append(rng.choice([" ".join(notice[a:a + 6]), " ".join(rng.choices(words, k=3)), rng.choice(["", "."])]))
        texts.append(lines)
    got = {(r.doc_id, r.paragraph, r.last) for r in licenses._paragraphs(docs(list(enumerate(map("\n".join, texts)))), 0.5).collect()}
    for t, lines in enumerate(texts):
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                w = licenses.plain_words(" ".join(lines[i:j + 1]))
                held = set(zip(w, w[1:])) & every
                if "" in lines[i:j + 1]:
                    assert (t, i, j) not in got
                elif any(len(held & p) >= 0.5 * len(p) for p in notices):
                    # itself, or a run within it that holds the same pairs
                    inner = [licenses.plain_words(" ".join(lines[a:b + 1])) for d, a, b in got if d == t and i <= a and b <= j]
                    assert any(held <= set(zip(x, x[1:])) for x in inner), (lines, i, j)
                elif i < j:
                    assert (t, i, j) not in got
