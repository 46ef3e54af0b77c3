"""Chunks of texts: whatever their size, predictions are those of a plain loop, and few rows are written."""

import random

import pytest
from pyspark.sql import functions as F

from hiresift.functions.text import words_and_hyphens
from hiresift.operators import chunks, evaluate, nb
from tests.test_operators import PlainNB


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(7 * i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 60]))), rng.choice(["x", "y", "z"])) for i in range(150)]
    return [(0, "w0 w1", "x"), *((i, None if i % 35 == 0 else t, c) for i, t, c in rows[1:])]


@pytest.mark.parametrize("size", [1, 90, 10 ** 6])
def test_test_then_train_in_chunks_of_any_size(spark, texts, size):
    df = spark.createDataFrame(texts, "id long, text string, label string")
    got = {r.id: r.predicted for r in nb.prequential(df, F.coalesce("text", F.lit("")), F.col("label"), ["x", "y", "z"], chunk_tokens=size).collect()}
    plain = PlainNB()
    for i, text, label in texts:
        assert got[i] == plain.predict((text or "").split()), i
        plain.learn((text or "").split(), label)


def test_a_chunk_has_one_row_for_each_different_token(spark):
    df = spark.createDataFrame([(i, "alpha beta alpha gamma", "x" if i % 2 else None) for i in range(400)], "id long, text string, label string").coalesce(1)
    words = nb.tokenised(df, F.col("text"), F.col("label"))
    assert chunks.tokens_of(words).count() == 3 and chunks.texts_of(words).count() == 1
    tokens, labels = nb.counts_of(words)
    assert {(r.token, r.label, r.n) for r in tokens.collect()} == {
        (t, c, n) for t, n in (("alpha", 400), ("beta", 200), ("gamma", 200)) for c in ("x", None)}
    assert {tuple(r) for r in labels.collect()} == {("x", 200, 800), (None, 200, 800)}


def test_tokens_are_those_of_the_column_function(spark):
    rows = [(i, t) for i, t in enumerate(["Grüße, naïve Café -- co-op e-mail_x a-", "日本語 テキスト x² Ⅳ½ ß_ŁÓDŹ", "a b cc d-d -e- f--g", "", "x\u0301yz \u0130stanbul ﬁne"])]
    df = spark.createDataFrame(rows, "id long, text string")
    words = nb.tokenised(df, F.col("text"), F.lit("x"))
    got = {(r.token, r.n) for r in nb.counts_of(words)[0].collect()}
    exploded = df.select(F.explode(words_and_hyphens(F.col("text"))).alias("token")).groupBy("token").count()
    assert got == {tuple(r) for r in exploded.collect()} and got


def test_evaluation_in_chunks_of_any_size(spark, texts):
    df = spark.createDataFrame(texts, "id long, text string, label string").withColumn("title", F.concat(F.lit("w1 new"), F.col("id").cast("string")))
    parts = {"title": F.col("title"), "text": F.col("text")}
    inputs = {"both": ["title", "text"], "text": ["text"]}
    got = [{(r.input, r.seed, r.id): (r.label, r.predicted, r.majority) for r in evaluate.evaluate(
        df, parts, inputs, F.col("label"), ["x", "y", "z"], chunk_tokens=size).collect()} for size in (40, 10 ** 6)]
    assert got[0] == got[1]
    test = {(r.seed, r.id) for r in evaluate.stratified_split(df.select("id", "label")).collect()}
    assert {k[1:] for k in got[0]} == test and len(got[0]) == 2 * len(test)
    for seed in range(5):
        for name in inputs:
            plain = PlainNB()
            words = {i: [*(["w1", f"new{i}"] if name == "both" else []), *(t or "").split()] for i, t, _ in texts}
            for i, _, c in texts:
                if (seed, i) not in test:
                    plain.learn(words[i], c)
            assert all(got[0][name, seed, i][1] == plain.predict(words[i]) for s, i in test if s == seed)
