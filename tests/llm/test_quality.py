"""Quality: features, fit and border against plain versions."""

import random
import re

import numpy as np
import pytest

from hiresift.llm import quality
from hiresift.llm.common import id_and_text


def plain_features(text):
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    count = lambda group: sum(data.count(bytes([b])) for b in group)
    letters = max(1, len(re.findall(rb"[A-Za-z\x80-\xff]", data)))
    shares = [count(g) / (letters if g[0] == 0x41 else max(1, len(data))) for g in quality._GROUPS]
    n, pairs = max(1, len(words)), list(zip(words, words[1:]))
    shares += [1 - len(set(words)) / n, sum(a == b for a, b in pairs) / n, 1 - len(set(pairs)) / n,
               sum(w[-1:] in (b"!", b"#", b"$", b"%", b"&", b"*", b"|") for w in words) / n,
               1 - len(set(lines)) / max(1, len(lines)), sum(w.isupper() for w in words) / n]
    return [*shares, *(x ** 0.5 for x in shares), np.log1p(len(words)), sum(map(len, words)) / n / 10, np.log1p(max(map(len, words), default=0))]


def test_features_equal_plain_counts():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Wort ", "WORT ", "é", "!", "#", " ", "\n", "1", "x x ", "|", "-"]) for _ in range(rng.randint(0, 60)))
        assert quality.features(text) == pytest.approx(plain_features(text))


def corpus(spark, n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = i % 3 != 0
        words = [rng.choice(["river", "stone", "light", "market", "winter"]) + str(rng.randrange(50)) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words) if good or rng.random() < 0.1 else "!!! BUY | NOW $$$ " * rng.randint(3, 9), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_border_is_the_quantile_of_all_labelled_documents(spark):
    rows, docs, labels = corpus(spark)
    # the fit sees 60 documents, the border all
    model = quality.train(docs, labels, sample_docs=60)
    raw = np.sort(model.raw(np.array([plain_features(t) for _, t, _ in rows])))
    bad = sum(1 for *_, q in rows if not q)
    below = int((raw < model.border).sum())
    ties = int((np.abs(raw - model.border) < (raw[-1] - raw[0]) / 10_000).sum())
    assert abs(below - bad) <= 1 + ties
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, t, _ in rows:
        want = 1 / (1 + np.exp(-np.clip(model.raw(np.array(plain_features(t)))[()] - model.border + np.log(quality.CUT / (1 - quality.CUT)), -30, 30)))
        assert scored[i].score == pytest.approx(want) and scored[i].predicted == int(scored[i].score >= quality.CUT)
    assert np.mean([scored[i].predicted == q for i, _, q in rows]) > 0.85


def test_fit_prefers_the_better_of_a_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, quality.WIDTH))
    wanted = rng.normal(size=quality.WIDTH)
    good = x @ wanted > 0
    model = quality.fit(x, good, float((~good).mean()), 20_000, ridge=1e-3)
    # plain gradient steps on the same loss reach no better value
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    d = z[good][:, None][:60] - z[~good][None][:, :60]
    loss = lambda w: np.log1p(np.exp(-np.clip(d.reshape(-1, quality.WIDTH) @ w, -30, 30))).mean()
    assert loss(model.weights) < loss(wanted) and loss(model.weights) < 0.1
    assert np.mean((model.score(x) >= quality.CUT) == good) > 0.97


def test_score_at_the_cut_is_accepted(spark):
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.zeros(quality.WIDTH), 0.0)
    row = quality.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).first()
    assert row.score == pytest.approx(quality.CUT) and row.predicted == int(row.score >= quality.CUT)
    assert id_and_text(spark.createDataFrame([(1, "x")], "doc_id long, text string"), carry=True).columns == ["doc_id", "row"]
