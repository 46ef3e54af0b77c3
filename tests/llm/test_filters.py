import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresift.llm import chat, host_rules, language, licenses, quality, queries, url_filter

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rules_equal_trying_all(spark):
    rng = random.Random(2)
    rules = queries.RULES + tuple(url_filter.Rule("block", p) for p in ("*x1*", "/a^b", "|m.", "z|", "q*z^"))
    urls = [None, "", "nothing", "://", "http://ORG", "http://a.org/", "http://org/", "x://example.org/en/12?q#f", "http://com/fr/x",
            "ftp://h.example.org/es/\n?", "//example.com/de/"]
    urls += ["http://" + ".".join(rng.choices(["m", "a", "org", "com", "example", "x1"], k=rng.randint(1, 3)))
             + "".join(rng.choices(["/", "fr/", "/de/", "a", "-", "b", "z", "en/1", "?", "#", "login", "q"], k=rng.randint(0, 6))) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    index = {"": list(range(len(rules)))}
    for r in url_filter.judge(pages.union(pages.limit(3)), rules).collect():
        assert (r.rule, r.verdict, r.pattern) == url_filter.verdict_of(r.host + r.path, rules, index)[:3]
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_contract_rules(spark):
    want = [("http://a.Example.ORG/en/1x", "example.org/en/1", "block"), ("http://example.org/es", "org/", "allow"),
            ("http://example.org/es/", "example.org/es/", "block"), ("http://notorg/", None, "allow"), ("http://x.com/de/1", "com/de/", "block")]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    rows = url_filter.judge(pages, queries.RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [(a, b) for _, a, b in want]


def test_languages_of_held_out_texts(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_language"](spark, SF_DIR).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97


def test_odd_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "12 -- 3"), (None, "hello"), (4, "hello"), (4, "hello")]
    found = language.identify(docs(rows), None).collect()
    assert {r.lang_pred for r in found} == {"und"} and len(found) == 6
    model = language.train(spark.createDataFrame([("the and", "en"), ("le et", "fr"), (None, "xx"), ("x", None)], "text string, lang string"))
    found = language.identify(docs(rows), model, carry=True).collect()
    assert [r.lang_pred for r in found][:3] == ["und"] * 3 and all(0 <= r.score <= 1 and r.row.score == 0.5 for r in found)
    assert language.train(spark.createDataFrame([], "text string, lang string")) is None
    scored = quality.score(docs(rows), None).collect()
    assert {r.predicted for r in scored} == {1} and len(scored) == 6
    assert quality.score(docs([]), None).count() == 0


def test_kernel_scores_equal_the_long_way():
    texts = [f"{'the of and in' if i % 2 else 'le la et dans'} w{i}x" for i in range(20)]
    x = language.presence(texts).astype(float)
    unit = x / np.sqrt(x.sum(1, keepdims=True))
    model = language.fit(np.packbits(x > 0, axis=1), ["en" if i % 2 else "fr" for i in range(20)], 8, 1e-3, 3)
    z = unit[np.linspace(0, 19, 8).astype(int)]
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = unit @ z.T @ root
    y = np.array([[float(n == ("en" if i % 2 else "fr")) for n in model.labels] for i in range(20)])
    w = np.linalg.solve(phi.T @ phi + 0.02 * np.eye(good.sum()), phi.T @ y)
    np.testing.assert_allclose(unit @ model.weights, phi @ w, atol=1e-4)


def test_quality_of_held_out_texts(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op8_quality"](spark, SF_DIR).collect() if r.held_out and r.doc_id in marks]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == marks[r.doc_id] for r in rows]) > 0.95


def plain_counts(text):
    w = WORD.findall(text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a a a", "a b c a b c", "É#\u00a0x <|>\n\na\n a\na", "x y z w x y z"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, f"h{i % 3}" if i % 4 else None, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string, host string")
    got = {r.doc_id: r for r in host_rules.judge(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert host_rules.judge(rows.limit(0)).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "x"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(100)] + [(100 + i, bad if i % 10 else good, "spam") for i in range(100)]
    rows += [(300, good, None), (300, good, None)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept == (not r.base_failed) for r in got if r.source != "spam") and not any(r.kept for r in got if r.source == "spam")
    assert len(got) == 202


def test_chat_reads_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|end|>", "<\\\\|x", "a\nb", "", None, "[/INST]<s>", "<|turn|>user\nhi<|end|>\n", "\\b\\n"]
    roles = ["user", "assistant", "system", "a\nb\\n", "<|end|>", None]
    rng = random.Random(6)
    rows = [(c if c else None, t, rng.choice(roles), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 6))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_examples(table)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [tuple(t) for t in got[c].turns] == turns
        assert list(got[c].replies) == [t for role, t in turns if role == "assistant"]
    for e in examples.filter(F.col("loss_start").isNotNull()).collect():
        assert e.text[e.loss_start + e.loss_chars:] == chat.CLOSE + "\n"
    assert chat.format_examples(table.limit(0)).count() == 0


def test_chat_query(spark):
    rows = {r.conv_id: r for r in queries.QUERIES["op7_chat_format"](spark, SF_DIR).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].n_turns == 2 and rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
