"""Very long texts and ties through the operators, and the token queries against the plain tokenizer."""

import glob
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresift.llm import chat, host_rules, jaccard, language, queries, quality, rans, url_filter
from hiresift.llm.tokens import default_path
from hiresift.session import work_path

SF_DIR = "/root/testdata/sf0.001"
WORDS = 300_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(WORDS))


def test_long_texts_are_read_to_their_end(docs, long_text):
    near = long_text + " and one more word at the end"
    rows = {r.doc_id: r for r in jaccard.near_duplicates(docs([(5, long_text), (3, near), (4, long_text[:200])])).collect()}
    words = long_text.split()
    assert rows[5].n_shingles == len({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    assert (rows[5].component_id, rows[3].component_id, rows[4].component_id) == (3, 3, 4)

    repeated = "a b c " + long_text + " a b c"
    table = docs([(1, repeated)]).withColumn("source", F.lit("h"))
    (r,) = host_rules.judge(table).collect()
    w = repeated.split()
    places = {}
    for i, window in enumerate(zip(w, w[1:], w[2:])):
        places.setdefault(window, []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    assert r.n_words == WORDS + 6 and r.n_repeat_words == len(covered) >= 6 and not r.base_failed

    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.arange(quality.WIDTH) / 100, 0.0)
    (r,) = quality.score(docs([(1, long_text)]), model).collect()
    assert r.score == pytest.approx(float(model.score(np.array(quality.features(long_text)))))


def test_letters_at_the_end_of_a_long_text_count(spark, docs):
    model = language.train(spark.createDataFrame([("the and of it", "en"), ("le et la il", "fr")], "text string, lang string"))
    rows = {r.doc_id: r.lang_pred for r in language.identify(docs([(1, "²½ 12"), (2, "12 ² " * 50_000), (3, "12 ² " * 50_000 + "the"), (4, "½é")]), model).collect()}
    assert rows[1] == rows[2] == "und" and rows[3] in ("en", "fr") and rows[4] in ("en", "fr")


def test_every_label_of_the_sample_is_learned(spark):
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in "xyz"), f"l{i:03d}") for i in range(300)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.labels) == 300


def test_long_addresses(spark):
    pages = spark.createDataFrame([(1, "http://a.org/" + "x/" * 100_000 + "login"), (2, "http://" + "a." * 50_000 + "com/de/")], "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge(pages, queries.RULES).collect()}
    assert (rows[1].rule, rows[1].verdict) == ("org/", "allow") and (rows[2].rule, rows[2].verdict) == ("com/de/", "block")
    assert len(rows[1].path) == 200_006


def test_thousands_of_turns(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"<|end|> {i}") for i in range(1000)]
    read = chat.read_back(chat.format_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in read.turns] == [t[3] for t in turns] and read.replies == [t[3] for t in turns if t[2] == "assistant"]


def plain_ids():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(default_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_queries_equal_the_plain_tokenizer(spark):
    plain = plain_ids()
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in rows}

    start = 0
    files = {r.doc_id: r for r in queries.QUERIES["op9_token_files"](spark, SF_DIR).collect()}
    for i, _ in rows:
        own = [*ids[i], 2]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(own), crc(own))
        start += len(own)

    pieces = {}
    for r in queries.QUERIES["op1_packing"](spark, SF_DIR).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    sequences = {}
    for i, found in pieces.items():
        own, at = [*ids[i], 0], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == crc(own[at:at + r.length])
            at += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(own)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_a_lost_token_file_is_an_error(spark):
    folder = rans.write_tokens(spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(4), work_path(spark, "tokens"), segment=2000)
    assert rans.read_tokens(spark, folder).count() == 200
    kept = spark.read.parquet(folder)
    part = work_path(spark, "tokens")
    kept.filter("segment > 0 or part > 0").write.parquet(part)
    spark.read.json(f"{folder}/{rans.MANIFEST}").write.json(f"{part}/{rans.MANIFEST}")
    assert glob.glob(f"{part}/*.parquet") and os.path.isdir(f"{part}/{rans.MANIFEST}")
    with pytest.raises(ValueError, match="not whole"):
        rans.read_tokens(spark, part)
