"""Stages on a small corpus, held against plain decisions."""

import random

import corpus_pipeline
from hiresift.llm import jaccard, queries
from hiresift.session import cut, work_path
from tests.llm.test_joins import plain_components

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["quality", "language", "duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF_DIR))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(before[i] == r for i, r in after.items())
        if name == "duplicates":
            want = plain_components([(i, r.text) for i, r in sorted(before.items())])
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            assert not any(t in r.text for t in items for r in after.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == set(before)
    assert len(pieces) == corpus_pipeline.run(spark, SF_DIR).count()


def test_odd_documents(spark):
    rng = random.Random(1)
    prose = " ".join(f"the w{rng.randrange(900)}" for _ in range(60))
    rows = [(1, prose, "en"), (2, prose, None), (2, prose, None), (None, prose + " more", "en"), (3, None, "en"), (4, "", None), (5, "12 34", "en")]
    docs = cut(spark.createDataFrame([(*r, "s", 1, "x") for r in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, row string"))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.language_stage(spark, docs, SF_DIR).collect()) == [0, 1, 2, 2]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.duplicate_stage(spark, docs, SF_DIR).collect()) == [0, 1, 3, 4, 5]
    assert corpus_pipeline.decontamination_stage(spark, docs, SF_DIR).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert jaccard.WORDS == 5 and work_path


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(2)
    base, other, third, own = (" ".join(f"{k}{rng.randrange(900)}" for _ in range(60)) for k in "abcd")
    rows = [(3, base, "x"), (3, base, "x"), (3, base, "x"), (8, base + " more", "x"), (None, other, "x"), (None, other, "x"),
            (None, other + " more", "x"), (5, third, "x"), (6, third, "x"), (6, own, "x"), (7, third, "y"), (5, third, None),
            (None, None, "x"), (None, None, "x"), (9, "", None), (9, "", None)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs, SF_DIR).collect()]
    assert sorted(x for x in kept if x[0] is not None and x[1]) == sorted([(3, base), (5, third), (6, own)])
    assert sum(t is not None and t.startswith(other) for _, t in kept) == 1
    assert kept.count((None, None)) == 2 and kept.count((9, "")) == 2 and len(kept) == 8


def test_columns_of_any_name_and_type_survive_the_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, {"a": 1}, 2, None), (1, text, {"a": 1}, 2, None), (2, text, {"a": 1}, 2, "y"), (3, "other words here", None, None, "z"), (4, None, {}, 1, None)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, `_text_hash` map<string,int>, `_row hash` int, `__at` string"))
    kept = corpus_pipeline.duplicate_stage(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_stages_hand_texts_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs, own = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.newSession()
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs.limit(0), SF_DIR)
        assert spark.conf.get(key) == "4m"
    own.conf.set(key, "9m")
    corpus_pipeline.packing_stage(own, own.read.parquet(f"{SF_DIR}/documents.parquet").limit(0), SF_DIR)
    assert own.conf.get(key) == "9m"
