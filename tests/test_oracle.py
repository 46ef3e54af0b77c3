"""Spark against DuckDB on the smallest tables, for queries of every kind."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "flatten_feed_a", "flatten_feed_c", "feed_rejects", "ingest_append", "preprocess_jobs", "filter_location_country", "browse_jobs",
    "clean_text", "dedup_key", "extract_skills", "split_required_nice", "resume_record", "text_claim_flags",
    "match_top_jobs", "match_report", "nice_split_rate", "sidebar_stats", "low_card_profile", "location_coverage",
    "data_health", "dedup_keep_best", "drift_report", "tfidf_weights", "feature_table", "stream_nb_update", "stream_ingest",
    "dedup_cleanup_apply", "feature_transform", "class_report", "run_history", "encoding_check", "stream_drift",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    problem, *_ = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
