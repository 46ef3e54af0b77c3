"""Corpus pipeline: quality, language, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Each
result is written as Parquet and read again, which cuts the lineage; a stage that is run again gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm import decontam, jaccard, language, quality
from hiresift.llm.queries import packed_pieces, quality_model, shipped
from hiresift.session import cut, forget, scope, small_batches

SURE = 0.2


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with its texts in small Arrow batches, as executors keep the workers and buffers of all stages."""
    @wraps(stage)
    def run(spark: SparkSession, *args) -> DataFrame:
        small_batches(spark)
        return stage(spark, *args)
    return run


@lean
@shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, carry=True).filter("predicted = 1").select("row.*")


@lean
@shipped
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not 'und', and a score of SURE or more."""
    model = language.train(docs)
    found = language.identify(docs, model, carry=True)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select("row.*")


@lean
@shipped
def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (``jaccard.without_repeats``)."""
    return jaccard.without_repeats(docs)


@lean
@shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.filter("not contaminated").select("row.*")


@lean
@shipped
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences."""
    return packed_pieces(docs)


STAGES = [
    ("quality", quality_stage), ("language", language_stage), ("duplicates", duplicate_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]

# Trained models, hashed walks and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        # the tables that a stage wrote for itself, and its input, go when its result is written
        with scope(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir)))
        if before:
            forget(spark, before)
        before = docs.cut_path
    return STAGES[-1][1](spark, docs, sf_dir)
