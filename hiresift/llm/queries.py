"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm import (
    chat, clusters, decontam, host_rules, jaccard, language, licenses, negatives, packing, pii, quality, rans, url_filter,
)
from hiresift.llm.common import id_crc, ship
from hiresift.llm.oracles import ORACLES
from hiresift.llm.rules import RULES

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).drop("n_tried")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(F.coalesce(id_crc() % 4, F.lit(0)) != 2))
    return language.identify(docs, model).withColumn("held_out", F.coalesce(id_crc() % 4 == 2, F.lit(False)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.train(spark))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    read = chat.read_back(chat.format_examples(turns.unionByName(more)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, _table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", F.coalesce(id_crc() % 5 == 0, F.lit(False)))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model | None:
    return quality.train(docs, labels.filter(id_crc() % 5 != 0))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rans.read_tokens(spark, rans.write_tokens(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("base_spans")


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query or stage, with the package sent to the executors first."""
    @wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)
    return run


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: shipped(f) for f in (
    op1_packing, op2_url_filter, op3_language, op4_decontamination, op5_license_scan, op6_jaccard_join,
    op7_chat_format, op8_quality, op9_token_files, op10_host_rules, op11_hard_negatives, op12_clusters, op13_pii)}
