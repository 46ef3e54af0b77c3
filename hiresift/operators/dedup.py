"""Duplicate removal: keep the first of two keys, keep the best of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.functions.text import dedup_key
from hiresift.session import cut

_KEY_PARTS = ["dkey.company", "dkey.title", "dkey.city"]


def with_key(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("dkey", dedup_key(F.col("company"), F.col("title"), F.col("location")))


def keep_first(rows: DataFrame, order: str = "id") -> DataFrame:
    """Arrival-order loop over two keys: a row goes if its job_id or its duplicate key was kept.

    Only keys travel through the loop. The rows are compared with the losers, usually few: then they stay where they are.
    """
    keys = with_key(rows).select(order, "job_id", "dkey")
    losers = cut(keys.select(order).join(first_of_two_keys(keys, order), order, "left_anti"))
    return rows.join(losers, order, "left_anti").select(*rows.columns)


def first_of_two_keys(keyed: DataFrame, order: str) -> DataFrame:
    """The order numbers that the loop keeps; needs order, job_id and dkey.

    A row that goes registers neither key, so one pass per key is not enough. Each round keeps
    the rows that come first under both of their keys and drops all that now collide with them;
    the loop ends when nothing is left. One or two rounds are usual.

    Only (order, job_id, key) travels through the rounds. Both minima are partial aggregates and
    meet on the unique order column, so no hot key is gathered in one task; the anti joins that
    remove the losers have one row per key on the right, where adaptive execution splits a hot
    key on the left. Rows without a duplicate key take no part in the join on it, and a row without
    a job_id has one of its own.
    """
    own = F.coalesce("job_id", F.concat(F.lit("\0"), F.col(order).cast("string")))
    # of equal (job_id, key) pairs only the earliest row can ever be kept
    open_rows = cut(
        keyed.groupBy(own.alias("job_id"), "dkey").agg(F.min(order).alias("seq"))
    )
    kept = None
    while not open_rows.isEmpty():
        by_id = open_rows.groupBy("job_id").agg(
            F.min(F.struct("seq", "dkey")).alias("w")
        ).select("job_id", "w.seq", "w.dkey")
        by_key = open_rows.where(F.col("dkey").isNotNull()).groupBy("dkey").agg(F.min("seq").alias("seq"))
        won = cut(
            by_id.where(F.col("dkey").isNull()).select("seq", "job_id", "dkey").unionByName(
                by_id.join(by_key.select("seq"), "seq", "left_semi").select("seq", "job_id", "dkey")
            )
        )
        kept = won if kept is None else kept.unionByName(won)
        left = open_rows.join(won.select("job_id"), "job_id", "left_anti")
        with_dkey = left.where(F.col("dkey").isNotNull())
        open_rows = cut(
            with_dkey.join(won.where(F.col("dkey").isNotNull()).select("dkey"), "dkey", "left_anti")
            .select("job_id", "dkey", "seq").unionByName(left.where(F.col("dkey").isNull()).select("job_id", "dkey", "seq"))
        )
    return (open_rows if kept is None else kept).select(F.col("seq").alias(order))


def keep_best(jobs: DataFrame) -> DataFrame:
    """Per duplicate key the row with the longest description, on a tie the smallest id.

    Rows without a key all stay. Per key and task one best row is kept before the shuffle, and only numbers and keys
    travel; the rows are compared with the losers, usually few.
    """
    keys = with_key(jobs).where(F.col("dkey").isNotNull()).select(
        "dkey", "id", F.length(F.coalesce(F.col("description"), F.lit(""))).alias("size"))
    return jobs.join(losers(keys), "id", "left_anti").select(*jobs.columns)


def losers(keys: DataFrame) -> DataFrame:
    """The ids that are not the best of their key; keys: dkey, id, size."""
    groups = keys.groupBy("dkey").agg(
        F.count("*").alias("n"), F.min_by("id", F.struct(-F.col("size"), F.col("id"))).alias("best")).where("n > 1")
    return keys.join(groups, "dkey").where("id <> best").select("id")


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """Duplicate keys that occur more than once, with the rows to delete."""
    groups = with_key(jobs).where(F.col("dkey").isNotNull()).groupBy("dkey").agg(F.count("*").alias("n"))
    return groups.where("n > 1").select(
        *_KEY_PARTS, F.col("n").alias("n_rows"), (F.col("n") - 1).alias("n_delete")
    )


def cleanup_report(jobs: DataFrame) -> DataFrame:
    """Total rows, duplicate groups, rows to delete: what a dry run prints."""
    groups = with_key(jobs).groupBy("dkey").agg(F.count("*").alias("n"))
    dup = F.col("dkey").isNotNull() & (F.col("n") > 1)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(dup).alias("n_groups"),
        F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), F.lit(0)).alias("n_delete"),
    )
