"""An index of the keys that a postings table holds, read by bucket.

For every stored posting the index has its job_id and its duplicate key, folded once when the posting was stored. Rows
are dealt into buckets by a hash of the key, each bucket is a folder, and a batch reads only the folders that
its own keys fall into: descriptions are never read, nothing is folded again, and a small batch opens few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
SCHEMA = "hash long, key string, id long, size long, bucket int"


def key_of(kind: str) -> Column:
    """The key of kind "job" or "dup" of postings with job_id and dkey, as one text; folded parts hold no line breaks."""
    if kind == "job":
        return F.col("job_id")
    return F.when(F.col("dkey").isNotNull(), F.concat_ws("\n", "dkey.company", "dkey.title", "dkey.city"))


def _dealt(key: Column, buckets: int) -> list[Column]:
    """hash and bucket of a key; null for a null key."""
    hash_ = F.when(key.isNotNull(), F.xxhash64(key))
    return [hash_.alias("_hash"), key.alias("_key"), F.pmod(hash_, F.lit(buckets)).cast("int").alias("_bucket")]


def size_of(description: Column) -> Column:
    return F.length(F.coalesce(description, F.lit(""))).cast("long")


def index_rows(keyed: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Entries for postings with id, job_id, dkey and size; rows without the key have none."""
    rows = keyed.select(*_dealt(key_of(kind), buckets), "id", "size").where("_key is not null")
    return laid_out(rows.select(F.col("_hash").alias("hash"), F.col("_key").alias("key"), "id", "size", F.col("_bucket").alias("bucket")))


def laid_out(entries: DataFrame) -> DataFrame:
    """One file for each bucket, sorted by hash."""
    return entries.repartition("bucket").sortWithinPartitions("bucket", "hash")


def unknown(batch: DataFrame, kind: str, index: DataFrame, buckets: int) -> DataFrame:
    """Rows of the batch (job_id, dkey) whose key the index does not hold; a null key is never held.

    The numbers of the touched buckets come to the driver (at most ``buckets``), so that the others' files are not opened. Rows
    without a key do not take part in the join, so they meet in no task.
    """
    rows = batch.select("*", *_dealt(key_of(kind), buckets))
    touched = sorted(r[0] for r in rows.select("_bucket").where("_bucket is not null").distinct().collect())
    known = index.where(F.col("bucket").isin(touched)).select(*[F.col(c).alias(f"_{c}") for c in ("hash", "key", "bucket")])
    left = rows.where("_key is not null").join(known, ["_bucket", "_hash", "_key"], "left_anti")
    return left.select(*batch.columns).unionByName(rows.where("_key is null").select(*batch.columns))
