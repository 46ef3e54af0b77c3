"""Incremental ingest, model update and drift check.

Each stream publishes the result of a batch as a new version, together with the batch's number under the id that the stream's
checkpoint keeps. A batch that is replayed after a failure changes nothing. Ingest compares with all stored keys, so a stream with a
new checkpoint goes on from what is stored. Training and drift only hold counts and cannot tell old rows from new ones: they refuse
another stream unless they are told that its rows are new.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.dims import DEFAULT, Dims
from hiresift.operators import drift, nb
from hiresift.sources import feeds
from hiresift.sources.versions import Versions
from hiresift.streaming.postings import PostingTable


def landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of postings in landed JSON files; ``id`` is the arrival number."""
    reader = spark.readStream.schema(S.JOBS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def run(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, str, int], None]) -> str:
    """Take in all that has landed: work(batch, id of the stream, batch number). Returns the id, which the checkpoint keeps."""
    started, name = threading.Event(), []

    def batch(rows: DataFrame, number: int) -> None:
        started.wait()
        work(rows, name[0], number)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    name.append(str(query.id))
    started.set()
    query.awaitTermination()
    return name[0]


def first_or_known(content: dict, stream: str, another: bool) -> None:
    seen = content.get("seen", {})
    if seen and stream not in seen and not another:
        raise ValueError("batches of another checkpoint are stored; rows that it has seen would count again")


def stream_ingest(
    payloads: DataFrame, table: PostingTable, checkpoint: str, dims: Dims = DEFAULT, loaded_at: Column | None = None
) -> None:
    """Payloads in (``feeds.landed_payloads``), new postings out, numbered in order of arrival; broken payloads are kept aside."""

    def work(batch: DataFrame, stream: str, number: int) -> None:
        table.append(feeds.arrivals(batch, dims), ["feed_ord", "file", "pos"], stream, number, loaded_at, feeds.all_rejects(batch))

    run(payloads, checkpoint, work)


def stream_train(
    stream: DataFrame, model: str, checkpoint: str, text: Column, label: Column, classes: list[str] | None = None, another: bool = False
) -> None:
    """Add each batch to the model: token counts, label counts, and the test-then-train accuracy, published together."""

    def work(batch: DataFrame, name: str, number: int) -> None:
        stored = nb.StoredModel(batch.sparkSession, model)
        first_or_known(stored.versions.last()[1], name, another)
        stored.update(batch, text, label, classes, (name, number))

    run(stream, checkpoint, work)


def stream_drift(stream: DataFrame, folder: str, checkpoint: str, another: bool = False) -> None:
    """Compare all rows so far with the first batch, the reference, after each batch.

    The state is row counts for each combination of the compared values: a batch is counted alone and added, and no
    earlier batch is read again.
    """

    def work(batch: DataFrame, name: str, number: int) -> None:
        versions = Versions(batch.sparkSession, folder)
        counted = drift.value_counts(batch).withColumn("batch", F.lit(f"{name}:{number}"))

        def add(content: dict) -> dict | None:
            first_or_known(content, name, another)
            seen = content.get("seen", {})
            if seen.get(name, -1) >= number:
                return None
            counts = [*content.get("counts", []), versions.write("counts", counted.coalesce(1))]
            content = content | {"counts": counts, "seen": seen | {name: number}}
            if len(counts) > 1:
                report = drift.report_of_counts(versions.load(counts[:1], drift.COUNTS), versions.load(counts, drift.COUNTS))
                written = versions.write("reports", report.withColumn("batch", F.lit(len(counts) - 1)).coalesce(1))
                content |= {"reports": [*content.get("reports", []), written]}
            return content

        versions.change(add)

    run(stream, checkpoint, work)


def drift_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of all batches after the first."""
    versions = Versions(spark, folder)
    return versions.load(versions.last()[1].get("reports", []), drift.REPORT)
