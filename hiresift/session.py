"""Session defaults and the shared working folder."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Set only on sessions we build ourselves; a cluster session keeps its own values.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "hiresift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and work tables, as the cluster names it in spark.checkpoint.dir.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="hiresift-")
        sc.setCheckpointDir(path)
    return path or sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: Spark serves it to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix=f"{root.name}-")
        sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
        _shipped.add(sc.applicationId)


# Spark hands whole texts to Python in batches of 10,000 rows or 64 MB, which the JVM holds outside its heap and each worker holds again.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python workers, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


_scopes = threading.local()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    The table survives lost executors, and its size is known to the joins that follow. Within ``scope`` it is deleted at the end.
    ``codec`` is Parquet's, by default the session's.
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if open_ := getattr(_scopes, "open", None):
        open_[-1].append(path)
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes within the block are deleted at its end, but for those that the given function keeps.

    What is returned from the block may read kept tables only: ``with scope(spark) as keep: ... return keep(cut(rows))``.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    made: list[str] = []
    kept: list[str] = []
    _scopes.open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.cut_path)
        return df

    try:
        yield keep
    finally:
        _scopes.open.pop()
        if _scopes.open:  # a kept table belongs to the block around this one
            _scopes.open[-1] += kept
        forget(spark, *(p for p in made if p not in kept))


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
