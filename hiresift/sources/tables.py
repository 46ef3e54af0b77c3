"""Reading and writing the postings table and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEFAULTS = {
    "job_id": None, "title": "", "company": "", "description": "", "location": "", "job_type": "",
    "salary_min": 0.0, "salary_max": 0.0, "tags": "", "source": "",
}
_DRIFT = ["title", "job_type", "tags", "source", "salary_min", "salary_max"]


def _with_defaults(jobs: DataFrame, names: list[str], *keep: str) -> DataFrame:
    return jobs.select(*keep, *[
        F.col(n) if _DEFAULTS[n] is None else F.coalesce(n, F.lit(_DEFAULTS[n])).alias(n) for n in names
    ])


def load_jobs(jobs: DataFrame, *keep: str) -> DataFrame:
    """The ten columns that the feature jobs use, nulls replaced, after any columns to keep."""
    return _with_defaults(jobs, list(_DEFAULTS), *keep)


def drift_view(jobs: DataFrame) -> DataFrame:
    """The six columns that the drift checks use, nulls replaced."""
    return _with_defaults(jobs, _DRIFT)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Write Parquet and read it back; also the way to cut lineage with a table."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Write a report as JSON lines and read it back with its own schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def last_updated(jobs: DataFrame) -> DataFrame:
    """Day of the last load, or 'unknown'."""
    day = F.substring(F.max(F.col("created_at").cast("string")), 1, 10)
    return jobs.agg(F.coalesce(day, F.lit("unknown")).alias("last_updated"))
