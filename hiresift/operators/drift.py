"""Drift checks between a reference snapshot and the current postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.operators.stats import share
from hiresift.session import cut
from hiresift.sources.tables import drift_view

SHARE_LIMIT = 0.1
VOLUME_LIMIT = 0.2


def schema_changes(reference: DataFrame, current: DataFrame) -> tuple[list[str], list[str]]:
    """Names of new and of missing columns."""
    ref, cur = reference.columns, current.columns
    return [c for c in cur if c not in ref], [c for c in ref if c not in cur]


def share_changes(
    reference: DataFrame, current: DataFrame, col: str, rows: Column | None = None
) -> DataFrame:
    """value, ref_share, cur_share, diff, drifted over the values of both sides."""
    ref = share(reference, col, rows=rows).select("value", F.col("share").alias("ref_share"))
    cur = share(current, col, rows=rows).select("value", F.col("share").alias("cur_share"))
    both = ref.join(cur, "value", "full_outer").select(
        "value", F.coalesce("ref_share", F.lit(0.0)).alias("ref_share"),
        F.coalesce("cur_share", F.lit(0.0)).alias("cur_share"),
    )
    diff = F.abs(F.col("ref_share") - F.col("cur_share"))
    return both.select("*", diff.alias("diff"), (diff > SHARE_LIMIT).alias("drifted"))


def volume_change(reference: DataFrame, current: DataFrame, rows: Column | None = None) -> DataFrame:
    """Counts of both sides, relative change, flag; an empty reference gives 0."""
    size = F.count("*") if rows is None else F.coalesce(F.sum(rows), F.lit(0))
    cur = current.agg(size).scalar()
    counts = reference.agg(size.alias("reference_count")).withColumn("current_count", cur)
    ref = F.col("reference_count")
    change = F.when(ref > 0, F.abs(F.col("current_count") - ref) / ref).otherwise(F.lit(0.0))
    return counts.select("*", change.alias("diff"), (change > VOLUME_LIMIT).alias("drifted"))


COUNTS = "name string, value string, n long"
REPORT = ("schema_drift boolean, distribution_drift boolean, volume_drift boolean, any_drift boolean, reference_count long, "
          "current_count long, new_columns string, missing_columns string, batch int")
COMPARED = ("job_type", "source")


def value_counts(jobs: DataFrame, columns: tuple[str, ...] = COMPARED) -> DataFrame:
    """name, value, n: rows by value of each compared column of a drift view or of postings, and in all under the name "".

    Counts of parts of a table add up to those of the table.
    """
    view = jobs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns]
    cells.append(F.struct(F.lit("").alias("name"), F.lit("").alias("value")))
    return view.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.name", "c.value").agg(F.count("*").alias("n"))


def drift_report(reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row with all flags; both sides are drift views.

    Each side is scanned once, into row counts by value of the compared columns; all
    shares and totals come from those few rows.
    """
    new, missing = schema_changes(reference, current)
    shared = tuple(c for c in COMPARED if c in reference.columns and c in current.columns)
    return report_of_counts(cut(value_counts(reference, shared)), cut(value_counts(current, shared)), shared, new, missing)


def report_of_counts(
    reference: DataFrame, current: DataFrame, columns: tuple[str, ...] = COMPARED, new: list[str] | None = None, missing: list[str] | None = None
) -> DataFrame:
    """The report from value counts, of which there may be several parts to a side."""
    rows, new, missing = F.col("n"), new or [], missing or []

    def of(side: DataFrame, name: str) -> DataFrame:
        return side.where(F.col("name") == name)

    flags = volume_change(of(reference, ""), of(current, ""), rows).select(
        "reference_count", "current_count", F.col("drifted").alias("volume_drift")
    )
    distribution = F.lit(False)
    for c in columns:
        moved = share_changes(of(reference, c), of(current, c), "value", rows).agg(F.max("drifted")).scalar()
        flags = flags.withColumn(f"_{c}", F.coalesce(moved, F.lit(False)))
        distribution = distribution | F.col(f"_{c}")
    schema_drift = F.lit(bool(new or missing))
    return flags.select(
        schema_drift.alias("schema_drift"), distribution.alias("distribution_drift"), "volume_drift",
        (schema_drift | distribution | F.col("volume_drift")).alias("any_drift"),
        "reference_count", "current_count",
        F.lit(", ".join(new)).alias("new_columns"), F.lit(", ".join(missing)).alias("missing_columns"),
    )


def run_drift_check(jobs: DataFrame, reference_path: str, refresh: bool = False) -> DataFrame | None:
    """Check against the stored snapshot. The first run stores it and reports nothing.

    ``refresh`` replaces the snapshot with the current view after the check; the new snapshot is
    written beside the old one, as a table cannot be overwritten while it is being read.
    """
    spark = jobs.sparkSession
    current = drift_view(jobs)
    versions = _versions(spark, reference_path)
    if not versions:
        current.write.mode("overwrite").parquet(f"{reference_path}/v=0")
        return None
    reference = spark.read.parquet(f"{reference_path}/v={versions[-1]}")
    report = drift_report(reference, current)
    if refresh:
        current.write.mode("overwrite").parquet(f"{reference_path}/v={versions[-1] + 1}")
    return report


def _versions(spark, path: str) -> list[int]:
    """Numbers of the complete snapshots below a path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)
