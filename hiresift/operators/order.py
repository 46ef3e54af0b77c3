"""Places and running sums over a whole table in order, without a task that holds the whole table.

Rows are dealt into ranges of the order by their number, however far apart the order values lie. Each range is summed up on its
own; the totals of the ranges are summed up in levels of FAN ranges, so no task holds a list that grows
with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.session import cut

FAN = 256


def _before(totals: DataFrame, cols: list[str], count: int) -> DataFrame:
    """_b and, for each column, the sum over all ranges of a smaller number; count bounds the numbers."""
    upto = Window.partitionBy("_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("_up", F.floor(F.col("_b") / FAN).cast("int"))
    inside = rows.select("_b", "_up", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in cols])
    if count <= FAN:
        return inside.drop("_up")
    groups = rows.groupBy(F.col("_up").alias("_b")).agg(*[F.sum(c).alias(c) for c in cols])
    above = _before(groups, cols, -(-count // FAN)).select(F.col("_b").alias("_up"), *[F.col(c).alias(f"_{c}") for c in cols])
    return inside.join(above, "_up").select("_b", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in cols])


def ranges(df: DataFrame, *order: str, count: int | None = None) -> tuple[DataFrame, int]:
    """The rows with _b, the number of their range, as a written table; and a bound of these numbers.

    The ranges are cut at quantiles, so they hold about as many rows each; their number is that of the session's
    shuffle partitions, or ``count``.
    """
    count = count or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(count, *order).withColumn("_b", F.spark_partition_id())), count


def running(df: DataFrame, order: str, cols: list[str], before: bool, count: int | None = None) -> DataFrame:
    """All columns and run_<c>: sums over the rows up to each row (or before it) in ``order``, which is unique."""
    rows, count = ranges(df, order, count=count)
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = _before(rows.groupBy("_b").agg(*[F.sum(c).alias(c) for c in cols]), cols, count)
    earlier = totals.select("_b", *[F.col(c).alias(f"_{c}") for c in cols])
    sums = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"run_{c}") for c in cols])
    # one row for each range, and there are ``count`` of them
    return sums.join(F.broadcast(earlier), "_b").select(
        *df.columns, *[(F.col(f"run_{c}") + F.col(f"_{c}")).alias(f"run_{c}") for c in cols])


def numbered(df: DataFrame, name: str, first: int, *order: str, count: int | None = None) -> DataFrame:
    """All columns and name: first, first + 1, ... in the order of these columns."""
    rows, count = ranges(df, *order, count=count)
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    sizes = _before(rows.groupBy("_b").agg(F.count("*").alias("_n")), ["_n"], count)
    return rows.select("*", place.alias("_place")).join(F.broadcast(sizes), "_b").select(
        *df.columns, (F.lit(first - 1).cast("long") + F.col("_n") + F.col("_place")).alias(name))
