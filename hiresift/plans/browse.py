"""Job browser: type, skill and place filters in one chain, then the first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.operators import filters


def browse_jobs(
    jobs: DataFrame, *, source: str | None = None, job_type: str = "All", skill: str = "",
    location: str = "", include_remote: bool = True, limit: int = 10, dims: Dims = DEFAULT,
) -> DataFrame:
    """The first postings that pass all filters; total is their number."""
    out = filters.by_type(filters.by_source(jobs, source), job_type)
    if skill:
        out = filters.search_skill(out, skill)
    if location:
        out = filters.by_location(out, location, include_remote, dims)
    first = out.orderBy("id").limit(limit).select("id", *filters.LISTING)
    # at most ``limit`` rows
    return first.withColumn("total", F.count("*").over(Window.partitionBy()))
