"""Row filters of the job browser and the data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.places import countries_in, is_remote, location_matches

LISTING = ["title", "company", "location", "job_type", "tags", "apply_url"]


def by_source(jobs: DataFrame, source: str | None, limit: int | None = None) -> DataFrame:
    out = jobs if source is None else jobs.where(F.col("source") == source)
    return out if limit is None else out.orderBy("id").limit(limit)


def by_type(jobs: DataFrame, job_type: str = "All", limit: int | None = None) -> DataFrame:
    out = jobs if job_type == "All" else jobs.where(F.col("job_type") == job_type)
    return out if limit is None else out.orderBy("id").limit(limit)


def _holds(col: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(term.lower()))


def search_skill(jobs: DataFrame, term: str) -> DataFrame:
    """Tags, title or description contains the term."""
    return jobs.where(_holds("tags", term) | _holds("title", term) | _holds("description", term))


def search_title(jobs: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    return jobs.where(_holds("title", keyword)).orderBy("id").limit(limit)


def by_location(
    jobs: DataFrame, query: str, include_remote: bool = True, dims: Dims = DEFAULT
) -> DataFrame:
    return jobs.where(
        location_matches(F.col("location"), query, F.col("job_type"), include_remote, dims)
    )


def unresolved_locations(jobs: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """Postings with a location text of no known country that are not remote."""
    place = F.col("location")
    return jobs.where(
        (F.coalesce(place, F.lit("")) != "")
        & (F.size(countries_in(place, dims)) == 0)
        & ~is_remote(place, F.col("job_type"), dims)
    )
