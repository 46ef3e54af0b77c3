"""Clean the postings: keep tech titles, strip text, extract skills, standardise the job type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.skills import extract_skills
from hiresift.functions.text import clean_text, is_tech_title, standardize_job_type


def preprocess_jobs(jobs: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """A new snapshot of the table; old tags stay where no skill is found.

    Narrow: one scan without a shuffle. A null tag or title is written out as "None" in the
    scanned text, which holds no skill.
    """
    cleaned = jobs.where(is_tech_title(F.col("title"), dims)).withColumn(
        "description", clean_text(F.col("description"))
    )
    scanned = F.concat_ws(
        " ", "description", F.coalesce("tags", F.lit("None")), F.coalesce("title", F.lit("None"))
    )
    cleaned = cleaned.withColumn("_skills", F.array_join(extract_skills(scanned, dims), ", "))
    return cleaned.withColumns({
        "tags": F.when(F.col("_skills") != "", F.col("_skills")).otherwise(F.col("tags")),
        "job_type": standardize_job_type(F.col("job_type"), dims.job_types),
    }).select(*jobs.columns)
