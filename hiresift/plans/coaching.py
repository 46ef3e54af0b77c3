"""Match analysis: best postings, report lines and skill gaps for profiles or resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.resume import resume_record
from hiresift.operators.match import report_by_set, set_records
from hiresift.session import cut


def match_report(jobs: DataFrame, profiles: DataFrame, limit: int = 10, dims: Dims = DEFAULT) -> DataFrame:
    """profile_id, lines (one per posting, in rank order), top_missing."""
    records, sets = set_records(jobs, profiles, limit, dims)
    report = report_by_set(records)
    return sets.select("profile_id", "pset").join(report, "pset").drop("pset")


def parse_resumes(resumes: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """resumes: resume_id, text -> the record fields."""
    return resumes.select("resume_id", resume_record(F.col("text"), dims).alias("r")).select("resume_id", "r.*")


def resume_match(jobs: DataFrame, resumes: DataFrame, limit: int = 10, dims: Dims = DEFAULT) -> DataFrame:
    """Resume record fields with the match report of the skills found in the text."""
    # written: the texts are parsed once, not for the skills, their sets and the result
    parsed = cut(parse_resumes(resumes, dims).select("resume_id", "name", "email", "skills", "skills_str", "experience_years", "education"))
    profiles = parsed.select(F.col("resume_id").alias("profile_id"), F.col("skills_str").alias("skills"))
    report = match_report(jobs, profiles, limit, dims)
    return parsed.join(report.withColumnRenamed("profile_id", "resume_id"), "resume_id").select(
        "resume_id", "name", "email", "skills", "experience_years", "education", "lines", "top_missing"
    )
