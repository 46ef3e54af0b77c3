"""Whole-table jobs: feature table, retraining on drift, the daily batch build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.text import assign_category, model_text
from hiresift.operators import features, nb
from hiresift.operators.keyindex import BUCKETS
from hiresift.operators.drift import run_drift_check
from hiresift.plans.preprocess import preprocess_jobs
from hiresift.session import work_path
from hiresift.sources.tables import load_jobs, write_report, write_table
from hiresift.sources.versions import Versions
from hiresift.streaming.postings import PostingTable


def training_text():
    return model_text(F.col("title"), F.col("tags"), F.col("description"))


def feature_table(
    jobs: DataFrame, max_features: int = 500, job_types: list[str] | None = None, dims: Dims = DEFAULT, model_path: str | None = None
) -> DataFrame:
    """Postings with one-hot skills, scaled salaries, job-type dummies and a TF-IDF term array.

    The TF-IDF column is an array of (term, weight) in term order: the sparse row of the matrix. What was fitted is stored in
    ``model_path`` (by default a folder of its own), so that later postings can be transformed alike. Job types are those given; by
    default the standard ones, and type_other for all others.
    """
    base = load_jobs(jobs, "id")
    model = features.FeatureModel(jobs.sparkSession, model_path or work_path(jobs.sparkSession, "feature-model"))
    counts = model.fit(base, max_features)
    known = sorted({*dims.job_types.values(), "unknown"}) if job_types is None else job_types
    wide = features.jobtype_dummies(features.skill_onehot(base, dims), known, other=job_types is None)
    return wide.join(model.transform(base, counts).drop("features"), "id")


def retrain_if_drift(
    jobs: DataFrame, reference_path: str, runs_path: str, run_id: str, run_date: str,
    refresh: bool = False, dims: Dims = DEFAULT,
) -> DataFrame | None:
    """Drift check, then a logged training run if any flag is up; returns the report."""
    report = run_drift_check(jobs, reference_path, refresh)
    if report is not None and report.first().any_drift:
        train_and_log(jobs, runs_path, run_id, run_date, dims)
    return report


def train_and_log(
    jobs: DataFrame, runs_path: str, run_id: str, run_date: str, dims: Dims = DEFAULT, model_path: str | None = None
) -> DataFrame:
    """One training run: the model is published, then the run is written under its own run_id; a repeat replaces both.

    The model lies in ``model_path``, by default beside the runs (``nb.StoredModel``).
    """
    return log_run(train(jobs, model_path or f"{runs_path}-model", dims), runs_path, run_id, run_date)


def train(jobs: DataFrame, model_path: str, dims: Dims = DEFAULT) -> DataFrame:
    """Publish a model of the postings; returns the test-then-train predictions, as a written table."""
    model = nb.StoredModel(jobs.sparkSession, model_path)
    return model.train(jobs, training_text(), assign_category(F.col("title"), dims), dims.classes)


def log_run(scored: DataFrame, runs_path: str, run_id: str, run_date: str) -> DataFrame:
    """Write the row of a training run."""
    return write_table(nb.training_run(scored, run_id, run_date), f"{runs_path}/run={run_id}")


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The latest complete version of a table of the batch build: "jobs", "clean" or "features"."""
    if name == "jobs":
        return PostingTable(spark, f"{folder}/postings").rows()
    path = Versions(spark, folder).last()[1].get(name)
    if path is None:
        raise ValueError(f"no version of {name} in {folder}")
    return spark.read.parquet(path)


def batch_build(
    stored: DataFrame, incoming: DataFrame, folder: str, run_id: str, run_date: str, dims: Dims = DEFAULT, buckets: int = BUCKETS
) -> DataFrame:
    """Ingest, clean, features, training, drift check: one row per step with its outcome.

    The first day loads ``stored`` into the folder's postings table; later days go on from that table, whose index they compare
    ``incoming`` with (and ``stored`` is not read). A day that is run again under its run_id takes in nothing twice.

    A step that fails is reported with its message and the next one goes on with the last good table. Every
    table is written as a new version, and no input is overwritten. A version is named only after it is complete; ``Versions.drop_unnamed``
    deletes what older versions and failed attempts left.
    """
    spark = stored.sparkSession
    state = {"jobs": stored}
    log: list[tuple[int, str, str, int]] = []

    def step(name: str, run: Callable[[], int]) -> None:
        try:
            log.append((len(log), name, "done", run()))
        except Exception as error:  # each step stands alone, as in a scheduled job
            log.append((len(log), name, f"failed: {type(error).__name__}: {str(error).strip().splitlines()[0][:200]}", 0))

    versions = Versions(spark, folder)

    def keep(name: str, rows: DataFrame) -> DataFrame:
        path = versions.write(name, rows)
        versions.change(lambda content: content | {name: path})
        return spark.read.parquet(path)

    def ingest() -> int:
        table = PostingTable(spark, f"{folder}/postings", buckets)
        if table.versions.last()[0] < 0:
            table.load(stored)
        table.append(incoming, ["id"], run_id, 0, ids="id")
        state["jobs"] = table.rows()
        return state["jobs"].count()

    def clean() -> int:
        state["jobs"] = keep("clean", preprocess_jobs(state["jobs"], dims))
        return state["jobs"].count()

    def build() -> int:
        return keep("features", feature_table(state["jobs"], dims=dims, model_path=f"{folder}/feature-model")).count()

    def train() -> int:
        run = train_and_log(state["jobs"], f"{folder}/runs", run_id, run_date, dims, f"{folder}/model")
        return int(run.first().metrics["total_jobs_trained"])

    def drift() -> int:
        report = retrain_if_drift(
            state["jobs"], f"{folder}/reference", f"{folder}/runs", f"{run_id}-drift", run_date, dims=dims
        )
        return 0 if report is None else int(write_report(report, f"{folder}/drift/run={run_id}").first().any_drift)

    for name, run in (("ingest", ingest), ("clean", clean), ("features", build), ("train", train), ("drift", drift)):
        step(name, run)
    return stored.sparkSession.createDataFrame(log, "step_no int, step string, outcome string, value long")
