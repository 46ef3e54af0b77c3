"""Counts and profiles: sources, locations, skills, data health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.places import countries_in, is_remote, location_matches
from hiresift.functions.skills import extract_skills
from hiresift.functions.text import parse_tags


def stats_by_source(jobs: DataFrame, sources: list[str]) -> DataFrame:
    """Total and one count per named source, 0 when absent."""
    return jobs.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("source") == s).alias(s) for s in sources]
    )


def value_counts(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(col).agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), F.col(col).asc_nulls_first()).limit(limit)


def created_range(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def repeated_titles(jobs: DataFrame) -> DataFrame:
    """Number of (title, company) pairs that occur more than once, without regard to case."""
    pairs = jobs.groupBy(F.lower("title").alias("t"), F.lower("company").alias("c")).agg(
        F.count("*").alias("n")
    )
    return pairs.where("n > 1").agg(F.count("*").alias("n_groups"))


def skill_counts(jobs: DataFrame) -> DataFrame:
    tags = jobs.select(F.explode(parse_tags(F.col("tags"))).alias("skill"))
    return tags.groupBy("skill").agg(F.count("*").alias("n"))


def top_skill(jobs: DataFrame, default: str = "python") -> DataFrame:
    """Most frequent tag of all rows; ties go to the first name."""
    best = F.min_by("skill", F.struct(-F.col("n"), F.col("skill")))
    return skill_counts(jobs).agg(F.coalesce(best, F.lit(default)).alias("top_skill"))


def sidebar_stats(jobs: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """Total, remote, top skill, day of the last load, and of a stored evaluation accuracy and baseline in percent, in one row.

    evaluation: input, accuracy, baseline_accuracy (``evaluate.summary``); without one, or without the input "current", both are null.
    """
    day = F.substring(F.max(F.col("created_at").cast("string")), 1, 10)
    out = jobs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("job_type") == "remote").alias("remote"),
        F.coalesce(day, F.lit("unknown")).alias("last_updated"),
    ).withColumn("top_skill", top_skill(jobs).scalar())
    for name, col in (("accuracy", "accuracy"), ("baseline", "baseline_accuracy")):
        kept = F.lit(None).cast("double") if evaluation is None else evaluation.where("input = 'current'").agg(F.round(F.max(col) * 100, 1)).scalar()
        out = out.withColumn(name, kept)
    return out


def skill_counts_old_new(jobs: DataFrame, limit: int = 10, dims: Dims = DEFAULT) -> DataFrame:
    """Stored tags against skills extracted again from the text: counts side by side."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("description", "tags", "title")])
    # one scan: each row yields its stored tags and its extracted skills, told apart by a flag
    entries = jobs.select(F.explode(F.concat(
        F.transform(parse_tags(F.col("tags")), lambda s: F.struct(s.alias("skill"), F.lit(1).alias("old"))),
        F.transform(extract_skills(text, dims), lambda s: F.struct(s.alias("skill"), F.lit(0).alias("old"))),
    )).alias("e"))
    counts = entries.groupBy("e.skill").agg(
        F.sum("e.old").alias("n_old"), F.sum(1 - F.col("e.old")).alias("n_new")
    )
    return counts.orderBy(F.desc("n_new"), F.desc("n_old"), "skill").limit(limit)


def encoding_check(jobs: DataFrame, marker: str = "â") -> DataFrame:
    """Postings whose description holds the marker of a broken encoding, by source."""
    return value_counts(jobs.where(F.contains(F.col("description"), F.lit(marker))), "source")


def channel_companies(jobs: DataFrame, channel: str = "linkedin", limit: int = 10) -> DataFrame:
    return value_counts(
        jobs.where(F.contains(F.lower("company"), F.lit(channel))), "company", limit
    )


def location_coverage(
    jobs: DataFrame, queries: list[str], top: int = 8, dims: Dims = DEFAULT
) -> DataFrame:
    """Per query: hits, and the most frequent locations among them.

    Each posting is tested once against all queries and yields one row per hit, after which
    counts per (query, location) are all that moves.
    """
    place, kind = F.col("location"), F.col("job_type")
    hits = F.array_compact(F.array(*[
        F.when(location_matches(place, q, kind, True, dims), F.lit(q)) for q in queries
    ]))
    per_place = (
        jobs.select(F.explode(hits).alias("query"), F.coalesce(place, F.lit("")).alias("location"))
        .groupBy("query", "location").agg(F.count("*").alias("n"))
    )
    totals = per_place.groupBy("query").agg(F.sum("n").alias("hits"))
    best = Window.partitionBy("query").orderBy(F.desc("n"), "location")
    ranked = per_place.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top)
    return ranked.join(totals, "query").select("query", "hits", "rn", "location", "n")


def location_gaps(jobs: DataFrame, top: int = 25, dims: Dims = DEFAULT) -> DataFrame:
    """Unresolved location texts, most frequent first; the empty one is counted too."""
    place = F.coalesce(F.col("location"), F.lit(""))
    open_place = (place == "") | (
        (F.size(countries_in(place, dims)) == 0) & ~is_remote(place, F.col("job_type"), dims)
    )
    gaps = jobs.where(open_place).groupBy(place.alias("location")).agg(F.count("*").alias("n"))
    return gaps.orderBy((F.col("location") == "").desc(), F.desc("n"), "location").limit(top + 1)


def low_cardinality_profile(df: DataFrame, max_distinct: int = 15) -> DataFrame:
    """Value counts of every string column with few distinct values.

    A first pass counts the hash buckets that a column's values fall into. A column has at least as
    many values as buckets, so one that fills more than ``max_distinct`` is surely out; the others are
    counted exactly. Long texts are never shuffled.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    words = max_distinct // 16 + 1
    least = df.agg(*[_filled_buckets(F.col(n), words).alias(str(i)) for i, n in enumerate(names)]).first()
    narrow = [n for i, n in enumerate(names) if least[i] <= max_distinct]
    if not narrow:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in narrow
    ])).alias("c"))
    counts = cells.select("c.*").where("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n")
    )
    few = Window.partitionBy("column")
    return counts.withColumn("d", F.count("*").over(few)).where(F.col("d") <= max_distinct).drop("d")


def _filled_buckets(col: Column, words: int) -> Column:
    """Number of hash buckets, 64 for each word of bits, that hold a value: never more than there are values."""
    bucket = F.when(col.isNotNull(), F.pmod(F.xxhash64(col), F.lit(64 * words)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 64).cast("int"))
    filled = [F.bit_count(F.bit_or(F.when(F.floor(bucket / 64) == w, bit))) for w in range(words)]
    return sum((F.coalesce(n, F.lit(0)) for n in filled), F.lit(0))


def share(df: DataFrame, key: Column | str, name: str = "value", rows: Column | None = None) -> DataFrame:
    """Count and share of each value of a column; ``rows`` sums up rows counted before."""
    key = F.col(key) if isinstance(key, str) else key
    size = F.count("*") if rows is None else F.sum(rows)
    counts = df.groupBy(key.alias(name)).agg(size.alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def data_health(jobs: DataFrame, marker: str = "â") -> DataFrame:
    """All health checks as (check, key, value) rows."""
    def rows(df: DataFrame, check: str, key: Column, value: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), F.coalesce(key, F.lit("")).alias("key"),
            value.cast("string").alias("value"),
        )

    none, n = F.lit(""), F.col("n")
    created = created_range(jobs)
    parts = [
        rows(jobs.agg(F.count("*").alias("n")), "total", none, n),
        rows(value_counts(jobs, "source"), "source", F.col("source"), n),
        rows(created, "created_first", none, F.col("first")),
        rows(created, "created_last", none, F.col("last")),
        rows(repeated_titles(jobs), "repeated_titles", none, F.col("n_groups")),
        rows(channel_companies(jobs), "channel_company", F.col("company"), n),
        rows(value_counts(jobs, "location", 10), "top_location", F.col("location"), n),
        rows(encoding_check(jobs, marker), "broken_text", F.col("source"), n),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
