"""Queries over joins, aggregations, windows and rankings."""

from pyspark.sql import functions as F

from hiresift.catalog.base import (
    JOBS, KEYED, KNOWN, PROFILES, RESUMES, SPLIT, SYN, VOCAB, category, ctes, extraction, joined, jobs_fx, listed,
    profiles_fx, query, resumes_fx, tag_list,
)
from hiresift.catalog.scalars import CODES, RESUME_RECORD, RESUME_SKILLS
from hiresift.functions.text import assign_category
from hiresift.operators import dedup, drift, match, stats
from hiresift.plans.coaching import match_report, resume_match
from hiresift.sources.tables import drift_view

# --- matching -----------------------------------------------------------------------------------
# Brute force: every distinct skill list against every posting, in full.

USERS = f"""users AS (
  SELECT DISTINCT ul, coalesce(y.canonical, nm) AS skill FROM (
    SELECT ul, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS nm
    FROM (SELECT ul, unnest(string_split(ul, ',')) AS raw FROM (SELECT DISTINCT ul FROM lists))) p
  LEFT JOIN syn y ON y.alias = p.nm)"""
PROFILE_LISTS = "lists AS (SELECT profile_id, skills AS ul FROM profiles_fx)"


def ranking(limit):
    return ",\n".join([USERS, f"""scores AS (
  SELECT l.ul, s.id, CAST(round_even(100.0 * count(u.skill) FILTER (WHERE NOT s.nice) / count(*) FILTER (WHERE NOT s.nice), 0) AS INTEGER) AS pct,
    count(u.skill) FILTER (WHERE NOT s.nice) AS m, {listed('s.pos', 'NOT s.nice AND u.skill IS NOT NULL', 's.skill')} AS matched,
    {listed('s.pos', 'NOT s.nice AND u.skill IS NULL', 's.skill')} AS missing, {listed('s.pos', 'NOT s.nice', 's.skill')} AS required,
    {listed('s.pos', 's.nice', 's.skill')} AS nice, {listed('s.pos', 's.nice AND u.skill IS NOT NULL', 's.skill')} AS nice_matched
  FROM (SELECT DISTINCT ul FROM lists) l, split_skills s LEFT JOIN users u ON u.ul = l.ul AND u.skill = s.skill
  GROUP BY l.ul, s.id)""", f"""ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ul ORDER BY pct DESC, m DESC, id) AS INTEGER) AS rank FROM (
    SELECT *, count(*) FILTER (WHERE pct > 0) OVER (PARTITION BY ul) AS nz FROM scores)
  WHERE nz < 5 OR pct > 0 QUALIFY rank <= {limit})"""])


MATCHING = (JOBS, PROFILES, VOCAB, SYN, KNOWN, SPLIT, PROFILE_LISTS)


@query("match_profiles_jobs", ctes(*MATCHING, ranking(10)) + """
SELECT profile_id, rank, id, pct, matched, missing FROM lists JOIN ranked USING (ul)""")
def match_profiles_jobs(spark, sf_dir):
    out = match.top_jobs(jobs_fx(spark, sf_dir), profiles_fx(spark, sf_dir), 10)
    return out.select("profile_id", "rank", "id", "pct", joined("matched").alias("matched"), joined("missing").alias("missing"))


@query("match_top_jobs", ctes(*MATCHING, ranking(5)) + """
SELECT profile_id, rank, r.id, title, company, location, job_type, tags, apply_url, pct, matched, missing, required, nice, nice_matched
FROM lists JOIN ranked r USING (ul) JOIN jobs_fx j ON j.id = r.id""")
def match_top_jobs(spark, sf_dir):
    out = match.top_jobs(jobs_fx(spark, sf_dir), profiles_fx(spark, sf_dir), 5)
    return out.withColumns({c: joined(c) for c in ("matched", "missing", "required", "nice", "nice_matched")})


_ONE = "lists AS (SELECT 0 AS profile_id, 'python' AS ul)"


@query("nice_split_rate", ctes(JOBS, VOCAB, SYN, KNOWN, SPLIT, _ONE, ranking(1000000000)) + """
SELECT count(*) FILTER (WHERE nice <> '') AS with_nice, count(*) AS listed FROM ranked""")
def nice_split_rate(spark, sf_dir):
    return match.nice_split_rate(jobs_fx(spark, sf_dir), "python")


GAPS = """gaps AS (
  SELECT ul, skill, count(*) AS n, CAST(row_number() OVER (PARTITION BY ul ORDER BY count(*) DESC, skill) AS INTEGER) AS rn
  FROM (SELECT ul, unnest(string_split(missing, ', ')) AS skill FROM ranked WHERE rank <= 5 AND missing <> '')
  GROUP BY ul, skill QUALIFY rn <= 10)"""


@query("top_missing_skills", ctes(*MATCHING, ranking(10), GAPS) + """
SELECT profile_id, skill, n, rn FROM lists JOIN gaps USING (ul)""")
def top_missing_skills(spark, sf_dir):
    return match.top_missing_skills(jobs_fx(spark, sf_dir), profiles_fx(spark, sf_dir))


LINE = """concat('- ', coalesce(title, 'None'), ' at ', coalesce(company, 'None'), ' (', coalesce(location, 'None'), ') | Real Match: ',
  CAST(pct AS STRING), '% | Matched Skills: ', CASE WHEN matched = '' THEN 'none' ELSE matched END,
  ' | Missing Skills: ', CASE WHEN missing = '' THEN 'none' ELSE missing END)"""
REPORT = f"""report AS (
  SELECT ul, string_agg({LINE}, chr(10) ORDER BY rank) AS lines FROM ranked JOIN jobs_fx j USING (id) GROUP BY ul),
reported AS (
  SELECT r.ul, r.lines, coalesce(g.top_missing, '') AS top_missing FROM report r
  LEFT JOIN (SELECT ul, string_agg(skill, ', ' ORDER BY rn) AS top_missing FROM gaps GROUP BY ul) g ON g.ul = r.ul)"""


@query("match_report_lines", ctes(*MATCHING, ranking(10)) + f"""
SELECT profile_id, rank, {LINE} AS line FROM lists JOIN ranked USING (ul) JOIN jobs_fx j USING (id)""")
def match_report_lines(spark, sf_dir):
    out = match.top_jobs(jobs_fx(spark, sf_dir), profiles_fx(spark, sf_dir), 10)
    return out.select("profile_id", "rank", match.match_line().alias("line"))


@query("match_report", ctes(*MATCHING, ranking(10), GAPS, REPORT) + """
SELECT profile_id, lines, top_missing FROM lists JOIN reported USING (ul)""")
def match_report_query(spark, sf_dir):
    return match_report(jobs_fx(spark, sf_dir), profiles_fx(spark, sf_dir))


@query("resume_match", ctes(
    JOBS, RESUMES, VOCAB, SYN, KNOWN, SPLIT, RESUME_SKILLS, RESUME_RECORD,
    "lists AS (SELECT resume_id AS profile_id, skills_str AS ul FROM record)", ranking(10), GAPS, REPORT,
) + """SELECT r.resume_id, r.name, r.email, r.skills_str AS skills, r.experience_years, r.education, p.lines, p.top_missing
FROM record r JOIN reported p ON p.ul = r.skills_str""")
def resume_match_query(spark, sf_dir):
    out = resume_match(jobs_fx(spark, sf_dir), resumes_fx(spark, sf_dir))
    return out.withColumn("skills", joined("skills")).withColumn("education", joined("education"))


# --- counts -------------------------------------------------------------------------------------


@query("stats_by_source", ctes(JOBS) + """
SELECT count(*) AS total, count(*) FILTER (WHERE source = 'src0') AS src0, count(*) FILTER (WHERE source = 'src1') AS src1,
  count(*) FILTER (WHERE source = 'src2') AS src2, count(*) FILTER (WHERE source = 'other') AS other FROM jobs_fx""")
def stats_by_source(spark, sf_dir):
    return stats.stats_by_source(jobs_fx(spark, sf_dir), ["src0", "src1", "src2", "other"])


@query("source_counts", ctes(JOBS) + "SELECT source, count(*) AS n FROM jobs_fx GROUP BY source")
def source_counts(spark, sf_dir):
    return stats.value_counts(jobs_fx(spark, sf_dir), "source")


TOP_SKILL = f"""all_tags AS (SELECT tags FROM jobs_fx WHERE tags IS NOT NULL),
top_skill AS (SELECT coalesce((SELECT skill FROM (SELECT unnest({tag_list('tags')}) AS skill FROM all_tags)
  GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 1), 'python') AS top_skill)"""


@query("created_range", ctes(JOBS) + "SELECT min(created_at) AS first, max(created_at) AS last FROM jobs_fx")
def created_range(spark, sf_dir):
    return stats.created_range(jobs_fx(spark, sf_dir))


@query("dup_title_company", ctes(JOBS) + """SELECT count(*) AS n_groups FROM (
  SELECT 1 FROM jobs_fx GROUP BY lower(title), lower(company) HAVING count(*) > 1)""")
def dup_title_company(spark, sf_dir):
    return stats.repeated_titles(jobs_fx(spark, sf_dir))


@query("top_locations", ctes(JOBS) + """
SELECT location, count(*) AS n FROM jobs_fx GROUP BY location ORDER BY n DESC, location NULLS FIRST LIMIT 10""")
def top_locations(spark, sf_dir):
    return stats.value_counts(jobs_fx(spark, sf_dir), "location", 10)


@query("skill_counts", ctes(JOBS) + f"""
SELECT skill, count(*) AS n FROM (SELECT unnest({tag_list('tags')}) AS skill FROM jobs_fx) GROUP BY skill""")
def skill_counts(spark, sf_dir):
    return stats.skill_counts(jobs_fx(spark, sf_dir))


@query("top_skill", ctes(JOBS, TOP_SKILL) + "SELECT top_skill FROM top_skill")
def top_skill(spark, sf_dir):
    return stats.top_skill(jobs_fx(spark, sf_dir))


@query("category_share", ctes(JOBS) + f"""
SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM jobs_fx), 3) AS share
FROM (SELECT {category('title')} AS category FROM jobs_fx) GROUP BY category""")
def category_share(spark, sf_dir):
    out = stats.share(jobs_fx(spark, sf_dir), assign_category(F.col("title")), "category")
    return out.withColumn("share", F.round("share", 3))


@query("dup_groups", ctes(JOBS, KEYED) + """
SELECT c AS company, t AS title, l AS city, count(*) AS n_rows, count(*) - 1 AS n_delete FROM keyed
WHERE c <> '' AND t <> '' GROUP BY c, t, l HAVING count(*) > 1""")
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(jobs_fx(spark, sf_dir))


_TEXT_COLS = ["job_id", "title", "company", "description", "location", "job_type", "tags", "source", "apply_url",
              "date_posted", "created_at"]


@query("low_card_profile", ctes(JOBS) + "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM jobs_fx WHERE {c} IS NOT NULL
    AND (SELECT count(DISTINCT {c}) FROM jobs_fx) <= 15 GROUP BY {c}""" for c in _TEXT_COLS) + ")")
def low_card_profile(spark, sf_dir):
    return stats.low_cardinality_profile(jobs_fx(spark, sf_dir))


_QUERIES = {"USA": "us", "India": "in", "Germany": "de", "remote": None}


@query("location_coverage", ctes(JOBS, CODES, "hits AS (" + " UNION ALL ".join(
    f"SELECT '{q}' AS query, location FROM coded WHERE "
    + ("remote" if code is None else f"list_contains(string_split(codes, ','), '{code}') OR (remote AND codes = '')")
    for q, code in _QUERIES.items()) + ")") + """
SELECT query, hits, CAST(row_number() OVER (PARTITION BY query ORDER BY n DESC, location) AS INTEGER) AS rn, location, n FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY query) AS BIGINT) AS hits FROM (
    SELECT query, coalesce(location, '') AS location, count(*) AS n FROM hits GROUP BY 1, 2)) QUALIFY rn <= 8""")
def location_coverage(spark, sf_dir):
    return stats.location_coverage(jobs_fx(spark, sf_dir), list(_QUERIES))


@query("location_gaps", ctes(JOBS, CODES) + """
SELECT coalesce(location, '') AS location, count(*) AS n FROM coded
WHERE coalesce(location, '') = '' OR (codes = '' AND NOT remote) GROUP BY 1
ORDER BY (coalesce(location, '') = '') DESC, n DESC, 1 LIMIT 26""")
def location_gaps(spark, sf_dir):
    return stats.location_gaps(jobs_fx(spark, sf_dir))


_OLDNEW = ",\n".join([
    "scan AS (SELECT id, concat_ws(' ', coalesce(description, ''), coalesce(tags, ''), coalesce(title, '')) AS x FROM jobs_fx)",
    extraction("found", "scan", "id"),
    f"old AS (SELECT skill, count(*) AS n FROM (SELECT unnest({tag_list('tags')}) AS skill FROM jobs_fx) GROUP BY skill)",
    "new AS (SELECT skill, count(*) AS n FROM found GROUP BY skill)",
])


@query("skill_counts_old_new", ctes(JOBS, VOCAB, _OLDNEW) + """
SELECT coalesce(o.skill, w.skill) AS skill, coalesce(o.n, 0) AS n_old, coalesce(w.n, 0) AS n_new
FROM old o FULL OUTER JOIN new w ON w.skill = o.skill ORDER BY n_new DESC, n_old DESC, 1 LIMIT 10""")
def skill_counts_old_new(spark, sf_dir):
    return stats.skill_counts_old_new(jobs_fx(spark, sf_dir))


_TOP10 = "(SELECT location, count(*) AS n FROM jobs_fx GROUP BY location ORDER BY n DESC, location NULLS FIRST LIMIT 10)"


@query("data_health", ctes(JOBS) + f"""
SELECT 'total' AS "check", '' AS key, CAST(count(*) AS STRING) AS value FROM jobs_fx
UNION ALL SELECT 'source', source, CAST(count(*) AS STRING) FROM jobs_fx GROUP BY source
UNION ALL SELECT 'created_first', '', min(created_at) FROM jobs_fx
UNION ALL SELECT 'created_last', '', max(created_at) FROM jobs_fx
UNION ALL SELECT 'repeated_titles', '', CAST(count(*) AS STRING) FROM (SELECT 1 FROM jobs_fx GROUP BY lower(title), lower(company) HAVING count(*) > 1)
UNION ALL SELECT * FROM (SELECT 'channel_company', company, CAST(count(*) AS STRING) FROM jobs_fx WHERE contains(lower(company), 'linkedin')
  GROUP BY company ORDER BY count(*) DESC, company LIMIT 10)
UNION ALL SELECT 'top_location', coalesce(location, ''), CAST(n AS STRING) FROM {_TOP10}
UNION ALL SELECT 'broken_text', source, CAST(count(*) AS STRING) FROM jobs_fx WHERE contains(description, 'â') GROUP BY source""")
def data_health(spark, sf_dir):
    return stats.data_health(jobs_fx(spark, sf_dir))


# --- duplicates ---------------------------------------------------------------------------------


@query("dedup_keep_first", ctes(JOBS, KEYED) + """,
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id) = 1)
SELECT id, job_id FROM firsts WHERE c = '' OR t = ''
UNION ALL
SELECT id, job_id FROM (SELECT * FROM firsts WHERE c <> '' AND t <> '' QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY id) = 1)""")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(jobs_fx(spark, sf_dir)).select("id", "job_id")


@query("dedup_keep_best", ctes(JOBS, KEYED) + """
SELECT id, title FROM (
  SELECT id, title FROM keyed WHERE c = '' OR t = ''
  UNION ALL
  SELECT id, title FROM (SELECT * FROM keyed WHERE c <> '' AND t <> ''
    QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY length(coalesce(description, '')) DESC, id) = 1))""")
def dedup_keep_best(spark, sf_dir):
    return dedup.keep_best(jobs_fx(spark, sf_dir)).select("id", "title")


# --- drift --------------------------------------------------------------------------------------
# The reference snapshot is what was loaded in the first week, the current view is all.

WEEK = "2026-02-08"


def drift_sides(spark, sf_dir):
    jobs = jobs_fx(spark, sf_dir)
    return drift_view(jobs.where(F.col("created_at") < WEEK)), drift_view(jobs)


def _share_sql(col):
    return ctes(JOBS, f"""ref AS (SELECT coalesce({col}, '') AS value, count(*) / (SELECT count(*) FROM jobs_fx WHERE created_at < '{WEEK}') AS s
  FROM jobs_fx WHERE created_at < '{WEEK}' GROUP BY 1)""", f"""cur AS (
  SELECT coalesce({col}, '') AS value, count(*) / (SELECT count(*) FROM jobs_fx) AS s FROM jobs_fx GROUP BY 1)""") + """
SELECT coalesce(r.value, c.value) AS value, round(coalesce(r.s, 0), 6) AS ref_share, round(coalesce(c.s, 0), 6) AS cur_share,
  round(abs(coalesce(r.s, 0) - coalesce(c.s, 0)), 6) AS diff, abs(coalesce(r.s, 0) - coalesce(c.s, 0)) > 0.1 AS drifted
FROM ref r FULL OUTER JOIN cur c ON c.value = r.value"""


def _share_query(col):
    def run(spark, sf_dir):
        out = drift.share_changes(*drift_sides(spark, sf_dir), col)
        return out.withColumns({c: F.round(c, 6) for c in ("ref_share", "cur_share", "diff")})
    return run


for _col in ("job_type", "source"):
    query(f"drift_{_col}", _share_sql(_col))(_share_query(_col))


@query("drift_volume", ctes(JOBS) + f"""
SELECT r AS reference_count, n AS current_count, round(abs(n - r) / r, 6) AS diff, abs(n - r) / r > 0.2 AS drifted
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE created_at < '{WEEK}') AS r FROM jobs_fx)""")
def drift_volume(spark, sf_dir):
    return drift.volume_change(*drift_sides(spark, sf_dir)).withColumn("diff", F.round("diff", 6))


@query("drift_report", _share_sql("job_type").replace("SELECT coalesce(r.value", ", jt AS (SELECT coalesce(r.value").rstrip() + f""")
SELECT FALSE AS schema_drift, d AS distribution_drift, v AS volume_drift, d OR v AS any_drift, r AS reference_count,
  n AS current_count, '' AS new_columns, '' AS missing_columns FROM (
  SELECT (SELECT bool_or(drifted) FROM jt) OR EXISTS (
      SELECT 1 FROM (SELECT source, count(*) / (SELECT count(*) FROM jobs_fx) - count(*) FILTER (WHERE created_at < '{WEEK}')
        / (SELECT count(*) FROM jobs_fx WHERE created_at < '{WEEK}') AS x FROM jobs_fx GROUP BY source) WHERE abs(x) > 0.1) AS d,
    abs(n - r) / r > 0.2 AS v, n, r
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE created_at < '{WEEK}') AS r FROM jobs_fx))""")
def drift_report(spark, sf_dir):
    return drift.drift_report(*drift_sides(spark, sf_dir))
