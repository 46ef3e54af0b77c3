"""Queries over filters and scalar functions."""

from pyspark.sql import functions as F

from hiresift.catalog.base import (
    B, CONTEXT, COUNTRY, E, GAZ, JOBS, KNOWN, PROFILES, RESUMES, S, SPLIT, SYN, VOCAB, W, category, city,
    clean_text, company, ctes, extraction, fold, in_list, job_type, joined, jobs_fx, listed, profiles_fx, query,
    quote, relevant, resumes_fx, squeeze, strip, strip_html, table, tag_list, tech, title, words,
)
from hiresift.dims import AMBIGUOUS, EDUCATION, PHONE, US_STATES
from hiresift.functions import places, resume, skills, text
from hiresift.operators import filters, stats
from hiresift.plans.browse import browse_jobs
from hiresift.plans.coaching import parse_resumes

# --- filters ------------------------------------------------------------------------------------


@query("filter_relevant", ctes(JOBS) + f"""SELECT id FROM jobs_fx
WHERE {relevant("lower(concat_ws(' ', coalesce(title, ''), coalesce(tags, ''), coalesce(description, '')))")}""")
def filter_relevant(spark, sf_dir):
    keep = text.is_relevant(F.col("title"), F.col("tags"), F.col("description"))
    return jobs_fx(spark, sf_dir).where(keep).select("id")


@query("filter_tech_title", ctes(JOBS) + f"SELECT id, title FROM jobs_fx WHERE {tech('title')}")
def filter_tech_title(spark, sf_dir):
    return jobs_fx(spark, sf_dir).where(text.is_tech_title(F.col("title"))).select("id", "title")


@query("jobs_by_source", ctes(JOBS) + "SELECT id, title, source FROM jobs_fx WHERE source = 'src2' ORDER BY id LIMIT 5")
def jobs_by_source(spark, sf_dir):
    return filters.by_source(jobs_fx(spark, sf_dir), "src2", 5).select("id", "title", "source")


@query("jobs_by_type", ctes(JOBS) + "SELECT id, title, job_type FROM jobs_fx WHERE job_type = 'remote'")
def jobs_by_type(spark, sf_dir):
    return filters.by_type(jobs_fx(spark, sf_dir), "remote").select("id", "title", "job_type")


@query("search_skill", ctes(JOBS) + """SELECT id, title FROM jobs_fx
WHERE contains(lower(coalesce(tags, '')), 'docker') OR contains(lower(title), 'docker')
  OR contains(lower(coalesce(description, '')), 'docker')""")
def search_skill(spark, sf_dir):
    return filters.search_skill(jobs_fx(spark, sf_dir), "Docker").select("id", "title")


@query("search_title", ctes(JOBS) + """SELECT id, title, company, location FROM jobs_fx
WHERE contains(lower(title), 'data') ORDER BY id LIMIT 10""")
def search_title(spark, sf_dir):
    return filters.search_title(jobs_fx(spark, sf_dir), "data").select("id", "title", "company", "location")


REMOTE = f"""({strip("lower(coalesce(job_type, ''))")} = 'remote' OR regexp_matches(nm, '(^| )(remote|anywhere|worldwide|work from home)( |$)'))"""
PLACED = f"placed AS (SELECT *, {words('location')} AS nm FROM jobs_fx)"
# Country codes by phrase join, then the state rule: (id, codes, remote).
CODES = ",\n".join([PLACED, GAZ, f"""coded AS (
  SELECT p.id, p.location, {REMOTE} AS remote, CASE WHEN g.codes IS NOT NULL THEN g.codes
    WHEN list_has_any(regexp_extract_all(coalesce(p.location, ''), ',{S}*([A-Z]{{2}})(?:$|[^{W}])', 1),
      [{", ".join(map(quote, US_STATES))}]) THEN 'us' ELSE '' END AS codes
  FROM placed p LEFT JOIN (
    SELECT id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes
    FROM placed, gaz WHERE contains(' ' || nm || ' ', ' ' || phrase || ' ') GROUP BY id) g ON g.id = p.id)"""])


def _place_query(q, include_remote=True):
    code = COUNTRY.get(q)
    if q == "remote":
        cond = "remote"
    elif code:
        cond = f"list_contains(string_split(codes, ','), '{code}')"
        if include_remote:
            cond += " OR (remote AND codes = '')"
    else:
        cond = f"contains(' ' || {words('location')}, ' {q}')"
    return ctes(JOBS, CODES) + f"SELECT id, location FROM coded WHERE {cond}"


@query("filter_location_country", _place_query("usa"))
def filter_location_country(spark, sf_dir):
    return filters.by_location(jobs_fx(spark, sf_dir), "USA").select("id", "location")


@query("filter_location_city", _place_query("mun"))
def filter_location_city(spark, sf_dir):
    return filters.by_location(jobs_fx(spark, sf_dir), "Mün").select("id", "location")


@query("filter_location_remote", _place_query("remote"))
def filter_location_remote(spark, sf_dir):
    return filters.by_location(jobs_fx(spark, sf_dir), "Remote").select("id", "location")


@query("filter_location_onsite", _place_query("germany", include_remote=False))
def filter_location_onsite(spark, sf_dir):
    return filters.by_location(jobs_fx(spark, sf_dir), "Germany", include_remote=False).select("id", "location")


@query("unresolved_locations", ctes(JOBS, CODES) + """
SELECT id, location FROM coded WHERE coalesce(location, '') <> '' AND codes = '' AND NOT remote""")
def unresolved_locations(spark, sf_dir):
    return filters.unresolved_locations(jobs_fx(spark, sf_dir)).select("id", "location")


@query("encoding_check", ctes(JOBS) + """
SELECT source, count(*) AS n FROM jobs_fx WHERE contains(description, 'â') GROUP BY source""")
def encoding_check(spark, sf_dir):
    return stats.encoding_check(jobs_fx(spark, sf_dir))


@query("channel_companies", ctes(JOBS) + """
SELECT company, count(*) AS n FROM jobs_fx WHERE contains(lower(company), 'linkedin')
GROUP BY company ORDER BY n DESC, company LIMIT 10""")
def channel_companies(spark, sf_dir):
    return stats.channel_companies(jobs_fx(spark, sf_dir))


# --- text ---------------------------------------------------------------------------------------


@query("strip_html", f"SELECT page_id, {strip_html('html')} AS text FROM pages")
def strip_html_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("clean_text", f"SELECT page_id, {clean_text('html')} AS text FROM pages")
def clean_text_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query("br_to_newline", """
SELECT page_id, replace(replace(replace(html, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)) AS text FROM pages""")
def br_to_newline(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.br_to_newline(F.col("html")).alias("text"))


@query("standardize_job_type", ctes(JOBS) + f"SELECT id, {job_type('job_type')} AS job_type FROM jobs_fx")
def standardize_job_type(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", text.standardize_job_type(F.col("job_type")).alias("job_type"))


@query("ascii_fold", f"SELECT doc_id, {fold('text')} AS folded FROM documents")
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


@query("normalize_company", ctes(JOBS) + f"SELECT id, {company('company')} AS company FROM jobs_fx")
def normalize_company(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", text.normalize_company(F.col("company")).alias("company"))


@query("normalize_title", ctes(JOBS) + f"SELECT id, {title('title')} AS title FROM jobs_fx")
def normalize_title(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", text.normalize_title(F.col("title")).alias("title"))


@query("normalize_city", ctes(JOBS) + f"SELECT id, {city('location')} AS city FROM jobs_fx")
def normalize_city(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", text.normalize_city(F.col("location")).alias("city"))


@query("dedup_key", ctes(JOBS) + f"""
SELECT id, CASE WHEN c <> '' AND t <> '' THEN concat(c, '|', t, '|', l) END AS dkey FROM (
  SELECT id, {company('company')} AS c, {title('title')} AS t, {city('location')} AS l FROM jobs_fx)""")
def dedup_key(spark, sf_dir):
    key = text.dedup_key(F.col("company"), F.col("title"), F.col("location"))
    return jobs_fx(spark, sf_dir).select("id", key.alias("k")).select(
        "id", F.when(F.col("k").isNotNull(), F.concat_ws("|", "k.company", "k.title", "k.city")).alias("dkey")
    )


@query("countries_in", ctes(JOBS, CODES) + "SELECT id, codes FROM coded")
def countries_in(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", joined(places.countries_in(F.col("location")), ",").alias("codes"))


@query("is_remote", ctes(JOBS, CODES) + "SELECT id, remote FROM coded")
def is_remote(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", places.is_remote(F.col("location"), F.col("job_type")).alias("remote"))


# --- skills -------------------------------------------------------------------------------------

PARTS = f"""parts AS (
  SELECT profile_id, unnest(string_split(skills, ',')) AS raw, generate_subscripts(string_split(skills, ','), 1) AS pos
  FROM profiles_fx),
named AS (
  SELECT p.profile_id, p.pos, p.raw, coalesce(y.canonical, p.nm) AS skill
  FROM (SELECT *, {squeeze('lower(raw)')} AS nm FROM parts) p LEFT JOIN syn y ON y.alias = p.nm)"""


@query("normalize_skill", ctes(PROFILES, SYN, PARTS) + """
SELECT raw, skill, count(*) AS n FROM named GROUP BY raw, skill""")
def normalize_skill(spark, sf_dir):
    raw = profiles_fx(spark, sf_dir).select(F.explode(skills.split_list(F.col("skills"))).alias("raw"))
    return raw.groupBy("raw", skills.normalize_skill(F.col("raw")).alias("skill")).agg(F.count("*").alias("n"))


@query("normalize_skills", ctes(PROFILES, SYN, PARTS) + """
SELECT profile_id, string_agg(skill, ', ' ORDER BY pos) AS skills FROM (
  SELECT profile_id, skill, min(pos) AS pos FROM named WHERE skill <> '' GROUP BY profile_id, skill) GROUP BY profile_id""")
def normalize_skills(spark, sf_dir):
    out = skills.normalize_skills(skills.split_list(F.col("skills")))
    return profiles_fx(spark, sf_dir).select("profile_id", joined(out).alias("skills"))


@query("known_skills", ctes(JOBS, VOCAB, SYN, KNOWN) + """
SELECT j.id, coalesce(k.s, '') AS skills FROM jobs_fx j
LEFT JOIN (SELECT id, string_agg(skill, ', ' ORDER BY pos) AS s FROM known GROUP BY id) k USING (id)""")
def known_skills(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", joined(skills.known_skills(F.col("tags"))).alias("skills"))


FOUND = ",\n".join(["scan AS (SELECT id, coalesce(description, '') AS x FROM jobs_fx)", extraction("found", "scan", "id")])


@query("extract_skills", ctes(JOBS, VOCAB, FOUND) + "SELECT id, skill FROM found")
def extract_skills(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", F.explode(skills.extract_skills(F.col("description"))).alias("skill"))


@query("extract_skills_str", ctes(JOBS, VOCAB, FOUND) + """
SELECT j.id, coalesce(f.s, '') AS skills FROM jobs_fx j
LEFT JOIN (SELECT id, string_agg(skill, ', ' ORDER BY ord) AS s FROM found GROUP BY id) f USING (id)""")
def extract_skills_str(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", joined(skills.extract_skills(F.col("description"))).alias("skills"))


@query("extract_ambiguous_skills", ctes(JOBS, VOCAB, FOUND) + f"SELECT id, skill FROM found WHERE skill IN {in_list(AMBIGUOUS)}")
def extract_ambiguous_skills(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", F.explode(skills.extract_ambiguous(F.col("description"))).alias("skill"))


@query("split_required_nice", ctes(JOBS, VOCAB, SYN, KNOWN, SPLIT) + f"""
SELECT id, {listed('pos', 'NOT nice')} AS required, {listed('pos', 'nice')} AS nice FROM split_skills GROUP BY id""")
def split_required_nice(spark, sf_dir):
    jobs = jobs_fx(spark, sf_dir).select("id", "description", skills.known_skills(F.col("tags")).alias("k"))
    split = skills.split_required_nice(F.col("description"), F.col("k"))
    return jobs.where(F.size("k") > 0).select("id", split.alias("s")).select(
        "id", joined("s.required").alias("required"), joined("s.nice").alias("nice")
    )


ONE_PROFILE = "JS, sklearn, postgres, ML, python"
_USER = ["javascript", "scikit-learn", "postgresql", "machine learning", "python"]


@query("match_score", ctes(JOBS, VOCAB, SYN, KNOWN) + f"""
SELECT id, CAST(round_even(100.0 * count(*) FILTER (WHERE skill IN {in_list(_USER)}) / count(*), 0) AS INTEGER) AS pct,
  {listed('pos', f'skill IN {in_list(_USER)}')} AS matched, {listed('pos', f'skill NOT IN {in_list(_USER)}')} AS missing
FROM known GROUP BY id""")
def match_score(spark, sf_dir):
    user = skills.normalize_skills(skills.split_list(F.lit(ONE_PROFILE)))
    jobs = jobs_fx(spark, sf_dir).select("id", skills.known_skills(F.col("tags")).alias("k")).where(F.size("k") > 0)
    return jobs.select("id", skills.match_score(user, F.col("k")).alias("m")).select(
        "id", "m.pct", joined("m.matched").alias("matched"), joined("m.missing").alias("missing")
    )


@query("parse_tags", ctes(JOBS) + f"SELECT id, array_to_string({tag_list('tags')}, '|') AS tags FROM jobs_fx")
def parse_tags(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", joined(text.parse_tags(F.col("tags")), "|").alias("tags"))


@query("assign_category", ctes(JOBS) + f"SELECT id, {category('title')} AS category FROM jobs_fx")
def assign_category(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select("id", text.assign_category(F.col("title")).alias("category"))


@query("model_text", ctes(JOBS) + """
SELECT id, concat(title, ' ', coalesce(tags, ''), ' ', description) AS current_text,
  concat(coalesce(tags, ''), ' ', description) AS no_title_text,
  concat(title, ' ', description, ' ', coalesce(tags, '')) AS combined FROM jobs_fx""")
def model_text(spark, sf_dir):
    t, g, d = F.col("title"), F.col("tags"), F.col("description")
    return jobs_fx(spark, sf_dir).select(
        "id", text.model_text(t, g, d).alias("current_text"),
        text.model_text_no_title(g, d).alias("no_title_text"), text.combined_text(t, d, g).alias("combined"),
    )


# --- resumes ------------------------------------------------------------------------------------

_LOW = "lower(text)"
_YEARS = ", ".join(
    f"try_cast(nullif(regexp_extract({_LOW}, '{p}', 1), '') AS BIGINT)" for p in (
        f"([0-9]+)\\+?{S}*years?{S}*of{S}*experience", f"([0-9]+)\\+?{S}*yrs?{S}*of{S}*experience",
        f"experience{S}*of{S}*([0-9]+)\\+?{S}*years?", f"([0-9]+)\\+?{S}*years?{S}*experience")
)
EXPERIENCE = f"""coalesce({_YEARS}, CASE WHEN contains({_LOW}, 'fresher') OR contains({_LOW}, 'fresh graduate')
  OR contains({_LOW}, 'intern') THEN 0 ELSE 1 END)"""
EDU = "array_to_string(list_filter([" + ", ".join(map(quote, EDUCATION)) + f"], lambda k: contains({_LOW}, k)), ', ')"
_LINES = f"list_transform(list_slice(string_split({strip('text')}, chr(10)), 1, 5), lambda l: {strip('l')})"
NAME = f"""coalesce(list_filter({_LINES}, lambda l: length(l) > 2 AND length(l) < 50 AND NOT regexp_matches(l, '[\\p{{Nd}}²³¹]')
  AND NOT regexp_matches(lower(l), 'resume|cv|curriculum|email|phone'))[1], 'Unknown')"""
EMAIL = f"""coalesce(nullif(regexp_extract(text, '{B}([A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}){E}', 1), ''), 'Not found')"""
PHONE_SQL = f"coalesce(nullif(regexp_extract(text, '{PHONE}'), ''), 'Not found')"


@query("resume_experience", ctes(RESUMES) + f"SELECT resume_id, {EXPERIENCE} AS years FROM resumes_fx")
def resume_experience(spark, sf_dir):
    return resumes_fx(spark, sf_dir).select("resume_id", resume.experience_years(F.col("text")).alias("years"))


@query("resume_education", ctes(RESUMES) + f"SELECT resume_id, {EDU} AS education FROM resumes_fx")
def resume_education(spark, sf_dir):
    return resumes_fx(spark, sf_dir).select("resume_id", joined(resume.education(F.col("text"))).alias("education"))


@query("resume_name", ctes(RESUMES) + f"SELECT resume_id, {NAME} AS name FROM resumes_fx")
def resume_name(spark, sf_dir):
    return resumes_fx(spark, sf_dir).select("resume_id", resume.person_name(F.col("text")).alias("name"))


@query("resume_email", f"SELECT doc_id, {EMAIL} AS email FROM documents")
def resume_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", resume.email(F.col("text")).alias("email"))


@query("resume_phone", f"SELECT doc_id, {PHONE_SQL} AS phone FROM documents")
def resume_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", resume.phone(F.col("text")).alias("phone"))


RESUME_SKILLS = ",\n".join(["rscan AS (SELECT resume_id, text AS x FROM resumes_fx)", extraction("rfound", "rscan", "resume_id")])
RESUME_RECORD = f"""record AS (
  SELECT r.resume_id, {NAME} AS name, {EMAIL} AS email, {PHONE_SQL} AS phone, coalesce(f.s, '') AS skills_str,
    {EXPERIENCE} AS experience_years, {EDU} AS education
  FROM resumes_fx r LEFT JOIN (SELECT resume_id, string_agg(skill, ', ' ORDER BY ord) AS s FROM rfound GROUP BY resume_id) f
    ON f.resume_id = r.resume_id)"""


@query("resume_record", ctes(RESUMES, VOCAB, RESUME_SKILLS, RESUME_RECORD) + "SELECT * FROM record")
def resume_record(spark, sf_dir):
    return parse_resumes(resumes_fx(spark, sf_dir)).drop("skills").withColumn("education", joined("education"))


@query("keyword_context", ctes(JOBS) + f"""
SELECT id, replace(regexp_extract(x, '(?is)(.{{0,40}}?(?:node\\.?js|node{S}+js|node{S}+(?:developer|backend|runtime|server|framework)).{{0,40}})', 1), chr(10), ' ') AS context
FROM (SELECT id, concat(coalesce(description, ''), ' ', coalesce(tags, ''), ' ', coalesce(title, '')) AS x FROM jobs_fx)
WHERE {CONTEXT['node']} ORDER BY id LIMIT 15""")
def keyword_context(spark, sf_dir):
    whole = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("description", "tags", "title")])
    context = resume.keyword_context(whole, AMBIGUOUS["node"])
    rows = jobs_fx(spark, sf_dir).select("id", context.alias("context"))
    return rows.where("context is not null").orderBy("id").limit(15)


_CLAIMS = [
    ("percentage", r"([0-9]+\s*%)"), ("big number (10k, 2m)", rf"{B}([0-9][0-9,\.]*\s*(?:k|m)){E}"),
    ("performance claim", rf"(requests? per second|{B}(?:rps|qps){E})"),
    ("achievement verb", rf"{B}(led|reduced|improved|increased|migrated|scaled|spearheaded){E}"),
    ("fake employer", rf"{B}((?:at|with)\s+(?:xyz|acme|abc)){E}"),
    ("company claim", rf"{B}((?:your|the company''s)\s+(?:mission|culture|values)){E}"),
]
_FLAGS = " || ".join(
    f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda h: concat({quote(label + ': ')}, '''', h, ''''))"
    for label, p in _CLAIMS
)


@query("text_claim_flags", f"""
SELECT conv_id, turn, array_to_string({_FLAGS}, '; ') AS flags, length(regexp_extract_all(text, '\\[[^\\]]+\\]')) AS placeholders,
  length(regexp_extract_all(text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')) AS words FROM conversations""")
def text_claim_flags(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", joined(resume.claim_flags(body), "; ").alias("flags"),
        resume.placeholder_count(body).cast("bigint").alias("placeholders"),
        resume.word_count(body).cast("bigint").alias("words"),
    )


@query("browse_jobs", ctes(JOBS, CODES) + """
SELECT *, count(*) OVER () AS total FROM (
SELECT id, title, company, location, job_type, tags, apply_url FROM jobs_fx JOIN (SELECT id, codes, remote FROM coded) c USING (id)
WHERE job_type = 'remote' AND (contains(lower(coalesce(tags, '')), 'python') OR contains(lower(title), 'python')
  OR contains(lower(coalesce(description, '')), 'python')) AND (list_contains(string_split(codes, ','), 'de') OR (remote AND codes = ''))
ORDER BY id LIMIT 20)""")
def browse(spark, sf_dir):
    return browse_jobs(jobs_fx(spark, sf_dir), job_type="remote", skill="Python", location="Germany", limit=20)
