"""Query registry, derived views and the SQL pieces that the oracle statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.dims import AMBIGUOUS, DEFAULT, OTHER_CATEGORY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# --- derived views: the same SQL text for Spark and DuckDB --------------------------------------
# The given documents hold no skill words, so postings are derived from them row by row.

JOBS_FX = """
SELECT d.doc_id AS id,
  concat('src', CAST(d.b % 4 AS STRING), '_',
    CAST(CASE WHEN d.doc_id >= 150 AND d.doc_id % 50 = 49 THEN d.b ELSE d.doc_id END AS STRING)) AS job_id,
  CASE d.b % 12 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Senior Data Engineer (m/f/d)' WHEN 2 THEN 'Backend Engineer'
    WHEN 3 THEN 'C++ Developer' WHEN 4 THEN 'Office Clerk' WHEN 5 THEN 'DevOps Engineer (w/m/x)' WHEN 6 THEN 'Data Analyst'
    WHEN 7 THEN 'Security Analyst' WHEN 8 THEN 'Test Engineer' WHEN 9 THEN 'Product Manager' WHEN 10 THEN 'Head Chef'
    ELSE 'Solutions Architect' END AS title,
  CASE d.b % 7 WHEN 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'Acme GmbH' ELSE 'ACME Inc.' END
    WHEN 1 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'Nordwind' ELSE 'Nordwind-LinkedIn' END
    WHEN 2 THEN 'Zürich Analytics AG' WHEN 3 THEN 'Globex' WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS STRING)
    ELSE 'Initech Ltd' END AS company,
  CASE d.doc_id % 8
    WHEN 0 THEN concat('<p>Must have: Pandas, PostgreSQL.</p><p>Good to have: Airflow, Terraform.</p> ', d.t)
    WHEN 1 THEN concat('Daily work is Scala on Apache Spark. Knowledge of Kafka would be great. ', d.t)
    WHEN 2 THEN concat('<div>Stack: R, Go, MySQL &amp; Power BI</div><br>', d.t)
    WHEN 3 THEN concat('Our C# and C++ code runs on old printers; you go there by train. ', d.t)
    WHEN 4 THEN concat('Services written with Go and Rust; a Node.js server in front. Redis would be nice. ', d.t)
    WHEN 5 THEN concat('TypeScript and Vue in the browser. Bonus points: GraphQL. ',
      CASE WHEN d.doc_id % 3 = 0 THEN 'The team is smallâ and old. ' ELSE '' END, d.t)
    WHEN 6 THEN '' ELSE concat('Desirable: Ansible&nbsp;and&nbsp;Jenkins. ', d.t) END AS description,
  CASE d.b % 10 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'München, Germany' WHEN 2 THEN 'New York, NY' WHEN 3 THEN 'Springfield, IL'
    WHEN 4 THEN 'Remote' WHEN 5 THEN 'Remote - US' WHEN 6 THEN 'Lausanne, Vaud' WHEN 7 THEN 'Bangalore, Karnataka'
    WHEN 8 THEN '' ELSE 'Smallville' END AS location,
  CASE d.doc_id % 6 WHEN 0 THEN 'remote' WHEN 1 THEN 'Full-Time' WHEN 2 THEN 'onsite' WHEN 3 THEN ' Contract '
    WHEN 4 THEN 'external' ELSE CAST(NULL AS STRING) END AS job_type,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(30000 + 500 * (d.doc_id % 90) AS DOUBLE) END AS salary_min,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(45000 + 700 * (d.doc_id % 90) AS DOUBLE) END AS salary_max,
  CASE d.doc_id % 9 WHEN 0 THEN 'python, sql, docker' WHEN 1 THEN 'JS, react, sales' WHEN 2 THEN 'sklearn, ML, Python, python'
    WHEN 3 THEN 'c++, c#' WHEN 4 THEN 'golang, k8s, aws' WHEN 5 THEN 'it jobs' WHEN 6 THEN ''
    WHEN 7 THEN CAST(NULL AS STRING) ELSE 'python, apache spark, sql, docker, kubernetes, terraform, aws, gcp' END AS tags,
  concat('src', CAST(d.b % 4 AS STRING)) AS source,
  concat('https://jobs.example.org/', CAST(d.doc_id AS STRING)) AS apply_url,
  concat('2026-01-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0')) AS date_posted,
  concat('2026-02-', lpad(CAST(1 + d.doc_id % 28 AS STRING), 2, '0'), ' 06:00:00') AS created_at
FROM (SELECT doc_id, doc_id % 150 AS b, text AS t FROM {documents}) d
"""

PROFILES_FX = """
SELECT c_custkey AS profile_id,
  CASE c_custkey % 5 WHEN 0 THEN 'JS, sklearn, postgres, ML, python' WHEN 1 THEN 'python, SQL , Docker' WHEN 2 THEN 'cobol'
    WHEN 3 THEN 'C++, c#,  go'
    ELSE concat('pyspark, python, aws, k8s, python',
      CASE c_nationkey % 4 WHEN 0 THEN ', terraform' WHEN 1 THEN ', docker, sql' WHEN 2 THEN ', js, react' ELSE '' END) END AS skills,
  CAST(c_custkey % 12 AS INT) AS experience_years
FROM {customer}
"""

RESUMES_FX = """
SELECT doc_id AS resume_id,
  concat(
    CASE doc_id % 4 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN concat('Curriculum Vitae', chr(10), ' Max Muster ')
      WHEN 2 THEN concat('Resume 2026', chr(10), 'x', chr(10), 'Ana Lima') ELSE '12345' END, chr(10),
    CASE doc_id % 3 WHEN 0 THEN concat('E-mail: user', CAST(doc_id AS STRING), '@mail.example.org', chr(10)) ELSE '' END,
    CASE doc_id % 5 WHEN 0 THEN concat('Tel: (555) 123-4567', chr(10)) ELSE '' END,
    CASE doc_id % 6 WHEN 0 THEN '7+ years of experience with Python and SQL.' WHEN 1 THEN 'Experience of 3 years, C++ and Docker.'
      WHEN 2 THEN 'Fresh graduate, JavaScript and React.' WHEN 3 THEN '10 yrs of experience, Kubernetes, Terraform, AWS.'
      WHEN 4 THEN 'Internal projects: Apache Spark, Python, ML.' ELSE '4 years experience; skills: Go, R, SQL.' END, chr(10),
    CASE doc_id % 7 WHEN 0 THEN 'B.Tech Computer Science' WHEN 1 THEN 'Master of Physics' WHEN 2 THEN 'PhD' ELSE '' END, chr(10),
    text) AS text
FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS_FX, documents=table(spark, sf_dir, "documents"))


def profiles_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROFILES_FX, customer=table(spark, sf_dir, "customer"))


def resumes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESUMES_FX, documents=table(spark, sf_dir, "documents"))


def joined(col, sep: str = ", "):
    """Arrays are compared as text."""
    return F.array_join(col, sep)


# --- SQL pieces ---------------------------------------------------------------------------------

def _plain(sql: str) -> str:
    for name in ("documents", "customer"):
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x):
        return quote(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def in_list(items) -> str:
    return "(" + ", ".join(map(quote, items)) + ")"


def rx_escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


# Unicode-aware classes for DuckDB's regex engine, which has no look-around.
W = r"\p{L}\p{N}_"
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
B = f"(?:^|[^{W}])"
E = f"(?:$|[^{W}])"


def ctes(*parts: str) -> str:
    """WITH clause; a part is either 'name AS (...)' or a list of those."""
    return "WITH " + ",\n".join(parts) + "\n"


JOBS = f"jobs_fx AS ({_plain(JOBS_FX)})"
PROFILES = f"profiles_fx AS ({_plain(PROFILES_FX)})"
RESUMES = f"resumes_fx AS ({_plain(RESUMES_FX)})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def strip_html(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        x = f"replace({x}, '{entity}', '{char}')"
    return squeeze(x)


def clean_text(x: str) -> str:
    return squeeze(f"regexp_replace({strip_html(x)}, '[^{W}\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}.,!?-]', ' ', 'g')")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def fold(x: str) -> str:
    return f"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g'))"


def words(x: str, keep: str = "a-z0-9") -> str:
    return f"array_to_string(regexp_extract_all({fold(x)}, '[{keep}]+'), ' ')"


def company(x: str) -> str:
    from hiresift.dims import LEGAL_FORMS
    toks = f"list_filter(regexp_extract_all({fold(x)}, '[a-z0-9]+'), lambda t: t NOT IN {in_list(LEGAL_FORMS)})"
    sq = f"array_to_string({toks}, '')"
    return (f"CASE WHEN {sq} LIKE '%linkedin' AND length({sq}) >= 11 "
            f"THEN left({sq}, length({sq}) - 8) ELSE {sq} END")


def title(x: str) -> str:
    from hiresift.dims import GENDER_TAG
    t = f"regexp_replace({fold(x)}, '{GENDER_TAG}', ' ', 'g')"
    return f"array_to_string(regexp_extract_all({t}, '[a-z0-9+#]+'), ' ')"


def city(x: str) -> str:
    return f"array_to_string(regexp_extract_all(split_part({fold(x)}, ',', 1), '[a-z0-9]+'), ' ')"


def job_type(x: str) -> str:
    from hiresift.dims import JOB_TYPES
    key = strip(f"lower({x})")
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in JOB_TYPES.items())
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'unknown' ELSE CASE {key} {cases} ELSE {key} END END"


def category(x: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(coalesce({x}, '')), {quote(k)})" for k in kws)
        + f" THEN {quote(name)}"
        for name, kws in DEFAULT.categories.items()
    )
    return f"CASE {cases} ELSE {quote(OTHER_CATEGORY)} END"


def tech(x: str) -> str:
    any_of = "|".join(map(rx_escape, DEFAULT.tech_titles))
    return f"regexp_matches(lower(coalesce({x}, '')), '{B}(?:{any_of}){E}')"


def relevant(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(k)})" for k in DEFAULT.relevant) + ")"


def tag_list(x: str) -> str:
    return f"list_filter(list_transform(string_split(lower(coalesce({x}, '')), ','), lambda t: {strip('t')}), lambda t: t <> '')"


# Keys of the postings: c, t and l; k is null-safe only where both c and t are filled.
KEYED = f"""keyed AS (SELECT *, {company('company')} AS c, {title('title')} AS t, {city('location')} AS l FROM jobs_fx)"""

VOCAB = "vocab AS (SELECT * FROM " + values([(s, i) for i, s in enumerate(DEFAULT.skills)]) + " v(skill, ord))"
SYN = "syn AS (SELECT * FROM " + values(DEFAULT.synonyms.items()) + " s(alias, canonical))"
GAZ = "gaz AS (SELECT * FROM " + values(DEFAULT.place_code.items()) + " g(phrase, code))"
COUNTRY = DEFAULT.country_of

_LEAD = f"(?:^|[,/(:;|]|{B}(?i:in|with|using|and|or){S}){S}*"
_STOP = "to|the|for|a|an|on|beyond|further|above|ahead|back|out|home|live|through"
# "Go" before one of these words is a verb; it is marked first, as there is no look-ahead.
_MARKED = f"regexp_replace(x, 'Go({S}+(?i:{_STOP}){E})', 'G_\\1', 'g')"
CONTEXT = {
    "go": f"(regexp_matches(x, '(?i){B}golang{E}') OR regexp_matches(x, '{B}Go{S}+(?i:language|programming|lang){E}') "
          f"OR regexp_matches({_MARKED}, '(?m){_LEAD}Go(?:$|[^{W}-])'))",
    "r": f"regexp_matches(x, '(?m){_LEAD}R(?:{S}*(?:[,/);|]|$|\\.(?:{S}|$))|{S}+(?i:and|or|programming|language|studio){E})')",
    "ray": f"regexp_matches(x, '(?i){B}ray{S}+(?:serve|train|tune|core|data|cluster|rllib|framework){E}')",
    "agents": f"regexp_matches(x, '(?i){B}llm{S}+agents{E}|{B}agentic{E}|{B}agents?{S}+(?:framework|workflow)s?{E}')",
    "node": f"regexp_matches(x, '(?i){B}node\\.?js{E}|{B}node{S}+js{E}|{B}node{S}+(?:developer|backend|runtime|server|framework){E}')",
}


def extraction(name: str, source: str, keys: str) -> str:
    """CTE (keys, skill, ord): vocabulary items in column x of a source, by one test per item."""
    tests = [
        f"CASE WHEN contains(low, {quote(s)}) THEN CASE WHEN "
        f"regexp_matches(low, '(?:^|[^{W}+#]){rx_escape(s)}(?:$|[^{W}+#])') THEN {quote(s)} END END"
        for s in DEFAULT.skills if s not in AMBIGUOUS
    ] + [f"CASE WHEN {CONTEXT[s]} THEN {quote(s)} END" for s in AMBIGUOUS]
    return f"""{name} AS (
  SELECT {keys}, f.skill, v.ord FROM (
    SELECT {keys}, unnest(list_filter([{", ".join(tests)}], lambda s: s IS NOT NULL)) AS skill
    FROM (SELECT *, lower(x) AS low FROM {source})) f JOIN vocab v ON v.skill = f.skill)"""


# Known skills of the postings in tag order: (id, skill, pos).
KNOWN = f"""tagparts AS (
  SELECT id, unnest(string_split(coalesce(tags, ''), ',')) AS raw,
    generate_subscripts(string_split(coalesce(tags, ''), ','), 1) AS pos FROM jobs_fx),
known AS (
  SELECT id, skill, min(pos) AS pos FROM (
    SELECT p.id, coalesce(y.canonical, p.nm) AS skill, p.pos
    FROM (SELECT id, pos, {squeeze('lower(raw)')} AS nm FROM tagparts) p LEFT JOIN syn y ON y.alias = p.nm)
  WHERE skill IN (SELECT skill FROM vocab) GROUP BY id, skill)"""

_HEADER = (r"nice[\s-]to[\s-]have|good[\s-]to[\s-]have|preferred (?:qualifications|skills|experience)"
           r"|bonus points?|bonus skills|desirable")
_INLINE = (rf"(?:is|are){S}+(?:a{S}+)?(?:plus|bonus|advantage)|{B}a plus{E}|would be (?:a )?(?:plus|great|nice)"
           rf"|{B}bonus{E}|{B}nice to have{E}")

# Required and nice skills of the postings: split_skills (id, skill, pos, nice).
SPLIT = ",\n".join([
    f"""headed AS (
  SELECT id, d, CASE WHEN regexp_matches(d, '(?i){_HEADER}') THEN regexp_extract(d, '(?is)^(.*?)(?:{_HEADER})', 1) ELSE d END AS head
  FROM (SELECT id, coalesce(description, '') AS d FROM jobs_fx WHERE id IN (SELECT id FROM known)))""",
    f"""pieces AS (
  SELECT id, x, regexp_matches(x, '(?i){_INLINE}') AS nice FROM (
    SELECT id, unnest(string_split(regexp_replace(head, '([.!?;]){S}+', '\\1' || chr(1), 'g'), chr(1))) AS x FROM headed)
  UNION ALL SELECT id, substr(d, length(head) + 1), TRUE FROM headed WHERE length(head) < length(d))""",
    extraction("hits", "pieces", "id, nice"),
    """marks AS (SELECT id, skill, bool_or(nice) AS in_nice, bool_or(NOT nice) AS in_req FROM hits GROUP BY id, skill)""",
    """marked AS (
  SELECT k.id, k.skill, k.pos, coalesce(m.in_nice AND NOT m.in_req, FALSE) AS nice
  FROM known k LEFT JOIN marks m ON m.id = k.id AND m.skill = k.skill)""",
    """split_skills AS (
  SELECT id, skill, pos, nice AND NOT bool_and(nice) OVER (PARTITION BY id) AS nice FROM marked)""",
])


def listed(order: str, cond: str = "TRUE", col: str = "skill") -> str:
    return f"coalesce(string_agg({col}, ', ' ORDER BY {order}) FILTER (WHERE {cond}), '')"
