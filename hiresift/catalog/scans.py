"""Queries over sources and sinks."""

from pyspark.sql import functions as F

from hiresift.catalog.base import (
    JOBS, KEYED, VOCAB, category, clean_text, ctes, extraction, job_type, jobs_fx, query, relevant, tech,
)
from hiresift.operators import dedup
from hiresift.plans.build import feature_table
from hiresift.plans.preprocess import preprocess_jobs
from hiresift.session import work_path
from hiresift.sources import feeds, tables
from hiresift.streaming.postings import PostingTable

PAGE = 50


def as_jobs(spark, sf_dir):
    """The derived postings with the stored types."""
    return jobs_fx(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))


def _page(id_, size):
    return F.floor(id_ / size).alias("page")


def _pages(jobs, feed, size):
    """Payload texts of up to ``size`` postings each, as a feed would land them."""
    item, wrap = PAGES[feed]
    rows = jobs.select("id", _page(F.col("id"), size), item(jobs).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", "item"))), lambda r: r["item"])
    return rows.groupBy("page").agg(F.to_json(wrap(items)).alias("payload"))


def all_payloads(jobs, size=PAGE):
    """page, feed, payload of all feeds: postings meet on their page once, and every feed's payload is made of them there."""
    row = F.struct("id", *[c for c in jobs.columns if c in _USED])
    pages = jobs.select(_page(F.col("id"), size), row.alias("row")).groupBy("page").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    payloads = [F.struct(F.lit(feed).alias("feed"), F.to_json(wrap(F.transform("rows", item))).alias("payload"))
                for feed, (item, wrap) in PAGES.items()]
    return pages.select("page", F.inline(F.array(*payloads)))


def _names(texts):
    return F.transform(texts, lambda t: F.struct(t.alias("name")))


# The items of a page; r is a posting, as a row of a table or as a struct.


def _fields(r, **named):
    return F.struct(*[(r[c] if isinstance(c, str) else c).alias(name) for name, c in named.items()])


def _filled(r, name, then=None):
    return F.when(r[name] != "", r[name] if then is None else then)


def _item_a(r):
    return _fields(
        r, id=r["id"].cast("string"), position="title", company="company", description="description",
        location=_filled(r, "location"), apply_url="apply_url", date="date_posted",
        tags=_filled(r, "tags", F.split(r["tags"], ", ")), salary_min="salary_min", salary_max="salary_max",
    )


def _wrap_a(items):
    notice = F.struct(F.lit("notice").alias("id"), *[
        F.lit(None).cast(t).alias(n) for n, t in (
            ("position", "string"), ("company", "string"), ("description", "string"), ("location", "string"),
            ("apply_url", "string"), ("date", "string"), ("tags", "array<string>"),
            ("salary_min", "double"), ("salary_max", "double"))
    ])
    return F.concat(F.array(notice), items)


def _item_b(r):
    return _fields(
        r, slug=r["id"].cast("string"), title="title", company_name="company", description="description",
        location="location", url="apply_url", remote=r["job_type"] == "remote",
        tags=_filled(r, "tags", F.split(r["tags"], ", ")), created_at=r["id"] + 1_700_000_000,
    )


def _item_c(r):
    return _fields(
        r, id="id", name="title", contents="description", type="job_type", publication_date="date_posted",
        categories=_filled(r, "tags", _names(F.split(r["tags"], ", "))),
        locations=_filled(r, "location", _names(F.array(r["location"], F.lit("Elsewhere")))),
        company=_fields(r, name="company"), refs=_fields(r, landing_page="apply_url"),
    )


def _item_d(r):
    return _fields(
        r, id=r["id"].cast("string"), title="title", description="description", contract_time="job_type",
        redirect_url="apply_url", created="date_posted", salary_min=F.nullif(r["salary_min"], F.lit(0.0)),
        salary_max=F.nullif(r["salary_max"], F.lit(0.0)), category=_fields(r, label="tags"),
        company=_fields(r, display_name="company"), location=_fields(r, display_name="location"),
    )


def _results(items):
    return F.struct(items.alias("results"))


# Feed name -> (item of a posting, payload of the items).
PAGES = {"a": (_item_a, _wrap_a), "b": (_item_b, lambda items: F.struct(items.alias("data"))), "c": (_item_c, _results), "d": (_item_d, _results)}
_USED = ("title", "company", "description", "location", "job_type", "salary_min", "salary_max", "tags", "apply_url", "date_posted")


def _payload(feed):
    return lambda jobs, size=PAGE: _pages(jobs, feed, size)


PAYLOADS = {feed: _payload(feed) for feed in PAGES}

_ALL = "lower(concat(coalesce(title, ''), ' ', tg, ' ', coalesce(description, '')))"
_SRC = "(SELECT *, coalesce(tags, '') AS tg FROM jobs_fx) j"
_BASE = "coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(description, '') AS description"
FLAT = {
    "a": f"""SELECT concat('remoteok_', CAST(id AS STRING)) AS job_id, {_BASE},
  CASE WHEN location = '' THEN 'Remote' ELSE location END AS location, 'remote' AS job_type,
  salary_min, salary_max, tg AS tags, 'remoteok' AS source, apply_url, date_posted
FROM {_SRC} WHERE {relevant(_ALL)}""",
    "b": f"""SELECT concat('arbeitnow_', CAST(id AS STRING)) AS job_id, {_BASE}, location,
  CASE WHEN job_type = 'remote' THEN 'remote' ELSE 'onsite' END AS job_type,
  CAST(0 AS DOUBLE) AS salary_min, CAST(0 AS DOUBLE) AS salary_max, tg AS tags, 'arbeitnow' AS source,
  apply_url, CAST(id + 1700000000 AS STRING) AS date_posted
FROM {_SRC} WHERE {relevant(_ALL)}""",
    "c": f"""SELECT concat('muse_', CAST(id AS STRING)) AS job_id, {_BASE}, location,
  coalesce(job_type, '') AS job_type, CAST(0 AS DOUBLE) AS salary_min, CAST(0 AS DOUBLE) AS salary_max,
  tg AS tags, 'themuse' AS source, apply_url, date_posted
FROM {_SRC} WHERE {relevant(_ALL)}""",
    "d": f"""SELECT concat('adzuna_', CAST(id AS STRING)) AS job_id, {_BASE}, location,
  coalesce(job_type, '') AS job_type, salary_min, salary_max, tg AS tags, 'adzuna' AS source,
  apply_url, date_posted
FROM {_SRC} WHERE {relevant("lower(concat(coalesce(title, ''), '  '))")}""",
}


def _flat(feed):
    def run(spark, sf_dir):
        return feeds.flatten_feed(PAYLOADS[feed](jobs_fx(spark, sf_dir)), feed)
    return run


for _feed in PAYLOADS:
    query(f"flatten_feed_{_feed}", ctes(JOBS) + FLAT[_feed])(_flat(_feed))


@query("union_feeds", ctes(JOBS) + " UNION ALL ".join(
    f"SELECT *, {i} AS feed_ord FROM ({sql})" for i, sql in enumerate(FLAT.values())
))
def union_feeds(spark, sf_dir):
    return feeds.union_feeds({f: _flat(f)(spark, sf_dir) for f in PAYLOADS})


# One page in three is cut short, one is wrapped under another name, one arrives whole.
_BROKEN = {0: "not json", 1: "no list"}


@query("feed_rejects", " UNION ALL ".join(
    f"""SELECT '{f}' AS feed, page, CASE page % 3 {" ".join(f"WHEN {k} THEN '{r}'" for k, r in _BROKEN.items())} END AS reason
FROM (SELECT DISTINCT doc_id // {PAGE} AS page FROM documents) WHERE page % 3 < 2""" for f in PAYLOADS))
def feed_rejects(spark, sf_dir):
    out = None
    for feed, payload in PAYLOADS.items():
        pages = payload(jobs_fx(spark, sf_dir))
        kind = F.pmod("page", F.lit(3))
        damaged = F.when(kind == 0, F.expr("left(payload, length(payload) - 1)")).when(
            kind == 1, F.concat(F.lit('{"page":'), "payload", F.lit("}"))).otherwise(F.col("payload"))
        rejects = feeds.feed_rejects(pages.withColumn("payload", damaged), feed)
        part = rejects.select(F.lit(feed).alias("feed"), "page", "reason")
        out = part if out is None else out.unionByName(part)
    return out


@query("load_jobs_defaults", ctes(JOBS) + """
SELECT job_id, coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(description, '') AS description,
  coalesce(location, '') AS location, coalesce(job_type, '') AS job_type, coalesce(salary_min, 0) AS salary_min,
  coalesce(salary_max, 0) AS salary_max, coalesce(tags, '') AS tags, coalesce(source, '') AS source FROM jobs_fx""")
def load_jobs_defaults(spark, sf_dir):
    return tables.load_jobs(jobs_fx(spark, sf_dir))


# Rows loaded up to the middle of the month are the stored table, the rest is a new batch.
SPLIT_DAY = "2026-02-15"
NEW_ROWS = f"""fresh AS (
  SELECT k.* FROM keyed k
  WHERE created_at >= '{SPLIT_DAY}'
    AND job_id NOT IN (SELECT job_id FROM keyed WHERE created_at < '{SPLIT_DAY}')
    AND NOT (c <> '' AND t <> '' AND (c, t, l) IN (
      SELECT (c, t, l) FROM keyed WHERE created_at < '{SPLIT_DAY}' AND c <> '' AND t <> ''))),
firsts AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id) = 1),
new_rows AS (
  SELECT * FROM firsts WHERE c = '' OR t = ''
  UNION ALL
  SELECT * FROM firsts WHERE c <> '' AND t <> '' QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY id) = 1)"""


STORED = f"""old_firsts AS (SELECT * FROM keyed WHERE created_at < '{SPLIT_DAY}' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id) = 1),
stored AS (
  SELECT * FROM old_firsts WHERE c = '' OR t = ''
  UNION ALL SELECT * FROM old_firsts WHERE c <> '' AND t <> '' QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY id) = 1)"""


@query("ingest_append", ctes(JOBS, KEYED, STORED, NEW_ROWS.replace("FROM keyed WHERE created_at <", "FROM stored WHERE created_at <")) + """
SELECT source, old, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (
  SELECT id, source, TRUE AS old FROM stored UNION ALL SELECT id, source, FALSE FROM new_rows) GROUP BY ALL""")
def ingest_append(spark, sf_dir):
    jobs = as_jobs(spark, sf_dir)
    old = F.col("created_at") < SPLIT_DAY
    table = PostingTable(spark, work_path(spark, "postings"), buckets=16)
    table.append(jobs.where(old), ["id"], "day", 1, F.lit("2026-02-01").cast("timestamp"), ids="id")
    table.append(jobs.where(~old), ["id"], "day", 2, F.lit("2026-02-20").cast("timestamp"), ids="id")
    return table.rows().groupBy("source", old.alias("old")).agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


def _preprocess_sql():
    src = f"""cleaned AS (
  SELECT *, {clean_text('description')} AS cd FROM jobs_fx WHERE {tech('title')}),
scan AS (SELECT id, concat(cd, ' ', coalesce(tags, 'None'), ' ', coalesce(title, 'None')) AS x FROM cleaned)"""
    return ctes(JOBS, VOCAB, src, extraction("found", "scan", "id"), f"""prepared AS (
  SELECT j.id, j.job_id, j.title, j.company, j.cd AS description, j.location, {job_type('j.job_type')} AS job_type,
    j.salary_min, j.salary_max, coalesce(f.s, j.tags) AS tags, j.source, j.apply_url, j.date_posted, j.created_at
  FROM cleaned j LEFT JOIN (SELECT id, string_agg(skill, ', ' ORDER BY ord) AS s FROM found GROUP BY id) f USING (id))""")


PREPROCESSED = _preprocess_sql()


@query("preprocess_jobs", PREPROCESSED + "SELECT * FROM prepared")
def preprocess(spark, sf_dir):
    return preprocess_jobs(jobs_fx(spark, sf_dir))


@query("dedup_cleanup_report", ctes(JOBS, KEYED) + """
SELECT (SELECT count(*) FROM keyed) AS total, count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_delete
FROM (SELECT count(*) AS n FROM keyed WHERE c <> '' AND t <> '' GROUP BY c, t, l HAVING count(*) > 1)""")
def dedup_cleanup_report(spark, sf_dir):
    return dedup.cleanup_report(jobs_fx(spark, sf_dir))


@query("feature_table_roundtrip", ctes(JOBS) + """
SELECT coalesce(job_type, '') AS job_type, count(*) AS n,
  CAST(sum(CASE WHEN list_contains(string_split(coalesce(tags, ''), ', '), 'python') THEN 1 ELSE 0 END) AS BIGINT) AS python,
  CAST(sum(CASE WHEN list_contains(string_split(coalesce(tags, ''), ', '), 'docker') THEN 1 ELSE 0 END) AS BIGINT) AS docker,
  sum(salary_max) AS salary_max FROM jobs_fx GROUP BY coalesce(job_type, '')""")
def feature_table_roundtrip(spark, sf_dir):
    kinds = ["", " Contract ", "Full-Time", "external", "onsite", "remote"]
    wide = feature_table(jobs_fx(spark, sf_dir), job_types=kinds)
    # Parquet takes any name, but not a blank at the edge of a column in every reader
    safe = wide.withColumnsRenamed({f"type_{k}": f"type_{i}" for i, k in enumerate(kinds)})
    back = tables.write_table(safe, work_path(spark, "features"))
    kind = F.coalesce(*[F.when(F.col(f"type_{i}"), F.lit(k)) for i, k in enumerate(kinds)])
    return back.groupBy(kind.alias("job_type")).agg(
        F.count("*").alias("n"), F.sum("skill_python").alias("python"),
        F.sum("skill_docker").alias("docker"), F.sum("salary_max").alias("salary_max"),
    )


BOW = f"lower(strip_accents(x)), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_]'"
MODEL_TEXT = "concat(coalesce(title, ''), ' ', coalesce(tags, ''), ' ', coalesce(description, ''))"
NO_TITLE = "concat(coalesce(tags, ''), ' ', coalesce(description, ''))"
DOCS = f"docs AS (SELECT id, {category('title')} AS label, {MODEL_TEXT} AS x, created_at FROM jobs_fx)"
TOKS = f"""toks AS (
  SELECT id, label, token, count(*) AS n FROM (
    SELECT id, label, unnest(regexp_extract_all({BOW})) AS token FROM docs) GROUP BY id, label, token)"""


@query("last_updated", ctes(JOBS) + "SELECT substr(max(created_at), 1, 10) AS last_updated FROM jobs_fx")
def last_updated(spark, sf_dir):
    return tables.last_updated(jobs_fx(spark, sf_dir))
