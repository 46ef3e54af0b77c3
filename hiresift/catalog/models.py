"""Queries over features, models, composite jobs and streams."""

from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.catalog.base import JOBS, KEYED, category, city, company, ctes, jobs_fx, query, quote, table, tag_list, tech, title
from hiresift.catalog.aggregates import TOP_SKILL
from hiresift.catalog.scans import BOW, DOCS, FLAT, NEW_ROWS, NO_TITLE, SPLIT_DAY, TOKS, all_payloads, as_jobs
from hiresift.dims import DEFAULT, STOP_WORDS
from hiresift.functions.skills import onehot_name
from hiresift.functions.text import assign_category, model_text, model_text_no_title
from hiresift.operators import evaluate, features, nb, stats
from hiresift.plans import build
from hiresift.session import cut, work_path
from hiresift.sources import feeds
from hiresift.sources.tables import write_report
from hiresift.streaming import incremental
from hiresift.streaming.postings import PostingTable


def _label():
    return assign_category(F.col("title"))


def _text():
    return model_text(F.col("title"), F.col("tags"), F.col("description"))


# --- features -----------------------------------------------------------------------------------

_STOP = "[" + ", ".join(map(quote, STOP_WORDS)) + "]"


def tfidf(limit):
    return f"""words AS (
  SELECT id, list_filter(regexp_extract_all(lower(concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', coalesce(tags, ''))),
    '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM jobs_fx),
flat AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
occ AS (
  SELECT id, word AS term FROM flat
  UNION ALL SELECT id, word || ' ' || nxt FROM (SELECT id, word, lead(word) OVER (PARTITION BY id ORDER BY i) AS nxt FROM flat) WHERE nxt IS NOT NULL),
top AS (SELECT term, count(*) AS n FROM occ GROUP BY term ORDER BY n DESC, term LIMIT {limit}),
tf AS (SELECT id, term, count(*) AS n FROM occ WHERE term IN (SELECT term FROM top) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM jobs_fx)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
weights AS (SELECT tf.id, tf.term, tf.n, tf.n * idf / sqrt(sum(tf.n * idf * tf.n * idf) OVER (PARTITION BY tf.id)) AS weight FROM tf JOIN dfs USING (term))"""


@query("tfidf_vocab", ctes(JOBS, tfidf(500)) + "SELECT term, n, df, round(idf, 6) AS idf FROM top JOIN dfs USING (term)")
def tfidf_vocab(spark, sf_dir):
    return features.tfidf_vocabulary(jobs_fx(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", ctes(JOBS, tfidf(500)) + "SELECT id, term, n, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, sf_dir):
    return features.tfidf_weights(jobs_fx(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_ONEHOT = ", ".join(
    f'CAST(list_contains(tg, {quote(s)}) AS INTEGER) AS "{onehot_name(s)}"' for s in DEFAULT.skills
)


@query("skill_onehot", ctes(JOBS) + f"SELECT id, {_ONEHOT} FROM (SELECT id, {tag_list('tags')} AS tg FROM jobs_fx)")
def skill_onehot(spark, sf_dir):
    return features.skill_onehot(jobs_fx(spark, sf_dir).select("id", "tags")).drop("tags")


_SCALED = ", ".join(
    f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) END AS {c}_scaled"
    for c in ("salary_min", "salary_max")
)


@query("salary_scaled", ctes(JOBS) + f"SELECT id, {_SCALED} FROM jobs_fx")
def salary_scaled(spark, sf_dir):
    out = features.salary_scaled(jobs_fx(spark, sf_dir))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("salary_min_scaled", "salary_max_scaled")])


_KINDS = [" Contract ", "Full-Time", "external", "onsite", "remote"]
_DUMMIES = ", ".join(f"coalesce(job_type = '{k}', FALSE) AS \"type_{k}\"" for k in _KINDS)


@query("jobtype_dummies", ctes(JOBS) + f"SELECT id, {_DUMMIES} FROM jobs_fx")
def jobtype_dummies(spark, sf_dir):
    return features.jobtype_dummies(jobs_fx(spark, sf_dir).select("id", "job_type"), _KINDS)


@query("feature_table", ctes(JOBS, tfidf(500), f"""terms AS (
  SELECT id, string_agg(term || '=' || CAST(CAST(round(weight * 10000) AS BIGINT) AS STRING), ';' ORDER BY term) AS tfidf FROM weights GROUP BY id)""")
  + f"""SELECT id, coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(source, '') AS source, {_ONEHOT}, {_SCALED},
  coalesce(job_type IS NULL, FALSE) AS type_, {_DUMMIES}, coalesce(tfidf, '') AS tfidf
FROM (SELECT *, {tag_list('tags')} AS tg FROM jobs_fx) LEFT JOIN terms USING (id)""")
def feature_table(spark, sf_dir):
    wide = build.feature_table(jobs_fx(spark, sf_dir), job_types=["", *_KINDS])
    pairs = F.transform("tfidf", lambda t: F.concat(
        t["term"], F.lit("="), F.round(t["weight"] * 10000).cast("bigint").cast("string")))
    return wide.drop("job_id", "description", "location", "salary_min", "salary_max", "tags").withColumns({
        "tfidf": F.array_join(pairs, ";"),
        "salary_min_scaled": F.round("salary_min_scaled", 6), "salary_max_scaled": F.round("salary_max_scaled", 6),
    })


# Fitted on the first half of the month; the postings of the other half were not seen then.
_FITTED = f"fit AS (SELECT * FROM jobs_fx WHERE created_at < '{SPLIT_DAY}')"
_SEEN = tfidf(500).replace("FROM jobs_fx", "FROM fit")
_LATER = tfidf(500).split("tf AS")[0].replace("words AS", "words2 AS", 1).replace("flat AS", "flat2 AS", 1).replace("FROM words)", "FROM words2)").replace(
    "FROM flat", "FROM flat2").replace("occ AS", "occ2 AS", 1).split("top AS")[0].rstrip().rstrip(",")
_BOUND = ", ".join(f"CASE WHEN {c}_hi = {c}_lo THEN 0 ELSE round(({c} - {c}_lo) / ({c}_hi - {c}_lo), 6) END AS {c}_scaled" for c in ("salary_min", "salary_max"))


@query("feature_transform", ctes(JOBS, _FITTED, _SEEN, _LATER, """tf2 AS (SELECT id, term, count(*) AS n FROM occ2 WHERE term IN (SELECT term FROM dfs) GROUP BY id, term),
places AS (SELECT term, idf, row_number() OVER (ORDER BY term) - 1 AS pos FROM dfs),
rows2 AS (SELECT id, string_agg(pos || ':' || CAST(CAST(round(10000 * n * idf / norm) AS BIGINT) AS STRING), ';' ORDER BY pos) AS features FROM (
  SELECT t.id, t.n, p.idf, p.pos, sqrt(sum(t.n * p.idf * t.n * p.idf) OVER (PARTITION BY t.id)) AS norm FROM tf2 t JOIN places p USING (term)) GROUP BY id),
bounds AS (SELECT min(salary_min) AS salary_min_lo, max(salary_min) AS salary_min_hi, min(salary_max) AS salary_max_lo, max(salary_max) AS salary_max_hi FROM fit)""")
  + f"""SELECT id, {_BOUND}, CAST((SELECT count(*) FROM dfs) AS INTEGER) AS size, coalesce(features, '') AS features
FROM (SELECT * FROM jobs_fx, bounds) LEFT JOIN rows2 USING (id) WHERE created_at >= '{SPLIT_DAY}'""")
def feature_transform(spark, sf_dir):
    jobs = jobs_fx(spark, sf_dir)
    old = F.col("created_at") < SPLIT_DAY
    model = features.FeatureModel(spark, work_path(spark, "feature-model"))
    model.fit(jobs.where(old))
    out = model.transform(jobs.where(~old))
    entries = F.zip_with("features.indices", "features.values", lambda i, w: F.concat(
        i.cast("string"), F.lit(":"), F.round(w * 10000).cast("bigint").cast("string")))
    return out.select("id", F.round("salary_min_scaled", 6).alias("salary_min_scaled"), F.round("salary_max_scaled", 6).alias("salary_max_scaled"),
                      "features.size", F.array_join(entries, ";").alias("features"))


@query("bag_of_words", f"""SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all({BOW})) AS token FROM (SELECT doc_id, text AS x FROM documents)) GROUP BY doc_id, token""")
def bag_of_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return features.bag_of_words(docs, F.col("text")).withColumnRenamed("id", "doc_id")


# --- naive Bayes --------------------------------------------------------------------------------


def labelled(spark, sf_dir):
    return jobs_fx(spark, sf_dir).select(
        "id", _label().alias("label"), _text().alias("text"), "created_at"
    )


COUNTS = """wc AS (SELECT token, label, sum(n) AS n FROM toks GROUP BY token, label),
lens AS (SELECT d.id, d.label, coalesce(sum(t.n), 0) AS len FROM docs d LEFT JOIN toks t ON t.id = d.id GROUP BY d.id, d.label),
cls AS (SELECT label, count(*) AS docs, sum(len) AS tokens FROM lens GROUP BY label)"""


@query("nb_train_counts", ctes(JOBS, DOCS, TOKS, COUNTS) + """
SELECT label, docs, CAST(tokens AS BIGINT) AS tokens, (SELECT count(DISTINCT token) FROM wc) AS vocab,
  (SELECT count(*) FROM wc w WHERE w.label = c.label) AS distinct_tokens FROM cls c""")
def nb_train_counts(spark, sf_dir):
    token_counts, label_counts = nb.saved(nb.train_counts(jobs_fx(spark, sf_dir), _text(), _label()))
    distinct = token_counts.groupBy("label").agg(F.count("*").alias("distinct_tokens"))
    vocab = token_counts.agg(F.count_distinct("token")).scalar()
    return label_counts.withColumn("vocab", vocab).join(distinct, "label", "left")


# Every document against every class, in full.
PREDICT = """scores AS (
  SELECT l.id, c.label, ln(c.docs / (SELECT sum(docs) FROM cls)) + coalesce(h.s, 0)
    - l.len * ln(greatest(c.tokens + (SELECT count(DISTINCT token) FROM wc), 1)) AS score
  FROM lens l CROSS JOIN cls c LEFT JOIN (
    SELECT t.id, w.label, sum(t.n * ln(w.n + 1)) AS s FROM toks t JOIN wc w ON w.token = t.token GROUP BY t.id, w.label) h
  ON h.id = l.id AND h.label = c.label),
predicted AS (SELECT id, arg_min(label, {'k': -round(score, 9), 'n': label}) AS predicted FROM scores GROUP BY id)"""


@query("nb_predict", ctes(JOBS, DOCS, TOKS, COUNTS, PREDICT) + "SELECT id, predicted FROM predicted")
def nb_predict(spark, sf_dir):
    words = nb.tokenised(jobs_fx(spark, sf_dir), _text(), _label())
    return nb.predicted_or_unknown(nb.saved(nb.counts_of(words)), words)


# Running counts by window functions over the whole table.
PREQUENTIAL = """classes AS (SELECT DISTINCT label FROM docs),
lens AS (SELECT d.id, d.label, coalesce(sum(t.n), 0) AS len FROM docs d LEFT JOIN toks t ON t.id = d.id GROUP BY d.id, d.label),
grid AS (
  SELECT l.id, l.len, c.label, sum(CASE WHEN l.label = c.label THEN 1 ELSE 0 END) OVER w AS docs,
    sum(CASE WHEN l.label = c.label THEN l.len ELSE 0 END) OVER w AS tokens, count(*) OVER w AS seen
  FROM lens l CROSS JOIN classes c WINDOW w AS (PARTITION BY c.label ORDER BY l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firsts AS (SELECT min(id) AS id FROM toks GROUP BY token),
vocab_at AS (SELECT d.id, coalesce(sum(f.n) OVER (ORDER BY d.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS v
  FROM docs d LEFT JOIN (SELECT id, count(*) AS n FROM firsts GROUP BY id) f ON f.id = d.id),
token_at AS (
  SELECT t.id, c.label, t.n, coalesce(sum(CASE WHEN t.label = c.label THEN t.n ELSE 0 END) OVER (
    PARTITION BY t.token, c.label ORDER BY t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM toks t CROSS JOIN classes c),
logs AS (SELECT id, label, sum(n * ln(before + 1)) AS s FROM token_at GROUP BY id, label),
scores AS (
  SELECT g.id, g.label, ln(g.docs / g.seen) + coalesce(h.s, 0) - g.len * ln(greatest(g.tokens + v.v, 1)) AS score
  FROM grid g JOIN vocab_at v ON v.id = g.id LEFT JOIN logs h ON h.id = g.id AND h.label = g.label WHERE g.docs > 0),
predicted AS (SELECT id, arg_min(label, {'k': -round(score, 9), 'n': label}) AS predicted FROM scores GROUP BY id),
scored AS (SELECT d.id, d.label, p.predicted FROM docs d LEFT JOIN predicted p ON p.id = d.id)"""


@query("prequential_accuracy", ctes(JOBS, DOCS, TOKS, PREQUENTIAL) + """
SELECT count(*) AS n_rows, count(predicted) AS n_scored, count(*) FILTER (WHERE predicted = label) AS n_correct,
  round(count(*) FILTER (WHERE predicted = label) / count(predicted), 6) AS accuracy FROM scored""")
def prequential_accuracy(spark, sf_dir):
    return nb.accuracy(nb.prequential(jobs_fx(spark, sf_dir), _text(), _label()))


@query("prequential_curve", ctes(JOBS, DOCS, TOKS, PREQUENTIAL) + """
SELECT trained, round(correct / scored, 6) AS accuracy FROM (
  SELECT count(*) OVER w AS trained, count(predicted) OVER w AS scored,
    sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) OVER w AS correct
  FROM scored WINDOW w AS (ORDER BY id)) WHERE trained % 50 = 0""")
def prequential_curve(spark, sf_dir):
    return nb.accuracy_curve(nb.prequential(jobs_fx(spark, sf_dir), _text(), _label()))


# A model as rows: token counts, label counts, accuracy. The second half of the rows comes as an update.
MODEL_ROWS = """SELECT 'token' AS part, token AS key, label, CAST(sum(n) AS DOUBLE) AS value FROM toks GROUP BY token, label
UNION ALL SELECT 'docs', '', label, CAST(docs AS DOUBLE) FROM cls UNION ALL SELECT 'tokens', '', label, CAST(tokens AS DOUBLE) FROM cls
UNION ALL SELECT 'accuracy', '', '', round(count(*) FILTER (WHERE predicted = label) / count(predicted), 6) FROM scored
UNION ALL SELECT 'trained', '', '', CAST(count(*) AS DOUBLE) FROM scored"""


def model_rows(model):
    tokens, labels = model.counts()
    none = F.lit("")

    def part(df, name, key, label, value):
        return df.select(F.lit(name).alias("part"), key.alias("key"), label.alias("label"), value.cast("double").alias("value"))

    accuracy = model.accuracy()
    return (part(tokens, "token", F.col("token"), F.col("label"), F.col("n"))
            .unionByName(part(labels, "docs", none, F.col("label"), F.col("docs")))
            .unionByName(part(labels, "tokens", none, F.col("label"), F.col("tokens")))
            .unionByName(part(accuracy, "accuracy", none, none, F.col("accuracy")))
            .unionByName(part(accuracy, "trained", none, none, F.col("trained"))))


@query("nb_model_roundtrip", ctes(JOBS, DOCS, TOKS, COUNTS, PREQUENTIAL.replace("\nlens AS", "\nplens AS").replace("FROM lens l", "FROM plens l")) + MODEL_ROWS)
def nb_model_roundtrip(spark, sf_dir):
    model = nb.StoredModel(spark, work_path(spark, "model"))
    model.train(labelled(spark, sf_dir), F.col("text"), F.col("label"))
    return model_rows(model)


# Updates learn the rows of the first half of the month, then the others, each in the order of their ids.
IN_ORDER = f"docs AS (SELECT (CASE WHEN created_at < '{SPLIT_DAY}' THEN 0 ELSE 10000000000 END) + id AS id, label, x, created_at FROM plain_docs)"
DOCS_IN_ORDER = DOCS.replace("docs AS", "plain_docs AS", 1) + ",\n" + IN_ORDER


@query("nb_update", ctes(JOBS, DOCS_IN_ORDER, TOKS, COUNTS, PREQUENTIAL.replace("\nlens AS", "\nplens AS").replace("FROM lens l", "FROM plens l")) + MODEL_ROWS)
def nb_update(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    old = F.col("created_at") < SPLIT_DAY
    model = nb.StoredModel(spark, work_path(spark, "model"))
    for part in (docs.where(old), docs.where(~old)):
        model.update(part, F.col("text"), F.col("label"))
    return model_rows(model)


RUN = """SELECT substr(run, 1, 8) AS run_id, accuracy, jobs, run_date FROM (
  SELECT round(count(*) FILTER (WHERE predicted = label) / count(predicted), 6) AS accuracy, CAST(count(*) AS DOUBLE) AS jobs,
    (SELECT max(created_at) FROM docs) AS day FROM scored), (VALUES ('run-0001-all', NULL), ('run-0003-all', NULL), ('run-0002-all', '2025-12-31')) r(run, given),
  LATERAL (SELECT coalesce(given, day) AS run_date) ORDER BY run_date DESC, run DESC"""


@query("run_history", ctes(JOBS, DOCS, TOKS, PREQUENTIAL) + RUN)
def run_history(spark, sf_dir):
    jobs = jobs_fx(spark, sf_dir)
    day = jobs.agg(F.max("created_at")).first()[0]
    runs = work_path(spark, "runs")
    # one training, whose predictions stand in every run
    scored = build.train(jobs, f"{runs}-model")
    for run, at in (("run-0001-all", day), ("run-0003-all", day), ("run-0002-all", "2025-12-31")):
        build.log_run(scored, runs, run, at)
    history = nb.run_history(spark.read.schema(S.RUNS).parquet(runs))
    return history.withColumn("accuracy", F.round("accuracy", 6))


# --- evaluation ---------------------------------------------------------------------------------

SPLITS = """hashed AS (
  SELECT id, label, seed, row_number() OVER (PARTITION BY seed, label ORDER BY md5(concat(CAST(seed AS STRING), ':', CAST(id AS STRING))), id) AS rn,
    round(0.2 * count(*) OVER (PARTITION BY seed, label)) AS quota
  FROM docs CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS seed)),
test AS (SELECT id, label, CAST(seed AS INTEGER) AS seed FROM hashed WHERE rn <= quota)"""


@query("stratified_split", ctes(JOBS, DOCS, SPLITS) + "SELECT id, label, seed FROM test")
def stratified_split(spark, sf_dir):
    return evaluate.stratified_split(labelled(spark, sf_dir).select("id", "label"))


@query("majority_baseline", ctes(JOBS, DOCS, SPLITS) + """
SELECT seed, arg_min(label, {'k': -n, 'n': label}) AS majority, max(n) AS n FROM (
  SELECT seed, label, count(*) AS n FROM (SELECT CAST(seed AS INTEGER) AS seed, label FROM hashed WHERE rn > quota) GROUP BY seed, label) GROUP BY seed""")
def majority_baseline(spark, sf_dir):
    docs = labelled(spark, sf_dir).select("id", "label")
    # training rows of a class = all rows of the class minus its test rows
    total = docs.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", "n", F.explode(F.array(*map(F.lit, evaluate.SEEDS))).alias("seed"))
    held = evaluate.stratified_split(docs).groupBy("seed", "label").agg(F.count("*").alias("t"))
    left = total.join(held, ["seed", "label"], "left").select(
        "seed", "label", (F.col("n") - F.coalesce("t", F.lit(0))).alias("n"))
    return left.groupBy("seed").agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"), F.max("n").alias("n"))


def _inputs_sql():
    """Two inputs, five splits, every test row against every class, in full."""
    toks = f"""itoks AS (
  SELECT id, label, input, token, count(*) AS n FROM (
    SELECT id, label, 'current' AS input, unnest(regexp_extract_all({BOW})) AS token FROM docs
    UNION ALL SELECT id, {category('title')} AS label, 'no_title' AS input, unnest(regexp_extract_all({BOW})) AS token
    FROM (SELECT *, {NO_TITLE} AS x FROM jobs_fx)) GROUP BY ALL),
train AS (SELECT id, label, CAST(seed AS INTEGER) AS seed FROM hashed WHERE rn > quota),
inputs AS (SELECT unnest(['current', 'no_title']) AS input),
wc AS (SELECT t.input, r.seed, t.token, t.label, sum(t.n) AS n FROM itoks t JOIN train r ON r.id = t.id GROUP BY ALL),
voc AS (SELECT input, seed, count(DISTINCT token) AS v FROM wc GROUP BY ALL),
cls AS (SELECT i.input, r.seed, r.label, count(DISTINCT r.id) AS docs FROM train r CROSS JOIN inputs i GROUP BY ALL),
ctok AS (SELECT input, seed, label, sum(n) AS tokens FROM wc GROUP BY ALL),
tot AS (SELECT input, seed, sum(docs) AS docs, arg_min(label, {{'k': -docs, 'n': label}}) AS majority FROM cls GROUP BY ALL),
lens AS (SELECT i.input, x.seed, x.id, x.label, coalesce(sum(t.n), 0) AS len FROM test x CROSS JOIN inputs i
  LEFT JOIN itoks t ON t.id = x.id AND t.input = i.input GROUP BY ALL),
logs AS (SELECT x.seed, t.input, t.id, w.label, sum(t.n * ln(w.n + 1)) AS s FROM test x JOIN itoks t ON t.id = x.id
  JOIN wc w ON w.input = t.input AND w.seed = x.seed AND w.token = t.token GROUP BY ALL),
scores AS (SELECT l.input, l.seed, l.id, l.label AS truth, c.label, tot.majority, ln(c.docs / tot.docs) + coalesce(h.s, 0)
    - l.len * ln(greatest(coalesce(k.tokens, 0) + coalesce(voc.v, 0), 1)) AS score
  FROM lens l JOIN cls c ON c.input = l.input AND c.seed = l.seed JOIN tot ON tot.input = l.input AND tot.seed = l.seed
  LEFT JOIN voc ON voc.input = l.input AND voc.seed = l.seed
  LEFT JOIN ctok k ON k.input = l.input AND k.seed = l.seed AND k.label = c.label
  LEFT JOIN logs h ON h.input = l.input AND h.seed = l.seed AND h.id = l.id AND h.label = c.label),
scored AS (SELECT input, seed, id, any_value(truth) AS label, any_value(majority) AS majority,
  arg_min(label, {{'k': -round(score, 9), 'n': label}}) AS predicted FROM scores GROUP BY input, seed, id)"""
    return ctes(JOBS, DOCS, SPLITS, toks)


def _f1_sql(by):
    b = ", ".join(by)
    on = " AND ".join(f"x.{c} = y.{c}" for c in (*by, "class"))
    pre = b + ", " if b else ""
    return f"""sides AS (
  SELECT {pre}label AS class, count(*) AS support, 0 AS called, count(*) FILTER (WHERE label = predicted) AS hit FROM scored GROUP BY ALL
  UNION ALL SELECT {pre}predicted, 0, count(*), 0 FROM scored GROUP BY ALL),
classes_f1 AS (SELECT {pre}class, CASE WHEN sum(called) = 0 THEN 0 ELSE sum(hit) / sum(called) END AS precision,
  CASE WHEN sum(support) = 0 THEN 0 ELSE sum(hit) / sum(support) END AS recall,
  CASE WHEN sum(called) + sum(support) = 0 THEN 0 ELSE 2 * sum(hit) / (sum(called) + sum(support)) END AS f1,
  CAST(sum(support) AS BIGINT) AS support FROM sides GROUP BY ALL)"""


def scored_splits(spark, sf_dir):
    rest = model_text_no_title(F.col("tags"), F.col("description"))
    parts = {"title": F.coalesce("title", F.lit("")), "rest": rest}
    return evaluate.evaluate(jobs_fx(spark, sf_dir), parts, {"current": ["title", "rest"], "no_title": ["rest"]}, _label())


_INPUTS = _inputs_sql()


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("eval_summary", _INPUTS + "," + _f1_sql(["input", "seed"]) + """,
per AS (SELECT input, seed, avg(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS acc, avg(CASE WHEN majority = label THEN 1 ELSE 0 END) AS base
  FROM scored GROUP BY input, seed)
SELECT p.input, round(avg(acc), 6) AS accuracy, round(stddev_pop(acc), 6) AS accuracy_std, round(avg(base), 6) AS baseline_accuracy,
  round(avg(f.f1), 6) AS macro_f1, count(*) AS n_splits, (SELECT count(*) FROM jobs_fx) AS n_jobs
FROM per p JOIN (SELECT input, seed, avg(f1) AS f1 FROM classes_f1 GROUP BY input, seed) f ON f.input = p.input AND f.seed = p.seed GROUP BY p.input""")
def eval_summary(spark, sf_dir):
    return _rounded(stored_evaluation(spark, sf_dir), "accuracy", "accuracy_std", "baseline_accuracy", "macro_f1")


def stored_evaluation(spark, sf_dir):
    out = evaluate.summary(scored_splits(spark, sf_dir), jobs_fx(spark, sf_dir).count())
    return write_report(out, work_path(spark, "eval"))


@query("sidebar_stats", _INPUTS + "," + TOP_SKILL + """,
per AS (SELECT seed, avg(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS acc, avg(CASE WHEN majority = label THEN 1 ELSE 0 END) AS base
  FROM scored WHERE input = 'current' GROUP BY seed)
SELECT count(*) AS total, count(*) FILTER (WHERE job_type = 'remote') AS remote, substr(max(created_at), 1, 10) AS last_updated,
  (SELECT top_skill FROM top_skill) AS top_skill, (SELECT round(avg(acc) * 100, 1) FROM per) AS accuracy, (SELECT round(avg(base) * 100, 1) FROM per) AS baseline FROM jobs_fx""")
def sidebar_stats(spark, sf_dir):
    return stats.sidebar_stats(jobs_fx(spark, sf_dir), stored_evaluation(spark, sf_dir))


@query("macro_f1", _INPUTS + "," + _f1_sql(["input", "seed"]) + """
SELECT input, seed, round(avg(f1), 6) AS macro_f1 FROM classes_f1 GROUP BY input, seed""")
def macro_f1(spark, sf_dir):
    report = evaluate.class_report(scored_splits(spark, sf_dir), "input", "seed")
    return _rounded(report.groupBy("input", "seed").agg(F.avg("f1").alias("macro_f1")), "macro_f1")


# Over the test rows of all splits together.
@query("class_report", _INPUTS.replace("scored AS", "all_scored AS") + ", scored AS (SELECT label, predicted FROM all_scored WHERE input = 'current')," + _f1_sql([]) + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM classes_f1
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM classes_f1
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM classes_f1""")
def class_report(spark, sf_dir):
    report = cut(evaluate.class_report(scored_splits(spark, sf_dir).where("input = 'current'")))
    return _rounded(evaluate.with_averages(report), "precision", "recall", "f1")


# --- composite jobs -----------------------------------------------------------------------------


# Half of the rows against all of them is volume drift, so the second call trains and logs a run.
@query("retrain_if_drift", ctes(JOBS, DOCS, TOKS, PREQUENTIAL) + f"""
SELECT 'run-2' AS run_id, round(count(*) FILTER (WHERE predicted = label) / count(predicted), 6) AS accuracy,
  CAST(count(*) AS DOUBLE) AS jobs, '2026-02-28' AS run_date FROM scored
HAVING (SELECT abs(count(*) - count(*) FILTER (WHERE created_at < '{SPLIT_DAY}')) / count(*) FILTER (WHERE created_at < '{SPLIT_DAY}') FROM jobs_fx) > 0.2""")
def retrain_if_drift(spark, sf_dir):
    jobs = as_jobs(spark, sf_dir)
    folder = work_path(spark, "retrain")
    args = f"{folder}/reference", f"{folder}/runs"
    # the first call stores the snapshot of the first days, the second one compares all with it
    build.retrain_if_drift(jobs.where(F.col("created_at") < SPLIT_DAY), *args, "run-1", "2026-02-15")
    report = build.retrain_if_drift(jobs, *args, "run-2", "2026-02-28", refresh=True)
    runs = spark.read.schema(S.RUNS).parquet(args[1]) if report.first().any_drift else spark.createDataFrame([], S.RUNS)
    return nb.run_history(runs).withColumn("accuracy", F.round("accuracy", 6))


@query("batch_build", ctes(JOBS, KEYED, NEW_ROWS, f"""grown AS (
  SELECT title FROM keyed WHERE created_at < '{SPLIT_DAY}' UNION ALL SELECT title FROM new_rows),
sizes AS (SELECT count(*) AS n, count(*) FILTER (WHERE {tech('title')}) AS kept FROM grown)""") + """
SELECT CAST(0 AS INTEGER) AS step_no, 'ingest' AS step, 'done' AS outcome, n AS value FROM sizes
UNION ALL SELECT 1, 'clean', 'done', kept FROM sizes UNION ALL SELECT 2, 'features', 'done', kept FROM sizes
UNION ALL SELECT 3, 'train', 'done', kept FROM sizes UNION ALL SELECT 4, 'drift', 'done', 0 FROM sizes""")
def batch_build(spark, sf_dir):
    jobs = as_jobs(spark, sf_dir)
    old = F.col("created_at") < SPLIT_DAY
    return build.batch_build(
        jobs.where(old), jobs.where(~old), work_path(spark, "build"), "run-1", "2026-02-28", buckets=16
    )


# --- streams ------------------------------------------------------------------------------------
# Two deliveries. Each has a folder of its own, and the second one is read with a new checkpoint: the first is archived by then.


def _deliveries(spark, sf_dir):
    jobs = as_jobs(spark, sf_dir)
    return [jobs.where(F.col("created_at") < SPLIT_DAY), jobs.where(F.col("created_at") >= AGAIN_DAY)]


def _streamed_parts(spark, sf_dir, name, run):
    """Land the two halves of the postings and consume them one after the other; the second run resumes the first."""
    folder = work_path(spark, name)
    first, second = _deliveries(spark, sf_dir)
    for part, delivery in enumerate((first, second.where(F.col("created_at") >= SPLIT_DAY))):
        delivery.write.mode("append").json(f"{folder}/in/part={part}")
        run(incremental.landed(spark, f"{folder}/in/*"), folder)
    return folder


# The second delivery brings the last days of the first one again.
AGAIN_DAY = "2026-02-10"
LOADED = "2026-03-01 06:00:00"
_ARRIVED = f"""arrived AS (
  SELECT *, row_number() OVER (ORDER BY delivery, feed_ord, doc) AS seq FROM (
    {" UNION ALL ".join(f"SELECT job_id, title, company, location, source, {i} AS feed_ord, {d} AS delivery, CAST(split_part(job_id, '_', 2) AS BIGINT) AS doc FROM ({sql})"
                       for i, sql in enumerate(FLAT.values()) for d in (0, 1))})
  WHERE doc IN (SELECT id FROM jobs_fx WHERE (delivery = 0 AND created_at < '{SPLIT_DAY}') OR (delivery = 1 AND created_at >= '{AGAIN_DAY}'))),
akeyed AS (SELECT *, {company('company')} AS c, {title('title')} AS t, {city('location')} AS l FROM arrived),
afirsts AS (SELECT * FROM akeyed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1),
astored AS (SELECT * FROM afirsts WHERE c = '' OR t = ''
  UNION ALL SELECT * FROM afirsts WHERE c <> '' AND t <> '' QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY seq) = 1)"""


def _land_payloads(spark, jobs, folder):
    """One compressed file for each page of each feed, as a fetcher would land them."""
    pages = all_payloads(jobs, 1000).select("feed", F.lpad(F.col("page").cast("string"), 9, "0").alias("page"), "payload")
    pages.write.partitionBy("feed", "page").options(compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).text(folder)


@query("stream_ingest", ctes(JOBS, _ARRIVED) + f"""
SELECT row_number() OVER (ORDER BY seq) AS id, job_id, source, title, CAST('{LOADED}' AS VARCHAR) AS created_at FROM astored""")
def stream_ingest(spark, sf_dir):
    folder = work_path(spark, "stream-ingest")
    table = PostingTable(spark, f"{folder}/table", buckets=16)
    for part, jobs in enumerate(_deliveries(spark, sf_dir)):
        _land_payloads(spark, jobs, f"{folder}/in-{part}")
        payloads = feeds.landed_payloads(spark, f"{folder}/in-{part}")
        incremental.stream_ingest(payloads, table, f"{folder}/checkpoint-{part}", loaded_at=F.lit(LOADED).cast("timestamp"))
    return table.rows().select("id", "job_id", "source", "title", F.col("created_at").cast("string").alias("created_at"))


@query("dedup_cleanup_apply", ctes(JOBS, KEYED) + """
SELECT id, job_id, source FROM keyed WHERE c = '' OR t = ''
UNION ALL SELECT id, job_id, source FROM keyed WHERE c <> '' AND t <> ''
QUALIFY row_number() OVER (PARTITION BY c, t, l ORDER BY length(coalesce(description, '')) DESC, id) = 1""")
def dedup_cleanup_apply(spark, sf_dir):
    table = PostingTable(spark, work_path(spark, "postings"), buckets=16)
    table.load(as_jobs(spark, sf_dir))
    table.clean()
    return table.rows().select("id", "job_id", "source")


@query("stream_nb_update", ctes(JOBS, DOCS_IN_ORDER, TOKS, COUNTS, PREQUENTIAL.replace("\nlens AS", "\nplens AS").replace("FROM lens l", "FROM plens l")) + MODEL_ROWS)
def stream_nb_update(spark, sf_dir):
    folder = _streamed_parts(spark, sf_dir, "stream-model", lambda stream, f: incremental.stream_train(
        stream, f"{f}/model", f"{f}/checkpoint", _text(), _label()))
    return model_rows(nb.StoredModel(spark, f"{folder}/model"))


@query("stream_drift", ctes(JOBS) + f"""
SELECT d OR v AS any_drift, v AS volume_drift, r AS reference_count, n AS current_count FROM (
  SELECT abs(n - r) / r > 0.2 AS v, n, r, EXISTS (
      SELECT 1 FROM (SELECT count(*) / (SELECT count(*) FROM jobs_fx) - count(*) FILTER (WHERE created_at < '{SPLIT_DAY}')
        / (SELECT count(*) FROM jobs_fx WHERE created_at < '{SPLIT_DAY}') AS x FROM jobs_fx GROUP BY coalesce(job_type, '')) WHERE abs(x) > 0.1)
    OR EXISTS (
      SELECT 1 FROM (SELECT count(*) / (SELECT count(*) FROM jobs_fx) - count(*) FILTER (WHERE created_at < '{SPLIT_DAY}')
        / (SELECT count(*) FROM jobs_fx WHERE created_at < '{SPLIT_DAY}') AS x FROM jobs_fx GROUP BY source) WHERE abs(x) > 0.1) AS d
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE created_at < '{SPLIT_DAY}') AS r FROM jobs_fx))""")
def stream_drift(spark, sf_dir):
    folder = _streamed_parts(spark, sf_dir, "stream-drift", lambda stream, f: incremental.stream_drift(
        stream, f"{f}/state", f"{f}/checkpoint"))
    return incremental.drift_reports(spark, f"{folder}/state").select(
        "any_drift", "volume_drift", "reference_count", "current_count")
