import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.operators import dedup, drift, evaluate, features, match, nb, stats
from hiresift.plans import build
from hiresift.session import work_path
from hiresift.sources import feeds, tables
from hiresift.streaming import incremental
from hiresift.streaming.postings import PostingTable

SKILLS = ["python", "sql", "docker", "aws", "scala", "git", "linux", "react"]


def jobs_frame(spark, rows):
    """rows of dicts -> stored postings."""
    base = dict.fromkeys([f.name for f in S.JOBS.fields])
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], S.JOBS)


def test_keep_first_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [{"id": i, "job_id": f"j{rng.randint(0, 60)}", "company": rng.choice(["a", "b", "c", "", None]),
             "title": f"t{rng.randint(0, 14)}", "location": "x"} for i in range(300)]
    ids, keys, want = set(), set(), []
    for r in rows:
        key = (r["company"], r["title"]) if r["company"] else None
        if r["job_id"] in ids or key in keys:
            continue
        want.append(r["id"])
        ids.add(r["job_id"])
        if key:
            keys.add(key)
    kept = dedup.keep_first(jobs_frame(spark, rows))
    assert sorted(r.id for r in kept.collect()) == want


def test_keep_first_chain(spark):
    rows = [{"id": 1, "job_id": "i1", "company": "a", "title": "k"}, {"id": 2, "job_id": "i2", "company": "a", "title": "k"},
            {"id": 3, "job_id": "i2", "company": "b", "title": "k"}]
    assert sorted(r.id for r in dedup.keep_first(jobs_frame(spark, rows)).collect()) == [1, 3]


def test_append_twice_adds_nothing(spark):
    rows = [{"id": i, "job_id": f"j{i % 7}", "company": "a", "title": f"t{i % 5}"} for i in range(40)]
    table = PostingTable(spark, work_path(spark, "postings"), buckets=4)
    for run in ("one", "two"):
        table.append(jobs_frame(spark, rows), ["id"], run, 0, ids="id")
        assert sorted(r.id for r in table.rows().collect()) == sorted(r.id for r in dedup.keep_first(jobs_frame(spark, rows)).collect())


def test_keep_best(spark):
    rows = [{"id": 1, "company": "a", "title": "t", "description": "xx"}, {"id": 2, "company": "A", "title": "T", "description": "xxx"},
            {"id": 3, "company": "a", "title": "t", "description": "yyy"}, {"id": 4, "company": "", "title": "t"}, {"id": 5, "title": "t"}]
    assert sorted(r.id for r in dedup.keep_best(jobs_frame(spark, rows)).collect()) == [2, 4, 5]


def plain_ranking(jobs, user, limit):
    """Every posting against one profile."""
    scored = []
    for j, required in jobs:
        hits = [s for s in required if s in user]
        scored.append((-round(len(hits) / len(required) * 100), -len(hits), j))
    scored.sort()
    nonzero = [s for s in scored if s[0] < 0]
    return [s[2] for s in (nonzero if len(nonzero) >= 5 else scored)[:limit]]


@pytest.mark.parametrize("n_jobs,limit", [(300, 10), (12, 4)])
def test_ranking_equals_brute_force(spark, n_jobs, limit):
    rng = random.Random(n_jobs)
    jobs = [(i, rng.sample(SKILLS, rng.choice([1, 1, 2, 3, 5, 8]))) for i in range(n_jobs)]
    users = {f"{k}": sorted(rng.sample(SKILLS, k % 5)) for k in range(40)}
    skills = spark.createDataFrame([(i, r, []) for i, r in jobs], "id long, required array<string>, nice array<string>")
    sets = spark.createDataFrame([(p, match.SEP.join(u)) for p, u in users.items()], "profile_id string, pset string")
    ranked = match.rank_sets(skills, sets, limit)
    got = defaultdict(list)
    for r in ranked.orderBy("pset", "rank").collect():
        got[r.pset].append(r.id)
    for user in users.values():
        assert got[match.SEP.join(user)] == plain_ranking(jobs, set(user), limit), user


class PlainNB:
    """Counts in dictionaries, one row at a time."""

    def __init__(self):
        self.docs, self.tokens, self.counts = Counter(), Counter(), defaultdict(Counter)

    def learn(self, words, label):
        self.docs[label] += 1
        for w in words:
            self.counts[w][label] += 1
            self.tokens[label] += 1

    def predict(self, words):
        if not self.docs:
            return None
        n, v = sum(self.docs.values()), len(self.counts)
        score = {c: math.log(d / n) + sum(math.log((self.counts.get(w, {}).get(c, 0) + 1) / (self.tokens[c] + v)) for w in words)
                 for c, d in self.docs.items()}
        return min(score, key=lambda c: (-round(score[c], 9), c))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    return [(i, " ".join(rng.choices(vocab, weights=[5, 1, 1, 1, 1, 1] if i % 3 else [1, 1, 1, 1, 1, 5], k=rng.randint(1, 9))),
             ["x", "y", "z"][min(i % 3, rng.randint(0, 2))]) for i in range(120)]


def test_prequential_equals_plain_loop(spark, labelled):
    df = spark.createDataFrame(labelled, "id long, text string, label string")
    got = {r.id: r.predicted for r in nb.prequential(df, F.col("text"), F.col("label"), ["x", "y", "z"]).collect()}
    model = PlainNB()
    for i, text, label in labelled:
        assert got[i] == model.predict(text.split()), i
        model.learn(text.split(), label)


def test_predict_and_update(spark, labelled):
    df = spark.createDataFrame(labelled, "id long, text string, label string")
    text, label = F.col("text"), F.col("label")
    old = df.where("id < 60")
    model = nb.add_counts(nb.train_counts(old, text, label), nb.train_counts(df.where("id >= 60"), text, label))
    plain = PlainNB()
    for _, t, c in labelled:
        plain.learn(t.split(), c)
    docs = df.unionByName(spark.createDataFrame([(1000, "", ""), (1001, "unseen alpha alpha", "")], df.schema))
    got = {r.id: r.predicted for r in nb.predict(model, docs, text, ["x", "y", "z"]).collect()}
    for r in docs.collect():
        assert got[r.id] == plain.predict(r.text.split()), r
    nothing = nb.train_counts(df.where("id < 0"), text, label)
    assert {r.predicted for r in nb.predict(nothing, docs, text, ["x"]).collect()} == {"unknown"}


def test_split_shares_and_single_row_class(spark):
    docs = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "id long, label string")
    counts = {(r.seed, r.label): r["count"] for r in evaluate.stratified_split(docs).groupBy("seed", "label").count().collect()}
    assert counts == {(s, c): n for s in range(5) for c, n in (("a", 16), ("b", 4))}
    odd = docs.unionByName(spark.createDataFrame([(100, "c")], docs.schema))
    assert {r["count"] for r in evaluate.stratified_split(odd).groupBy("seed").count().collect()} == {20}


def test_evaluate_equals_plain_training(spark, labelled):
    df = spark.createDataFrame(labelled, "id long, text string, label string")
    test = {(r.seed, r.id) for r in evaluate.stratified_split(df.select("id", "label")).collect()}
    got = evaluate.evaluate(df, {"t": F.col("text")}, {"in": ["t"]}, F.col("label"), ["x", "y", "z"]).collect()
    assert {(r.seed, r.id) for r in got} == test
    for seed in range(5):
        model = PlainNB()
        for i, t, c in labelled:
            if (seed, i) not in test:
                model.learn(t.split(), c)
        words = {i: t.split() for i, t, _ in labelled}
        majority = min(model.docs, key=lambda c: (-model.docs[c], c))
        for r in got:
            if r.seed == seed:
                assert (r.predicted, r.majority) == (model.predict(words[r.id]), majority)


def test_drift_limits(spark):
    def side(kinds):
        return tables.drift_view(jobs_frame(spark, [{"id": i, "job_type": k, "source": "s"} for i, k in enumerate(kinds)]))

    ref = side(["a"] * 8 + ["b"] * 2)
    edge = side(["a"] * 9 + ["b"] * 1 + [])
    changes = {r.value: r for r in drift.share_changes(ref, edge, "job_type").collect()}
    assert changes["a"].drifted == (abs(0.8 - 0.9) > 0.1)
    assert not drift.volume_change(ref, side(["a"] * 12)).first().drifted
    assert drift.volume_change(ref, side(["a"] * 13)).first().drifted
    assert not drift.volume_change(side([]), ref).first().drifted
    report = drift.drift_report(ref, side(["a"] * 5 + ["c"] * 5)).first()
    assert report.distribution_drift and not report.volume_drift and not report.schema_drift and report.any_drift
    more = ref.withColumn("extra", F.lit(1)).drop("tags")
    report = drift.drift_report(ref, more).first()
    assert report.schema_drift and report.new_columns == "extra" and report.missing_columns == "tags"


def test_drift_check_stores_then_compares(spark):
    path = work_path(spark, "reference")
    jobs = jobs_frame(spark, [{"id": i, "job_type": "a", "source": "s"} for i in range(10)])
    assert drift.run_drift_check(jobs, path) is None
    assert not drift.run_drift_check(jobs, path).first().any_drift
    twice = jobs.unionByName(jobs)
    assert drift.run_drift_check(twice, path, refresh=True).first().volume_drift
    assert not drift.run_drift_check(twice, path).first().any_drift


def test_constant_salary_gives_zero(spark):
    jobs = jobs_frame(spark, [{"id": 1, "salary_min": 5.0, "salary_max": 1.0}, {"id": 2, "salary_min": 5.0, "salary_max": 3.0}])
    rows = features.salary_scaled(jobs).orderBy("id").collect()
    assert [(r.salary_min_scaled, r.salary_max_scaled) for r in rows] == [(0.0, 0.0), (0.0, 1.0)]


def test_tfidf_by_hand(spark):
    jobs = jobs_frame(spark, [{"id": 1, "description": "spark the spark"}, {"id": 2, "description": "spark sql"}])
    got = {(r.id, r.term): r.weight for r in features.tfidf_weights(jobs, 2).collect()}
    # "spark" occurs three times, the other terms once: the first of them by name fills the place
    assert set(got) == {(1, "spark"), (1, "spark spark"), (2, "spark")}
    assert sum(w * w for (i, _), w in got.items() if i == 1) == pytest.approx(1.0)


def test_job_type_columns(spark):
    jobs = jobs_frame(spark, [{"id": i, "job_type": k} for i, k in enumerate(["a", "b", None, "c"])])
    rows = features.jobtype_dummies(jobs.select("id", "job_type"), ["b", "a"], other=True).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [(False, True, False), (True, False, False), (False, False, True), (False, False, True)]
    assert features.jobtype_dummies(jobs.select("id", "job_type"), ["x"]).columns == ["id", "type_x"]


def test_only_pairs_of_frequent_words_are_counted(spark):
    """The vocabulary against a count of all terms; rare words are no part of a pair that is looked at."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red tree", "blue", "stone", "wall", f"rare{rng.randrange(400)}"]) for _ in range(12)) for _ in range(80)]
    jobs = spark.createDataFrame([(i, "", t, "") for i, t in enumerate(texts)], "id long, title string, description string, tags string")
    every = Counter(t for x in texts for w in [x.split()] for t in [*w, *map(" ".join, zip(w, w[1:]))])
    best = sorted(every.items(), key=lambda e: (-e[1], e[0]))
    for size in (1, 4, 8, 20, 10_000):
        assert {(r.term, r.n) for r in features.tfidf_vocabulary(jobs, size).collect()} == set(best[:size])
    singles = spark.createDataFrame([(w, n) for w, n in every.items() if " " not in w], "term string, total long")
    assert sorted(features._frequent(singles, 4)) == sorted(w for w, n in every.items() if " " not in w and n >= sorted((m for x, m in every.items() if " " not in x))[-4])
    assert features._frequent(singles, 10_000) is None


def test_later_postings_are_transformed_by_the_stored_fit(spark):
    first = jobs_frame(spark, [{"id": 1, "description": "spark the spark", "salary_min": 10.0, "salary_max": 10.0},
                               {"id": 2, "description": "spark sql", "salary_min": 20.0, "salary_max": 10.0}])
    later = jobs_frame(spark, [{"id": 3, "description": "sql unseen SPARK", "salary_min": 25.0, "salary_max": 7.0}, {"id": 4, "description": ""}])
    folder = work_path(spark, "features")
    counts = features.FeatureModel(spark, folder).fit(first, 3)
    model = features.FeatureModel(spark, folder)
    terms = [r.term for r in model.vocabulary().orderBy("pos").collect()]
    assert terms == sorted(terms) and len(terms) == 3
    fitted = {r.id: r for r in model.transform(first, counts).collect()}
    assert fitted == {r.id: r for r in model.transform(first).collect()}
    got = {r.id: r for r in model.transform(later).collect()}
    assert (got[3].salary_min_scaled, got[3].salary_max_scaled) == (1.5, 0.0)
    assert [terms[i] for i in got[3].features.indices] == [t.term for t in got[3].tfidf]
    assert sum(w * w for w in got[3].features["values"]) == pytest.approx(1.0) and got[3].features["size"] == 3
    assert got[4].tfidf == [] and got[4].features.indices == []


def test_low_cardinality(spark):
    df = spark.createDataFrame([(f"v{i % 3}", f"u{i}", None if i else "x") for i in range(200)], "few string, many string, rare string")
    got = {(r.column, r.value): r.n for r in stats.low_cardinality_profile(df).collect()}
    assert got == {("few", "v0"): 67, ("few", "v1"): 67, ("few", "v2"): 66, ("rare", "x"): 1}
    # exactly at the border, whatever buckets the values fall into
    edge = spark.createDataFrame([(f"a{i % 40}", f"b{i % 41}", None) for i in range(1640)], "inside string, outside string, none string")
    got = {r.column for r in stats.low_cardinality_profile(edge, 40).collect()}
    assert got == {"inside"}


PAYLOADS = {
    "a": [{"legal": "notice"}, {"id": "7", "position": "Data Engineer", "tags": ["sql", "etl"], "salary_min": 10, "salary_max": None},
          {"id": "8", "position": "xyz", "description": "zzz"}],
    "b": {"data": [{"slug": "s", "title": "Developer", "remote": True, "created_at": 17, "tags": None}, {"slug": "u", "title": "Developer"}]},
    "c": {"results": [{"id": 3, "name": "Analyst", "categories": [{"name": "Data"}, {"name": "IT"}], "locations": [{"name": "Rome"}, {"name": "Oslo"}],
                       "company": {"name": "Acme"}, "refs": {"landing_page": "u"}}, {"id": 4, "name": "Analyst", "locations": []}]},
    "d": {"results": [{"id": "9", "title": "Cloud", "salary_min": 1.5, "company": {"display_name": "A"}}, {"id": "10", "title": "Zoo", "description": "data"}]},
}


@pytest.mark.parametrize("feed,expected", [
    ("a", [("remoteok_7", "Remote", "remote", 10.0, 0.0, "sql, etl")]),
    ("b", [("arbeitnow_s", "", "remote", 0.0, 0.0, ""), ("arbeitnow_u", "", "onsite", 0.0, 0.0, "")]),
    ("c", [("muse_3", "Rome", "", 0.0, 0.0, "Data, IT"), ("muse_4", "", "", 0.0, 0.0, "")]),
    ("d", [("adzuna_9", "", "", 1.5, 0.0, "")]),
])
def test_feeds_from_files(spark, tmp_path, feed, expected):
    (tmp_path / "page.json").write_text(json.dumps(PAYLOADS[feed]), encoding="utf-8")
    flat = feeds.flatten_feed(feeds.read_payloads(spark, str(tmp_path)), feed)
    got = sorted((r.job_id, r.location, r.job_type, r.salary_min, r.salary_max, r.tags) for r in flat.collect())
    assert got == sorted(expected)


@pytest.mark.parametrize("feed", list(PAYLOADS))
def test_feed_rejects(spark, tmp_path, feed):
    whole = json.dumps(PAYLOADS[feed])
    pages = [(1, whole), (2, whole[:-1]), (3, '{"other": 1}'), (4, None), (5, ""), (6, "[]" if feed == "a" else '{"data": [], "results": []}')]
    payloads = spark.createDataFrame(pages, "page int, payload string")
    got = {r.page: r.reason for r in feeds.feed_rejects(payloads, feed).collect()}
    assert got == {2: "not json", 3: "no list", 4: "not json", 5: "not json"}
    (tmp_path / "page.json").write_text(json.dumps(PAYLOADS[feed], indent=2), encoding="utf-8")
    landed = feeds.read_payloads(spark, str(tmp_path), whole_files=True)
    assert feeds.feed_rejects(landed, feed).isEmpty() and not feeds.flatten_feed(landed, feed).isEmpty()
    by_line = feeds.read_payloads(spark, str(tmp_path))
    assert not feeds.feed_rejects(by_line, feed).isEmpty()


def test_training_run_and_history(spark):
    jobs = jobs_frame(spark, [{"id": i, "title": "Data Scientist" if i % 2 else "Chef", "description": "alpha beta"} for i in range(10)])
    runs = work_path(spark, "runs")
    for run_id, day in (("run-1", "2026-01-01"), ("run-2", "2026-01-02"), ("run-2", "2026-01-02")):
        build.train_and_log(jobs, runs, run_id, day)
    table = spark.read.schema(S.RUNS).parquet(runs)
    history = nb.run_history(table).collect()
    assert [r.run_date for r in history] == ["2026-01-02", "2026-01-01"]
    assert table.first().metrics["category_data_science"] == 5.0 and history[0].jobs == 10.0


def test_batch_build_goes_on_after_a_failed_step(spark):
    rows = [{"id": i, "job_id": f"j{i}", "company": f"c{i}", "title": "Data Engineer", "description": "Python, SQL", "tags": "sql"} for i in range(12)]
    stored = jobs_frame(spark, rows[:8])
    log = build.batch_build(stored, jobs_frame(spark, rows), work_path(spark, "build"), "r", "2026-01-01").collect()
    assert [(r.step, r.outcome) for r in log] == [(s, "done") for s in ("ingest", "clean", "features", "train", "drift")]
    assert log[0].value == 12
    broken = stored.drop("description")
    log = build.batch_build(broken, broken, work_path(spark, "build"), "r", "2026-01-01").collect()
    assert len(log) == 5 and any(r.outcome.startswith("failed") for r in log)


def test_training_refuses_a_new_checkpoint(spark):
    folder = work_path(spark, "train")
    jobs_frame(spark, [{"id": 1, "title": "Data Engineer", "description": "alpha"}]).coalesce(1).write.json(f"{folder}/in")
    run = lambda name: incremental.stream_train(
        incremental.landed(spark, f"{folder}/in"), f"{folder}/model", f"{folder}/{name}", F.col("description"), F.col("title"))
    run("checkpoint")
    run("checkpoint")
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        run("checkpoint-2")


def test_two_days_of_batch_build_lose_nothing(spark):
    rows = [{"id": i, "job_id": f"j{i}", "company": f"c{i}", "title": "Data Engineer", "description": "Python, SQL", "tags": "sql"} for i in range(12)]
    folder = work_path(spark, "build")
    first = build.batch_build(jobs_frame(spark, rows[:4]), jobs_frame(spark, rows[:8]), folder, "day-1", "2026-01-01").collect()
    stored = build.current(spark, folder, "jobs")
    second = build.batch_build(stored, jobs_frame(spark, rows), folder, "day-2", "2026-01-02").collect()
    assert [r.outcome for r in first + second] == ["done"] * 10 and second[0].value == 12
    third = build.batch_build(build.current(spark, folder, "jobs"), jobs_frame(spark, rows).drop("title"), folder, "day-3", "2026-01-03").collect()
    assert third[0].outcome.startswith("failed: ") and len(third[0].outcome) > len("failed: AnalysisException")
    assert build.current(spark, folder, "jobs").count() == 12
