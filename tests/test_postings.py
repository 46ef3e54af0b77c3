"""The stored postings, their versions and key index, and sums in order: lost and repeated batches, pruning, plans."""

import glob
import json
import os
import random

from pyspark.sql import functions as F

from hiresift import schema as S
from hiresift.catalog import scans
from hiresift.operators import dedup, drift, keyindex, nb, order
from hiresift.session import work_path
from hiresift.sources import feeds
from hiresift.sources.versions import Versions
from hiresift.streaming import incremental
from hiresift.streaming.postings import PostingTable, marked


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- versions -------------------------------------------------------------------------------------

def test_of_two_writers_one_has_to_look_again(spark):
    folder = work_path(spark, "versions")
    one, two = Versions(spark, folder), Versions(spark, folder)
    assert one.last() == (-1, {})
    assert one.publish(0, {"a": 1}) and not two.publish(0, {"a": 2})
    seen = []

    def work(content):
        seen.append(content)
        if len(seen) == 1:  # the other writer is faster
            two.publish(1, content | {"b": 1})
        return content | {"c": 1}

    assert one.change(work) == (2, {"a": 1, "b": 1, "c": 1}) and len(seen) == 2
    assert one.change(lambda content: None) == (2, {"a": 1, "b": 1, "c": 1})


def test_unnamed_folders_can_be_dropped(spark):
    versions = Versions(spark, work_path(spark, "versions"))
    paths = [versions.write("t", spark.range(i + 1)) for i in range(4)]
    for p in paths[:3]:
        versions.change(lambda content, p=p: {"t": [p]})
    assert sorted(versions.drop_unnamed(keep=1)) == sorted([paths[0], paths[1], paths[3]])
    assert versions.numbers() == [2] and versions.load(versions.last()[1]["t"], "id long").count() == 3


# --- ingest ---------------------------------------------------------------------------------------

def item(n, company="Firm", title="Data Scientist", **more):
    return {"slug": str(n), "title": title, "company_name": company, "description": f"Python {n}", "location": f"Town{n}", **more}


def land(folder, page, items, feed="b"):
    os.makedirs(f"{folder}/feed={feed}", exist_ok=True)
    with open(f"{folder}/feed={feed}/page-{page:04d}.json", "w", encoding="utf8") as f:
        f.write(items if isinstance(items, str) else json.dumps({"data": items}, indent=1))


def take_in(spark, folder, table, checkpoint, **more):
    incremental.stream_ingest(feeds.landed_payloads(spark, folder, **more), table, checkpoint)


def stored(table):
    return [(r.id, r.job_id) for r in table.rows().orderBy("id").collect()]


def test_new_checkpoint_with_archived_input_loses_and_doubles_nothing(spark):
    root = work_path(spark, "ingest")
    table = PostingTable(spark, f"{root}/table", buckets=4)
    land(f"{root}/day1", 2, [item(3), item(4, location="Town3"), item(5)])
    land(f"{root}/day1", 1, [item(0), item(1), item(0), item(2)])
    take_in(spark, f"{root}/day1", table, f"{root}/c1")
    # in the order of the pages; 4 has the key of 3
    first = [(1, "arbeitnow_0"), (2, "arbeitnow_1"), (3, "arbeitnow_2"), (4, "arbeitnow_3"), (5, "arbeitnow_5")]
    assert stored(table) == first
    # the first input is archived; a new checkpoint sees new files alone, with old and new postings in them
    land(f"{root}/day2", 1, [item(1), item(6), item(7, location="Town0"), item(8)])
    land(f"{root}/day2", 2, "{broken")
    land(f"{root}/day2", 3, "[]", feed="z")
    take_in(spark, f"{root}/day2", table, f"{root}/c2")
    assert stored(table) == [*first, (6, "arbeitnow_6"), (7, "arbeitnow_8")]
    assert sorted((r.feed, r.reason) for r in table.rejects().collect()) == [("b", "not json"), ("z", "no such feed")]
    # the old checkpoint goes on where it was, and both add nothing when there is nothing new
    version = table.versions.last()[0]
    take_in(spark, f"{root}/day2", table, f"{root}/c2")
    take_in(spark, f"{root}/day1", table, f"{root}/c1")
    assert table.versions.last()[0] == version and len(stored(table)) == 7


def test_replayed_batch_changes_nothing(spark):
    root = work_path(spark, "replay")
    table = PostingTable(spark, f"{root}/table", buckets=4)
    rows = spark.createDataFrame([(i, f"j{i}", "Cook", f"C{i}", "x", "Here", "s") for i in range(5)],
                                 "pos int, job_id string, title string, company string, description string, location string, source string")
    rows = rows.select("pos", *[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.POSTING.fields])
    assert table.append(rows, ["pos"], "s", 0) == 0 and table.append(rows, ["pos"], "s", 0) == 0
    assert table.append(rows.limit(0), ["pos"], "s", 1) == 1 and table.rows().count() == 5
    # another stream brings the same rows, some without keys: those all come in
    more = rows.unionByName(rows.withColumn("pos", F.col("pos") + 10).withColumn("job_id", F.lit(None).cast("string")).withColumn("company", F.lit("")))
    table.append(more, ["pos"], "t", 0)
    assert [r.job_id for r in table.rows().orderBy("id").collect()] == [f"j{i}" for i in range(5)] + [None] * 5
    assert [r.id for r in table.rows().orderBy("id").collect()] == list(range(1, 11))


def test_marks_choose_rows_and_carry_ids(spark):
    rng = random.Random(7)
    rows = spark.range(0, 3000, 1, 5).select(F.monotonically_increasing_id().alias("_row"), F.concat(F.lit("text "), "id").alias("x")).localCheckpoint()
    for share in (0.0, 0.01, 0.5, 1.0):
        picked = [(r._row, r.x) for r in rows.collect() if rng.random() < share]
        ids = rng.sample(range(10**6), len(picked))
        chosen = spark.createDataFrame([(r, i) for (r, _), i in zip(picked, ids)], "_row long, id long")
        few, many = marked(rows, chosen), marked(rows, chosen, most=-1)
        want = sorted((r, x, i) for (r, x), i in zip(picked, ids))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want


def test_texts_of_known_postings_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("pos"), *[
        {"job_id": F.concat(F.lit("j"), F.col("id")), "title": F.lit("Cook"), "company": F.lit("Firm"), "location": F.lit("Here"),
         "source": F.lit("s"), "description": F.col("id").cast("string")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.POSTING.fields])
    table, plans = PostingTable(spark, work_path(spark, "few"), buckets=4), []
    write = table._write_rows
    monkeypatch.setattr(table, "_write_rows", lambda new: plans.append(plan_of(new)) or write(new))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.append(rows, ["pos"], "s", 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.id, r.job_id, r.description) for r in table.rows().collect()] == [(1, "j0", "0")]
    assert [(r.key, r.id, r.size) for r in table.index("job").collect()] == [("j0", 1, 1)]
    assert "SortMergeJoin" not in plans[0] and "description" not in "".join(x for x in plans[0].splitlines() if "Exchange" in x)


def test_feeds_are_landed_from_one_shuffle(spark):
    rows = [{"id": i, "title": f"t{i}", "company": None if i % 3 else "c", "description": "d" * i, "location": "" if i % 2 else "Here", "job_type": "remote",
             "salary_min": float(i % 4), "salary_max": 5.0, "tags": ["a, b", "", None][i % 3], "apply_url": "u", "date_posted": "2026"} for i in range(25)]
    base = dict.fromkeys([f.name for f in S.JOBS.fields])
    jobs = spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], S.JOBS)
    landed = scans.all_payloads(jobs, 10)
    assert plan_of(landed).count("Exchange") == 1
    want = {(f, r.page, r.payload) for f, payload in scans.PAYLOADS.items() for r in payload(jobs, 10).collect()}
    assert {(r.feed, r.page, r.payload) for r in landed.collect()} == want and len(want) == 12


def test_batches_equal_the_plain_loop(spark):
    rng = random.Random(4)
    table = PostingTable(spark, work_path(spark, "loop"), buckets=8)
    ids, keys, want, number = set(), set(), [], 0
    for batch in range(3):
        rows = []
        for pos in range(60):
            job, firm, town = (rng.choice([None, f"j{rng.randrange(80)}"]), rng.choice(["", None, f"F{rng.randrange(5)} GmbH"]), f"T{rng.randrange(5)}")
            rows.append((pos, job, "Cook", firm, "x", town, "s"))
            key = (firm, town) if firm else None
            if (job is None or job not in ids) and (key is None or key not in keys):
                number += 1
                want.append((number, job, firm, town))
                ids.add(job)
                keys.add(key)
        df = spark.createDataFrame(rows, "pos int, job_id string, title string, company string, description string, location string, source string").repartition(3)
        df = df.select("pos", *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.POSTING.fields])
        table.append(df, ["pos"], "s", batch)
    assert [(r.id, r.job_id, r.company, r.location) for r in table.rows().orderBy("id").collect()] == want
    version = table.compact()
    assert version == 3 and len(table.versions.last()[1]["job"]) == 1
    assert table.index("job").count() == len([w for w in want if w[1]])


def test_a_batch_opens_only_the_buckets_of_its_keys(spark):
    table = PostingTable(spark, work_path(spark, "buckets"), buckets=64)
    jobs = spark.range(500).select("id", F.concat(F.lit("j"), "id").alias("job_id"), *[
        (F.concat(F.lit(f.name), F.col("id")) if f.name in ("title", "company", "location") else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in S.JOBS.fields if f.name not in ("id", "job_id")])
    table.load(jobs)
    batch = dedup.with_key(jobs.where("id in (3, 400)").union(jobs.where("id = 5").withColumn("job_id", F.lit("new")))).select("job_id", "dkey")
    left = keyindex.unknown(batch, "job", table.index("job"), 64)
    assert [r.job_id for r in left.collect()] == ["new"]
    plan = plan_of(left)
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "bucket" in filters and filters.count(",") <= 4
    files = table.index("job").where(F.col("bucket").isin([1, 2, 3])).select("_metadata.file_path").distinct().count()
    assert 0 < files <= 3 < len(table.index("job").inputFiles())
    assert keyindex.unknown(batch, "dup", table.index("dup"), 64).count() == 0


def test_stored_rows_are_pruned_by_source_and_job_type(spark):
    table = PostingTable(spark, work_path(spark, "laid-out"), buckets=4)
    jobs = spark.range(200).select("id", *[
        (F.concat(F.lit("src"), F.col("id") % 4) if f.name == "source" else F.concat(F.lit("kind"), F.col("id") % 3) if f.name == "job_type"
         else F.concat(F.lit(f.name), "id")).cast("string").cast(f.dataType).alias(f.name) if f.name in ("job_id", "title", "company", "location", "source", "job_type")
        else F.lit(None).cast(f.dataType).alias(f.name) for f in S.JOBS.fields if f.name != "id"])
    table.load(jobs)
    chosen = table.rows().where("source = 'src1' and job_type = 'kind2'")
    plan = plan_of(chosen)
    assert "PartitionFilters: [isnotnull(source" in plan and "EqualTo(job_type,kind2)" in plan
    assert sorted(r.id for r in chosen.collect()) == [i for i in range(200) if i % 4 == 1 and i % 3 == 2]


def test_cleaning_rewrites_only_the_places_that_hold_losers(spark):
    root = work_path(spark, "clean")
    table = PostingTable(spark, root, buckets=4)
    rows = [(1, "a", "Cook", "F", "short", "X", "s1"), (2, "b", "Cook", "F", "the longest", "X", "s2"), (3, "c", "Cook", "F", "the longesT", "X", "s2"),
            (4, "d", "Cook", "", "x", "X", "s3"), (5, "e", "Cook", "", "x", "X", "s3"), (6, "f", "Clerk", "G", "x", "Y", "s 4:%")]
    df = spark.createDataFrame(rows, "id long, job_id string, title string, company string, description string, location string, source string")
    table.load(df.select("id", *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.JOBS.fields if f.name != "id"]))
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{root}/rows/*/*/*.parquet")}
    table.clean()
    assert [r.id for r in table.rows().orderBy("id").collect()] == [2, 4, 5, 6]
    assert {r.key for r in table.index("job").collect()} == {"b", "d", "e", "f"}
    assert all(os.path.getmtime(p) == t for p, t in before.items())
    places = table.versions.last()[1]["rows"]
    old = {"/".join(p.split("/")[-3:-1]) for p in before}
    assert {p.split("source=")[1][:2] for p in set(places) & old} == {"s3", "s "}
    version = table.versions.last()[0]
    table.clean()
    assert table.versions.last()[0] == version
    # a place whose name holds signs that paths escape
    more = df.limit(0).union(spark.createDataFrame([(9, "g", "Clerk", "G", "longer text", "Y", "s 4:%")], df.schema))
    both = PostingTable(spark, f"{root}-2", buckets=4)
    both.load(df.union(more).select("id", *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.JOBS.fields if f.name != "id"]))
    both.clean()
    assert [r.id for r in both.rows().orderBy("id").collect()] == [2, 4, 5, 9]


# --- order ----------------------------------------------------------------------------------------

def test_running_sums_of_sparse_ids_in_levels(spark, monkeypatch):
    monkeypatch.setattr(order, "FAN", 3)
    rng = random.Random(1)
    ids = sorted({rng.choice([1, 10 ** 6, 10 ** 12]) * rng.randrange(1, 5000) for _ in range(300)})
    df = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids)], "id long, n long").repartition(5)
    rows = order.running(df, "id", ["n"], before=True, count=17)
    got = {r.id: r.run_n for r in rows.collect()}
    total, want = 0, {}
    for k, i in enumerate(ids):
        want[i], total = total, total + k % 7
    assert got == want
    assert "SinglePartition" not in plan_of(rows)
    numbered = order.numbered(df, "place", 5, "id", count=17)
    assert [r.place for r in numbered.orderBy("id").collect()] == list(range(5, 5 + len(ids)))
    sizes = order.ranges(df, "id", count=17)[0].groupBy("_b").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 60


# --- models and drift -----------------------------------------------------------------------------

def test_updates_go_on_from_the_stored_model(spark):
    rng = random.Random(2)
    words = "spark sql cook chef kitchen data model pasta".split()
    rows = [(10 ** 12 * i, " ".join(rng.choice(words[:4] if i % 3 else words[4:]) for _ in range(6)), ["a", "b", "c"][i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    text, label, classes = F.col("text"), F.col("label"), ["a", "b", "c"]
    whole = nb.StoredModel(spark, work_path(spark, "model"))
    whole.train(docs, text, label, classes)
    parts = nb.StoredModel(spark, work_path(spark, "model"))
    for n, part in enumerate((docs.where(F.col("id") < 40 * 10 ** 12), docs.where(F.col("id") >= 40 * 10 ** 12))):
        parts.update(part, text, label, classes, ("s", n))
    parts.update(docs, text, label, classes, ("s", 1))  # a replay
    for a, b in zip((*whole.counts(), whole.accuracy()), (*parts.counts(), parts.accuracy())):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert whole.accuracy().first().trained == 120 and whole.accuracy().first().scored == 119
    assert nb.StoredModel(spark, work_path(spark, "model")).accuracy().first().accuracy == 0.0


def test_drift_counts_of_parts_add_up(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["s", "t"])) for _ in range(90)]
    df = spark.createDataFrame(rows, "job_type string, source string")
    half = spark.createDataFrame(rows[:40], df.schema)
    rest = spark.createDataFrame(rows[40:], df.schema)
    parts = drift.value_counts(half).unionByName(drift.value_counts(rest))
    assert drift.report_of_counts(drift.value_counts(half), parts).first() == drift.report_of_counts(drift.value_counts(half), drift.value_counts(df)).first()


def test_drift_of_streams_reads_a_batch_once(spark):
    root = work_path(spark, "drift")
    for day, n in enumerate((10, 20, 5)):
        spark.range(n).select("id", F.lit("x").alias("title"), F.lit("onsite" if day < 2 else "remote").alias("job_type"), F.lit("s").alias("source")).coalesce(1).write.json(f"{root}/in{day}")
        incremental.stream_drift(incremental.landed(spark, f"{root}/in{day}"), f"{root}/state", f"{root}/c{day}", another=True)
    reports = incremental.drift_reports(spark, f"{root}/state").orderBy("batch").collect()
    assert [(r.reference_count, r.current_count, r.distribution_drift) for r in reports] == [(10, 30, False), (10, 35, True)]
