"""Match many profiles against many postings: the best postings of every profile.

Scores depend only on two skill sets, so the work is done on distinct sets. Postings with the
same required skills tie and rank by arrival, so the first few ids of each set are enough. Sets
meet through an inverted index on skills that is read in steps of falling score: a set that must
reach 100 % is indexed under its rarest skill alone, and profiles whose ranking is complete leave
before the next step. The result is exact at every step.

Profiles that are left after the last step meet lists of bounded length (``bounded_lists``). There is one for each skill and
size of set. A set that shares just the skills T with a profile ranks behind every set of its size that holds T and came earlier, so of the
list of T the first k sets are enough, whatever its length. A long list is therefore cut to k, and the sets in it are filed under
pairs of their skills as well, then triples, until the lists are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.dims import DEFAULT, Dims
from hiresift.functions.skills import (
    known_skills, match_percent, match_score, normalize_skills, split_list, split_required_nice,
)
from hiresift.functions.text import str_array
from hiresift.session import cut

# Between the skills of a set's name; never part of a skill.
SEP = "\x1f"
# A ranking with this many non-zero scores leaves zero scores out.
MIN_NONZERO = 5
# Falling score steps; bounded lists serve what is below the last one.
STEPS = (100, 75, 50)
# A list of more sets is cut, and its sets are filed under more skills.
LONG_LIST = 256


def job_skills(jobs: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """id, required, nice of every posting with a known skill."""
    tagged = jobs.select("id", "description", known_skills(F.col("tags"), dims).alias("skills"))
    split = split_required_nice(F.col("description"), F.col("skills"), dims)
    return tagged.where(F.size("skills") > 0).select("id", split.alias("s")).select("id", "s.*")


def score_profile(jobs: DataFrame, skills: str, dims: Dims = DEFAULT) -> DataFrame:
    """Every posting with a known skill, scored against one profile: a single scan."""
    user = normalize_skills(split_list(F.lit(skills)), dims)
    scored = job_skills(jobs, dims).withColumn("m", match_score(user, F.col("required")))
    return scored.select("id", "m.*", "required", "nice", F.array_intersect("nice", user).alias("nice_matched"))


def nice_split_rate(jobs: DataFrame, skills: str = "python", dims: Dims = DEFAULT) -> DataFrame:
    """Postings with a nice-to-have split among all that one profile's unlimited ranking lists."""
    rows = score_profile(jobs, skills, dims).agg(
        F.count_if(F.col("pct") > 0).alias("nz"),
        F.count("*").alias("n"),
        F.count_if((F.col("pct") > 0) & (F.size("nice") > 0)).alias("nz_nice"),
        F.count_if(F.size("nice") > 0).alias("n_nice"),
    )
    enough = F.col("nz") >= MIN_NONZERO
    return rows.select(
        F.when(enough, F.col("nz_nice")).otherwise(F.col("n_nice")).alias("with_nice"),
        F.when(enough, F.col("nz")).otherwise(F.col("n")).alias("listed"),
    )


def _set_name(skills: Column) -> Column:
    return F.array_join(F.array_sort(skills), SEP)


def profile_sets(profiles: DataFrame, dims: Dims = DEFAULT) -> DataFrame:
    """profile_id, user (normalised list) and pset, the name of the known part of the list."""
    vocabulary = str_array(dims.skills)
    user = normalize_skills(split_list(F.col("skills")), dims)
    out = profiles.select("profile_id", user.alias("user"))
    return out.withColumn("pset", _set_name(F.array_intersect("user", vocabulary)))


def _required_sets(skills: DataFrame, keep: int) -> DataFrame:
    """Distinct required sets with the first ``keep`` ids of each.

    The row_number filter is applied per task before the shuffle, so a set that a third of all
    postings share arrives as ``keep`` rows per task.
    """
    rows = skills.select("id", F.array_sort("required").alias("req")).withColumn(
        "jset", F.array_join("req", SEP)
    )
    first = Window.partitionBy("jset").orderBy("id")
    rows = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= keep)
    return rows.groupBy("jset").agg(
        F.first("req").alias("req"), F.array_sort(F.collect_list("id")).alias("ids")
    )


def _index(sets: DataFrame, step: int, rarity: DataFrame) -> DataFrame:
    """Inverted index of the sets: one row per indexed skill.

    To score ``step`` or more a profile must hold m of the n skills, so it must hold one of the
    n - m + 1 rarest.
    """
    freq = rarity.agg(F.map_from_entries(F.collect_list(F.struct("skill", "n")))).scalar()
    order = F.transform("req", lambda s: F.struct(F.try_element_at(F.col("freq"), s).alias("n"), s.alias("s")))
    n = F.size("req")
    need = F.greatest(F.ceil(n * F.lit((step - 0.5) / 100)).cast("int"), F.lit(1))
    ranked = sets.withColumn("freq", freq).withColumn("by_rarity", F.array_sort(order)["s"]).drop("freq")
    return ranked.withColumn("prefix", F.slice("by_rarity", F.lit(1), n - need + 1)).select(
        "jset", "req", "ids", "prefix", F.explode("prefix").alias("skill")
    )


def _pairs(users: DataFrame, index: DataFrame, step: int, top: int) -> DataFrame:
    """Scored (profile set, required set) pairs at or above the step, the best ``top`` per profile."""
    n, u = F.size("req"), F.size("known")
    probe = users.select("pset", "known", F.explode("known").alias("skill"))
    common = F.array_intersect("prefix", "known")
    met = (
        probe.join(index, "skill")
        # a short profile cannot reach the step on a long set
        .where(F.least(u, n) >= n * F.lit((step - 0.5) / 100))
        # a pair that shares several indexed skills is kept once
        .where(F.get(common, F.lit(0)) == F.col("skill"))
        .withColumn("m", F.size(F.array_intersect("req", "known")))
        .withColumn("pct", match_percent(F.col("m"), n))
        .where(F.col("pct") >= step)
    )
    best = Window.partitionBy("pset").orderBy(F.desc("pct"), F.desc("m"), F.col("ids")[0])
    return (
        met.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top)
        .select("pset", "pct", "m", "ids")
    )


def _longer(key: str, pool: Column) -> Column:
    """The sorted skill lists of ``key`` with one more skill of the pool behind their last one."""
    later = F.filter(pool, lambda t: t > F.element_at(key, -1))
    return F.transform(later, lambda t: F.concat(key, F.array(t)))


def bounded_lists(required: DataFrame, keep: int, long_list: int = LONG_LIST) -> tuple[DataFrame, list[DataFrame]]:
    """(key, jset, req, ids): sets filed under keys, sorted lists of skills that they hold; and per level the keys that are long.

    A list is a key with a size of set. One of at most ``long_list`` sets is whole. Of a longer one the ``keep`` sets that came
    first stay, and all its sets are filed under the key with each further skill. Every set that shares the skills T with a profile and is among
    the profile's best ``keep`` stands in a whole list of a part of T, or at the head of the list of T.
    """
    n = F.size("req")
    rows = cut(required.select(F.explode(F.transform("req", lambda s: F.array(s))).alias("key"), "jset", "req", "ids", n.alias("n")))
    lists, long_keys = None, []
    while True:
        # a long list has more than long_list rows, so these are few beside the rows
        long = cut(rows.groupBy("key", "n").agg(F.count("*").alias("len")).where(F.col("len") > long_list).select("key", "n"))
        whole = rows.join(long, ["key", "n"], "left_anti")
        heads = rows.join(long, ["key", "n"], "left_semi")
        first = Window.partitionBy("key", "n").orderBy(F.col("ids")[0])
        head = heads.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= keep)
        part = whole.select("key", "jset", "req", "ids").unionByName(head.select("key", "jset", "req", "ids"))
        lists = part if lists is None else lists.unionByName(part)
        if long.isEmpty():
            return lists, long_keys
        long_keys.append(long.select("key").distinct())
        rows = cut(heads.select("jset", "req", "ids", "n", F.explode(_longer("key", F.col("req"))).alias("key")).select("key", "jset", "req", "ids", "n"))


def _meet_lists(users: DataFrame, required: DataFrame, keep: int, long_list: int) -> DataFrame:
    """pset, pct, m, ids: for each profile set all pairs of the lists that its skills name; holds the best ``keep`` of its pairs."""
    lists, long_keys = bounded_lists(required, keep, long_list)
    lists = cut(lists)
    known = F.array_sort("known").alias("known")
    probe = users.select("pset", known).select("pset", "known", F.explode(F.transform("known", lambda s: F.array(s))).alias("key"))
    probes = probe
    for long in long_keys:
        probe = probe.join(long, "key", "left_semi").select("pset", "known", F.explode(_longer("key", F.col("known"))).alias("key"))
        probes = probes.unionByName(probe)
    m, n = F.size(F.array_intersect("req", "known")), F.size("req")
    met = probes.join(lists, "key").select("pset", "jset", m.alias("m"), match_percent(m, n).alias("pct"), "ids")
    # a pair that several lists name is one
    return met.groupBy("pset", "jset").agg(*[F.first(c).alias(c) for c in ("pct", "m", "ids")]).drop("jset")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """pset, pct, m, id, rank, nonzero: the best ``keep`` postings of each profile set."""
    best = Window.partitionBy("pset").orderBy(F.desc("pct"), F.desc("m"), F.col("ids")[0])
    some = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= keep)
    rows = some.select("pset", "pct", "m", F.explode("ids").alias("id"))
    best = Window.partitionBy("pset").orderBy(F.desc("pct"), F.desc("m"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    return ranked.withColumn("nonzero", F.count_if(F.col("pct") > 0).over(Window.partitionBy("pset")))


def rank_sets(skills: DataFrame, sets: DataFrame, limit: int, long_list: int = LONG_LIST) -> DataFrame:
    """pset, rank, id: the best ``limit`` postings of every distinct profile set.

    If at least MIN_NONZERO postings score above zero only those are listed, else zero scores
    follow in arrival order.
    """
    keep = max(limit, MIN_NONZERO)
    users = cut(
        sets.select("pset").distinct().withColumn(
            "known", F.filter(F.split("pset", SEP), lambda s: s != "")
        )
    )
    required = cut(_required_sets(skills, keep))
    rarity = required.select(F.explode("req").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    done, left = None, users
    for step in STEPS:
        ranked = cut(_best(_pairs(left, _index(required, step, rarity), step, keep), keep))
        full = ranked.where(F.col("nonzero") >= keep)
        left = left.join(full.select("pset").distinct(), "pset", "left_anti")
        done = full if done is None else done.unionByName(full)
        if left.isEmpty():
            break
    else:
        done = done.unionByName(cut(_best(_meet_lists(left, required, keep, long_list), keep)))
    enough = F.col("nonzero") >= MIN_NONZERO
    listed = done.where(~enough | (F.col("pct") > 0))
    return _with_zero_scores(listed, users, skills, limit).where(F.col("rank") <= limit)


def _with_zero_scores(listed: DataFrame, users: DataFrame, skills: DataFrame, limit: int) -> DataFrame:
    """Fill short rankings with postings that share no skill, in arrival order.

    A ranking that lacks rows lists all its overlapping postings, fewer than ``limit``, so the
    first 2 * limit postings of all hold every row it can still get.
    """
    first = skills.select("id").orderBy("id").limit(2 * limit)
    pool = first.agg(F.array_sort(F.collect_list("id"))).scalar()
    state = listed.groupBy("pset").agg(
        F.max("nonzero").alias("nonzero"), F.collect_list("id").alias("have")
    )
    short = users.select("pset").join(state, "pset", "left").where(
        F.coalesce("nonzero", F.lit(0)) < MIN_NONZERO
    )
    none = F.array().cast("array<bigint>")
    have = F.coalesce("have", none)
    fill = short.withColumn("pool", pool).select(
        "pset", F.size(have).alias("n"), F.posexplode(F.array_except("pool", have)).alias("pos", "id")
    )
    fill = fill.select("pset", (F.col("n") + F.col("pos") + 1).alias("rank"), "id")
    return listed.select("pset", "rank", "id").unionByName(fill)


def top_jobs(jobs: DataFrame, profiles: DataFrame, limit: int = 10, dims: Dims = DEFAULT) -> DataFrame:
    """Match record of the best postings per profile.

    profiles: profile_id, skills (comma list). Rank by percent, then skills matched, then arrival.
    """
    records, sets = set_records(jobs, profiles, limit, dims)
    return sets.select("profile_id", "pset").join(records, "pset").drop("pset")


def set_records(
    jobs: DataFrame, profiles: DataFrame, limit: int, dims: Dims = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Match records per distinct profile set, and the profiles with their sets."""
    # the skill table is read three times below and needs the whole texts only once
    skills = cut(job_skills(jobs, dims))
    sets = profile_sets(profiles, dims)
    ranked = rank_sets(skills, sets, limit)
    listed = ranked.select("id").distinct()
    info = jobs.select("id", "title", "company", "location", "job_type", "tags", "apply_url")
    detail = skills.join(listed, "id", "left_semi").join(info, "id")
    known = F.filter(F.split("pset", SEP), lambda s: s != "")
    records = ranked.join(detail, "id").withColumn("k", known)
    records = records.withColumn("score", match_score(F.col("k"), F.col("required"))).select(
        "pset", "rank", "id", "title", "company", "location", "job_type", "tags", "apply_url",
        "score.*", "required", "nice", F.array_intersect("nice", "k").alias("nice_matched"),
    )
    return records, sets


def match_line() -> Column:
    """One line of the match report."""
    def names(col: str) -> Column:
        return F.when(F.size(col) == 0, F.lit("none")).otherwise(F.array_join(col, ", "))

    return F.format_string(
        "- %s at %s (%s) | Real Match: %d%% | Matched Skills: %s | Missing Skills: %s",
        F.coalesce("title", F.lit("None")), F.coalesce("company", F.lit("None")),
        F.coalesce("location", F.lit("None")), "pct", names("matched"), names("missing"),
    )


def report_by_set(records: DataFrame, best: int = 5, gaps: int = 10) -> DataFrame:
    """Per profile set: match lines in rank order, and the most frequent missing skills."""
    lines = records.groupBy("pset").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", match_line().alias("line")))),
                        lambda r: r["line"]), "\n",
        ).alias("lines")
    )
    top = missing_by_set(records, best, gaps).groupBy("pset").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", "skill"))), lambda r: r["skill"]), ", "
        ).alias("top_missing")
    )
    return lines.join(top, "pset", "left").withColumn("top_missing", F.coalesce("top_missing", F.lit("")))


def missing_by_set(records: DataFrame, best: int = 5, gaps: int = 10) -> DataFrame:
    """Skills missing in the best postings of a set: most frequent first, then by name."""
    missing = records.where(F.col("rank") <= best).select("pset", F.explode("missing").alias("skill"))
    counts = missing.groupBy("pset", "skill").agg(F.count("*").alias("n"))
    order = Window.partitionBy("pset").orderBy(F.desc("n"), "skill")
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= gaps)


def top_missing_skills(
    jobs: DataFrame, profiles: DataFrame, best: int = 5, gaps: int = 10, dims: Dims = DEFAULT
) -> DataFrame:
    records, sets = set_records(jobs, profiles, 10, dims)
    return sets.select("profile_id", "pset").join(missing_by_set(records, best, gaps), "pset").drop("pset")
