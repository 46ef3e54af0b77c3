"""Rankings over thousands of distinct sets on both sides, against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from hiresift.operators import match

SKILLS = [f"s{i:02d}" for i in range(14)]


def plain(jobs, psets, keep, limit):
    out = {}
    for known in psets:
        scored = []
        for i, req in jobs:
            m = len(req & known)
            scored.append((-int(round_half_even(100 * m, len(req))), -m, i))
        scored.sort()
        nonzero = [x for x in scored if x[0] < 0]
        rows = nonzero if len(nonzero) >= match.MIN_NONZERO else scored
        out[match.SEP.join(sorted(known))] = [i for _, _, i in rows[:limit]]
    return out


def round_half_even(a, b):
    whole, rest = divmod(a, b)
    return whole + (2 * rest > b or (2 * rest == b and whole % 2))


@pytest.mark.parametrize("long_list", [3, 40])
def test_rankings_equal_every_pair(spark, long_list):
    rng = random.Random(long_list)
    weights = [1 / (k + 1) for k in range(len(SKILLS))]  # one skill in most sets
    draw = lambda most: frozenset(rng.choices(SKILLS, weights, k=rng.randint(1, most)))
    jobs = [(i, draw(12)) for i in range(4000)]
    psets = list({draw(5) for _ in range(1500)} | {frozenset([s]) for s in SKILLS} | {frozenset(["none"]), frozenset(SKILLS)})
    assert len({r for _, r in jobs}) > 1000 and len(psets) > 300
    skills = spark.createDataFrame([(i, sorted(r)) for i, r in jobs], "id long, required array<string>").repartition(4)
    sets = spark.createDataFrame([(match.SEP.join(sorted(p)),) for p in psets], "pset string")
    got = {}
    for r in match.rank_sets(skills, sets, 7, long_list).orderBy("pset", "rank").collect():
        got.setdefault(r.pset, []).append(r.id)
    assert got == plain(jobs, psets, 7, 7)


def test_lists_are_bounded_whatever_the_skill(spark):
    rng = random.Random(1)
    sets = sorted({frozenset(["hot", *rng.sample(SKILLS, rng.randint(1, 4))]) for _ in range(900)}, key=sorted)
    required = spark.createDataFrame([("|".join(sorted(s)), sorted(s), [i]) for i, s in enumerate(sets)], "jset string, req array<string>, ids array<long>")
    lists, long_keys = match.bounded_lists(required, 5, 20)
    sizes = lists.groupBy("key", F.size("req")).count().agg(F.max("count")).first()[0]
    assert sizes <= 20 and len(long_keys) >= 2
    # a set is in a whole list, or its own full key leads to it
    assert lists.select("jset").distinct().count() == len(sets)
