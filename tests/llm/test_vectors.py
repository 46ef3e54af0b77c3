"""Clusters and hard negatives against plain loops over exact integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresift.llm import clusters, negatives, queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string, key string, cell string"


def table(spark, rows):
    """Rows (id, vector, label), with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "w") for i, v, label in rows], SCHEMA).repartition(4)


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(math.floor(scale * float(np.float32(x))) for x in v)


def near(rng, width, centre=None, spread=1.0):
    return [float((centre[i] if centre else 0) + rng.gauss(0, spread)) for i in range(width)]


# --- hard negatives -------------------------------------------------------------------------------

def plain_negatives(rows, positives=5, negatives_=10):
    kept = sorted({(i, whole(v, 256), label) for i, v, label in rows if i is not None and label is not None and whole(v, 256) is not None})
    out = []
    for a, x, label in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, y, other in kept if i != a and len(x) == len(y))
        for s, p, _ in [t for t in scored if t[2]][:positives]:
            inside = [(t, i) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives_]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    found = negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    centres = [near(rng, 24) for _ in range(5)]
    rows = [(i, near(rng, 24, centres[i % 5], 0.4), i % 3) for i in range(600)]
    for least in (negatives.LEAST_BYTES, 4_000):
        monkeypatch.setattr(negatives, "LEAST_BYTES", least)
        got = mined(spark, rows)
        assert got == plain_negatives(rows) and len(got) > 200


def test_negatives_of_odd_rows(spark):
    rng = random.Random(4)
    hot = near(rng, 6)
    rows = [(i, hot, i % 2) for i in range(90, 130)]  # equal scores everywhere: ties by id
    rows += [(i, [x * 0.5 for x in hot], 1 - i % 2) for i in range(190, 215)]
    rows += [(300, hot, 0), (300, hot, 0), (301, None, 1), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [math.nan] * 6, 1), (304, [math.inf] * 6, 0),
             (400, hot, None), (None, hot, 0), (500, [], 0), (501, [], 0), (502, [], 1), (600, hot[:3], 0), (601, hot[:3], 0), (602, [x / 2 for x in hot[:3]], 1)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows)
    # a score of zero has a window of zero alone; vectors meet those of their length
    assert (500, 501, 1, 502, 0, 0) in got and {r[3] for r in got if r[0] == 600} == {602}
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-500_000, 500_000)) for _ in range(40)], i // 10 % 2) for i in range(0, 300, 10)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and max(r[4] for r in got) > 2 ** 53


def test_vertical_scan_narrows_the_candidates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 60, (64, 2000)).astype(np.int32)
    x[40:] //= 40  # late columns say little
    block = negatives.Block(64, np.arange(2000).tobytes(), np.zeros(2000, np.int64).tobytes(), x.tobytes())
    anchor = x[:, 7].astype(np.int64)
    scores = anchor @ x.astype(np.int64)
    want = sorted(range(2000), key=lambda i: (-scores[i], i))
    (top, values), (mid, _) = negatives.search(block, anchor, np.arange(2000), [(-(1 << 62), 1 << 62), (0, int(scores.max()) // 2)], 5)
    assert top.tolist() == want[:5] and values.tolist() == [scores[i] for i in want[:5]]
    assert mid.tolist() == [i for i in want if 0 <= scores[i] <= int(scores.max()) // 2][:5]


# --- clusters -------------------------------------------------------------------------------------

def plain_clusters(rows, k=8, rounds=10, width=64):
    kept = [(i, whole(v, 1024)) for i, v, _ in rows if v is not None and len(v) == width and whole(v, 1024) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [c for _, c in order[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        centres = [tuple(sum(col) // len(members[j]) for col in zip(*members[j])) if j in members else c for j, c in enumerate(centres)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for i, j, d in found), key=str)


def clustered(spark, rows):
    found = clusters.cluster(table(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    centres = [near(rng, 64) for _ in range(6)]
    rows = [(i, near(rng, 64, centres[i % 6], 0.3), 0) for i in range(240)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_clusters_of_odd_rows(spark):
    rng = random.Random(7)
    hot = near(rng, 64)
    rows = [(i, hot, None) for i in range(40)] + [(i, near(rng, 64), 1) for i in range(50, 70)]
    rows += [(1, hot, 0), (None, hot, 0), (80, None, 0), (81, hot[:63], 0), (82, [*hot, 1.0], 0), (83, [None, *hot[1:]], 0), (84, [math.nan, *hot[1:]], 0),
             (85, [-math.inf, *hot[1:]], 0), (86, [], 0)]
    got = clustered(spark, rows)
    assert got == plain_clusters(rows) and len(got) == 62
    assert clustered(spark, []) == []
    few = rows[:1] + rows[45:47]
    assert clustered(spark, few) == plain_clusters(few) and len({r[1] for r in clustered(spark, few)}) == 3


def test_pivots_spare_distances_and_keep_ties():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (8, 64))
    x = np.concatenate([centres[rng.integers(0, 8, 500)] + rng.integers(-9, 9, (500, 64)), centres])
    pivots = centres[:4]
    twice = np.concatenate([centres, centres])  # every distance is a tie of two numbers
    cluster, best, exact = clusters.assign(x, clusters.to_pivots(x, pivots), twice, pivots)
    away = ((x[:, None] - twice) ** 2).sum(axis=2)
    assert (cluster == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()
    assert exact < 0.35 * away.size


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_clusters"])
def test_queries_equal_their_sql(spark, name):
    problem, *_ = compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None, problem
