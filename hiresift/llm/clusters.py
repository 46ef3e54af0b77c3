"""Centroid clustering with a LAESA pivot table.

The distance of every vector to a few fixed pivots is stored once, in a table beside the vectors. In each round the
pivots' distances to a centroid are known too, and by the triangle inequality the largest difference of the two is a lower bound of
the vector's distance to that centroid. A vector's exact integer distance is computed to the centroid of the
smallest bound first, and then only to those whose bound does not exceed it. Bounds are floating-point numbers that are lowered by more than
their rounding error, so no centroid is lost and ties are met exactly.

A round is one pass over the stored table. Tasks return one row of sums for each centroid and batch; Spark adds them up, and only
the k sums of a round come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import bind
from hiresift.llm.vectors import lists_of, matrix, usable
from hiresift.session import cut

SCHEMA = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
# Relative rounding errors of a root and of a difference are about 1e-15; bounds give way by far more.
SLACK = 1e-9


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to one point."""
    away = x - centre
    return np.einsum("ij,ij->i", away, away)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([distances(x, p) for p in pivots], axis=1).astype(float))


def assign(x: np.ndarray, known: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row, and how many distances were computed.

    known: the rows' stored distances to the pivots.
    """
    low = np.zeros((len(x), len(centres)))
    for p, of_centres in enumerate(to_pivots(centres, pivots).T):
        mine = known[:, p, None]
        np.maximum(low, np.abs(mine - of_centres) - SLACK * (mine + of_centres), out=low)
    low *= low
    cluster = low.argmin(axis=1)
    away = x - centres[cluster]
    best = np.einsum("ij,ij->i", away, away)
    first, exact = cluster.copy(), len(x)
    for c, centre in enumerate(centres):
        open_ = np.flatnonzero((low[:, c] <= best * (1 + SLACK)) & (first != c))
        d = distances(x[open_], centre)
        better = (d < best[open_]) | ((d == best[open_]) & (c < cluster[open_]))
        cluster[open_[better]], best[open_[better]] = c, d[better]
        exact += len(open_)
    return cluster, best, exact


def _stored(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column("v"), pivots.shape[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(to_pivots(x, pivots))], [*batch.schema.names, "known"])


def _read(batch: pa.RecordBatch, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = np.asarray(batch.column("known").flatten()).reshape(batch.num_rows, len(pivots))
    return matrix(batch.column("v"), pivots.shape[1]), known


def _sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each batch and centroid with rows: their number and componentwise sums."""
    for batch in batches:
        x, known = _read(batch, pivots)
        cluster, _, _ = assign(x, known, centres, pivots)
        n = np.bincount(cluster, minlength=len(centres))
        found = np.flatnonzero(n)
        totals = np.stack([x[cluster == c].sum(axis=0) for c in found]) if len(found) else np.zeros((0, x.shape[1]), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array(n[found], pa.int64()), lists_of(totals)], ["cluster", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cluster, best, _ = assign(*_read(batch, pivots), centres, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])


def start_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def _next(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids of the next round: floor of the exact means; an empty one stays."""
    parts = table.mapInArrow(bind(_sums, centres=centres, pivots=pivots), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]) for i in range(centres.shape[1])])
    out = centres.copy()
    for row in sums.collect():  # one row for each centroid
        out[row[0]] = [s // row[1] for s in row[2:]]
    return out


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``width`` components take part where all are finite (``vectors.whole``); other rows are not
    returned. The start is the k vectors of smallest sha256 of "seed:vec_id". A repeated row is a vector of its own; equal ids
    start in the order of their components, and a vector without an id takes part but starts only where too few
    have one. Fewer vectors than k make fewer clusters; equal starts leave the one of larger number empty, and it stays where it is.
    Ties go to the smaller number. A sum beyond 64 bits is null. Only vec_id and embedding are read, so other columns may
    have any names; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    vectors = usable(rows, scale, rows["vec_id"].cast("long").alias("vec_id")).filter(F.size("v") == width)
    first = vectors.orderBy(start_order(F.col("vec_id"), seed).asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    centres = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    pivots = centres.copy()  # fixed from here on
    table = cut(vectors.mapInArrow(bind(_stored, pivots=pivots), "vec_id long, v array<int>, known array<double>"))
    for _ in range(rounds):
        after = _next(table, centres, pivots)
        if (after == centres).all():  # nothing moves any more in any later round
            break
        centres = after
    found = cut(table.mapInArrow(bind(_assigned, centres=centres, pivots=pivots), "vec_id long, cluster int, distance long"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # one row for each of the k clusters
    sums = F.broadcast(found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster"))
    total = found.agg(F.try_sum("distance")).scalar()
    return found.join(sums, "cluster").withColumn("inertia", total).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
