"""Hard negatives by a vertical scan of columnar blocks (BOND).

Vectors are dealt into cells of bounded size, and the vectors of a cell stand in one block, column by column. For an anchor a block's
columns are read in the order of the anchor's descending magnitudes. After some columns the rest of a score lies between
two sums, of the least and of the greatest contributions that the unread columns can make with the block's minima and maxima.
A window asks for the first k scores between two borders: a candidate leaves the bitmap once its interval misses
every window, or lies below the k-th largest lower end among the candidates that are in the window for sure. After the
last column all scores are exact.

Every anchor meets every cell: the anchors are the stated query set, and a cell keeps its blocks while the anchors stream past
them, so a task holds one cell and one batch of anchors. The first pass finds the positives (the window is unbounded, candidates
are the rows of the anchor's label), the second the negatives in the windows that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.llm.common import bind
from hiresift.llm.vectors import matrix, usable
from hiresift.session import cut

CELL_BYTES = 32 << 20
LEAST_BYTES = 1 << 20
COLUMNS = 16
EXACT = 2.0 ** 52
BLOCK = "cell int, kind int, width int, ids binary, labels binary, x binary"
ANCHOR = "key long, anchor_id long, label long, v array<int>, low array<long>, high array<long>"
FOUND = "key long, anchor_id long, w int, other long, score long"


class Block:
    """Vectors of one length, by columns, sorted by label."""

    def __init__(self, width: int, ids: bytes, labels: bytes, x: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(x, np.int32).reshape(width, len(self.ids)).astype(float)
        self.least, self.most = (f(self.x, axis=1) for f in (np.min, np.max))

    def candidates(self, label: int, same: bool, but: int) -> np.ndarray:
        first, last = (np.searchsorted(self.labels, label, side) for side in ("left", "right"))
        at = np.arange(first, last) if same else np.r_[0:first, last:len(self.ids)]
        return at[self.ids[at] != but]


def search(block: Block, anchor: np.ndarray, at: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) the positions and exact scores of its first k candidates, best first, ties by id."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    weight = anchor[order].astype(float)
    ends = np.stack([weight * block.least[order], weight * block.most[order]])
    x = block.x
    if (np.abs(weight) * np.maximum(np.abs(block.least), np.abs(block.most))[order]).sum() >= EXACT:
        weight, ends, x = anchor[order], np.stack([anchor[order] * b[order].astype(np.int64) for b in (block.least, block.most)]), x.astype(np.int64)
    rest = [np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0))]
    part = np.zeros(len(at), weight.dtype)
    for j in range(0, max(len(order), 1), COLUMNS):
        now = order[j:j + COLUMNS]
        part = part + weight[j:j + COLUMNS] @ x[np.ix_(now, at)]
        low, high = (part + r[min(j + COLUMNS, len(order))] for r in rest)
        keep = np.zeros(len(at), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            if len(sure) > k:
                least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (high >= least) & (low <= most)
        if not keep.all():
            at, part = at[keep], part[keep]
    out = []
    for least, most in windows:
        inside = np.flatnonzero((part >= least) & (part <= most))
        first = inside[np.lexsort((block.ids[at[inside]], -part[inside]))[:k]]
        out.append((at[first], part[first].astype(np.int64)))
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, length, label and id become one block for each cell and length."""
    key, parts = None, []

    def block():
        cell, width = key
        x = np.concatenate([p[2] for p in parts]).astype(np.int32)
        columns = [[cell], [0], [width], *([np.concatenate([p[i] for p in parts]).tobytes()] for i in (0, 1)), [x.T.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 3)],
                                          ["cell", "kind", "width", "ids", "labels", "x"])

    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("width").to_pylist()))
        start = 0
        for this, run in groupby(keys):
            rows = batch.slice(start, n := len(list(run)))
            start += n
            if parts and this != key:
                yield block()
                parts = []
            key = this
            parts.append((np.asarray(rows.column("vec_id"), np.int64), np.asarray(rows.column("label"), np.int64), matrix(rows.column("v"), this[1])))
    if parts:
        yield block()


def _scan(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a cell, then the anchors that meet them, one cell after the other."""
    cell, blocks = None, {}
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for row in range(batch.num_rows):
            get = lambda name, row=row, batch=batch: batch.column(name)[row].as_py()
            if get("cell") != cell:
                cell, blocks = get("cell"), {}
            if get("kind") == 0:
                blocks[get("width")] = Block(get("width"), get("ids"), get("labels"), get("x"))
            elif block := blocks.get(get("width")):
                key, anchor_id = get("key"), get("anchor_id")
                at = block.candidates(get("label"), same, anchor_id)
                windows = list(zip(get("low"), get("high")))
                for w, (found, scores) in enumerate(search(block, np.array(get("v"), np.int64), at, windows, k)):
                    out += [(key, anchor_id, w, i, s) for i, s in zip(block.ids[found].tolist(), scores.tolist())]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)],
                                         ["key", "anchor_id", "w", "other", "score"])


def _meet(blocks: DataFrame, anchors: DataFrame, cells: int, same: bool, k: int) -> DataFrame:
    """The first k rows of every window of every anchor, over all cells."""
    queries = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), F.size("v").alias("width"), "*")
    rows = blocks.unionByName(queries, allowMissingColumns=True).repartition(cells, "cell").sortWithinPartitions("cell", "kind", "width")
    found = rows.mapInArrow(bind(_scan, same=same, k=k), FOUND)
    best = Window.partitionBy("key", "w").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of the components floor(scale * x). An anchor (a row where is_anchor, a condition on
    vec_id, holds) has as positives its first rows of the same label, and for each positive as negatives the first rows of other
    labels whose score is from low to high percent of the positive's. Higher scores come first, ties by vec_id.

    Rows without an id, a label, a vector, or with components that are null, not finite or too large for 64-bit scores
    (``vectors.whole``) take no part. Vectors meet those of their own length. Equal rows count once; rows of one id with other
    labels or vectors are rows of their own, and never partners of an anchor of that id. A positive score below zero has no
    window. Other columns are not read; an empty table gives an empty one.
    """
    kept = usable(rows, scale, rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label")).dropna().dropDuplicates()
    table = cut(kept.withColumn("width", F.size("v")))
    size = 8 * (table.agg(F.sum(F.col("width") + 2)).first()[0] or 0)
    parallel = 2 * rows.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-size // CELL_BYTES), min(-(-size // LEAST_BYTES), parallel))
    dealt = table.withColumn("cell", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(cells)).cast("int"))
    blocks = cut(dealt.repartition(cells, "cell").sortWithinPartitions("cell", "width", "label", "vec_id").mapInArrow(_pack, BLOCK))
    ends = [F.array(F.lit(s).cast("long")) for s in (-(1 << 62), 1 << 62)]
    anchors = table.filter(is_anchor).select(
        F.xxhash64("vec_id", "label", "v").alias("key"), F.col("vec_id").alias("anchor_id"), "label", "v")
    first = cut(_meet(blocks, anchors.select("*", ends[0].alias("low"), ends[1].alias("high")), cells, True, positives)
                .select("key", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    # positives of equal score share a window; at most ``positives`` of them for each anchor
    of = first.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    # both borders lie at whole scores: ceil(low * s / 100), floor(high * s / 100)
    borders = F.transform("scores", lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("long")), F.transform(
        "scores", lambda s: F.floor(s.cast("decimal(38,0)") * high / 100).cast("long"))
    windows = anchors.join(of, "key").select("key", "anchor_id", "label", "v", borders[0].alias("low"), borders[1].alias("high"))
    chosen = _meet(blocks, windows, cells, False, negatives).join(of, "key").withColumn("positive_score", F.get("scores", F.col("w")))
    return chosen.join(first, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
