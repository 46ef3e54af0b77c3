"""Quality scores learned from preference pairs.

A Bradley-Terry model: the chance that one document is preferred to another is the logistic function
of the difference of their scores, and a score is linear in features of the text. It is fitted by
Newton steps on the feature differences of (good, bad) pairs. The border between accepted and
rejected documents is a quantile of all labelled documents' scores: the share of rejected ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import bind, bounded_sample, id_and_text, schema_with, text_batches
from hiresift.session import cut

CUT = 0.3
_GROUPS = [b"!", b"#$%&*", b"|", b"<>=@^~\\/", b".,;:?", b"'\"()[]{}-_", b"0123456789", b"\n",
           bytes(range(0x41, 0x5B)), bytes(range(0x80, 0x100))]


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    words = data.split()
    n, chars = max(1, len(words)), max(1, len(data))
    letters = max(1, int(counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum() + counts[0x80:].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [float(counts[list(g)].sum()) / (letters if g[0] == 0x41 else chars) for g in _GROUPS]
    marked = sum(w[-1] in b"!#$%&*|" for w in words)
    shares += [
        1 - len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:]))) / n,
        marked / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w.isupper() for w in words) / n,
    ]
    return [*shares, *(x ** 0.5 for x in shares), np.log1p(len(words)), sum(map(len, words)) / n / 10,
            np.log1p(max(map(len, words), default=0))]


WIDTH = len(features(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    border: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT is the border between rejected and accepted texts."""
        raw = self.raw(x) - self.border
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, share_bad: float, pairs: int, ridge: float = 1.0) -> Model:
    """share_bad: of all labelled documents, whatever the sample holds of them."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    up, down = z[good], z[~good]
    weights = np.zeros(x.shape[1])
    if len(up) and len(down):
        draw = np.random.default_rng(7)
        n = max(1, min(pairs, len(up) * len(down)))
        d = up[draw.integers(0, len(up), n)] - down[np.arange(n) % len(down)]
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(weights)),
                                   d.T @ (1 - p) - ridge * weights)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
    model = Model(mean, scale, weights, 0.0)
    raw = model.raw(x)
    weight = np.where(good, (1 - share_bad) / max(1, good.sum()), share_bad / max(1, (~good).sum()))
    order = np.argsort(raw, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad + 1e-9))
    low, high = raw[order[max(0, at - 1)]], raw[order[min(at, len(raw) - 1)]]
    model.border = float((low + high) / 2 if at else low - 1e-6)
    return model


def _rows(batches, model: Model | None, raw: bool = False):
    """With a model the scores (raw: before the border is taken off), else the features."""
    for batch, texts in text_batches(batches):
        x = np.array([features(t) for t in texts])
        if model is None:
            last = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
        else:
            last = pa.array(model.raw(x) if raw else model.score(x))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), last], [*kept, "out"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 12000, pairs: int = 60000) -> Model | None:
    """Fit on at most sample_docs labelled documents, half of either label; None without both labels.

    labels: doc_id and quality (1 good, 0 bad; several rows of a document: the majority, ties good). The
    sampled ids, bounded by sample_docs, are broadcast to the documents; of documents with one id the first by
    text hash counts.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("good"))
    sample, counts = bounded_sample(marks, "good", sample_docs // 2, 2, "doc_id")
    if len(counts) < 2:
        return None
    chosen = id_and_text(docs)
    found = chosen.join(F.broadcast(sample), "doc_id", "left_semi")
    rows = (found.mapInArrow(bind(_rows, model=None), "doc_id long, out array<double>")
            .groupBy("doc_id").agg(F.min_by("out", F.xxhash64("out")).alias("out"))
            .join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect())
    good = np.array([r["good"] == 1 for r in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return None
    share = counts[0] / sum(counts.values())
    model = fit(np.array([r["out"] for r in rows]), good, share, pairs)
    model.border = border_of_all(chosen, marks, model, share)
    return model


def border_of_all(docs: DataFrame, marks: DataFrame, model: Model, share_bad: float, bins: int = 1 << 16) -> float:
    """The score below which share_bad of all labelled documents lie, from counts in at most ``bins`` bins of equal width.

    Texts do not move: every document is scored where it is, and ids and scores meet the labels.
    """
    raw = docs.filter("doc_id IS NOT NULL").mapInArrow(bind(_rows, model=model, raw=True), "doc_id long, out double")
    scored = cut(raw.join(marks.select("doc_id"), "doc_id", "left_semi").select("out"))
    n, low, high = scored.agg(F.count("*"), F.min("out"), F.max("out")).first()
    width = (high - low) / bins if n and high > low else 0.0
    if not width:
        return model.border
    at = F.least(F.floor((F.col("out") - low) / width), F.lit(bins - 1)).cast("int")
    below, last = 0, low
    for b, count in sorted(tuple(r) for r in scored.groupBy(at.alias("b")).count().collect()):
        if below + count > share_bad * n:
            return float((last + low + b * width) / 2)
        below, last = below + count, low + (b + 1) * width
    return float(high)


def score(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, (with carry: row, the document's own row,) score (0 to 1) and predicted (1 from CUT on) of every text.

    A null text is empty, and an empty text has a score like any other. Without a model all scores are 1.
    Null ids and repeated rows come out as they went in; without carry only doc_id and text are read.
    """
    chosen = id_and_text(docs, carry)
    names = [n for n in chosen.columns if n != "text"]
    if model is None:
        scored = chosen.select(*names, F.lit(1.0).alias("out"))
    else:
        scored = chosen.mapInArrow(bind(_rows, model=model), schema_with(chosen, names, "out double"))
    return scored.withColumnRenamed("out", "score").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
