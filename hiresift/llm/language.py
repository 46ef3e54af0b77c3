"""Language identification with a string kernel.

The blended-spectrum presence kernel counts the distinct character n-grams (of 1 to `order`
characters) that two texts share, normalised by their numbers. Nyström landmarks give each text a
feature vector K(x, Z) K(Z, Z)^-1/2, and one-versus-rest kernel ridge regression is a linear model W
on it. With X the presence rows of a batch of texts and P those of the landmarks, the scores are
X P K(Z, Z)^-1/2 W up to the norms; the product of all but X is made once, so a batch costs a single
matrix product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import bind, bounded_sample, id_and_text, schema_with, text_batches

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
BITS = 15
ROWS = 128


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
    return np.concatenate([table, np.ones(0x110000 - 0x30000, bool)])


def presence(texts: list[str], order: int = 3) -> np.ndarray:
    """One row per text: which hashed n-grams of its letters and word gaps occur."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t) + 2 for t in lower), np.int64, len(lower))
    rows = np.repeat(np.arange(len(texts)), sizes)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (rows[1:] != rows[:-1])
    codes, rows = codes[keep], rows[keep]
    out = np.zeros((len(texts), 1 << BITS), bool)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, order + 1):
        if len(codes) < n:
            break
        last = len(codes) - n + 1
        h = h[:last] * np.uint32(0x9E3779B1) + codes[n - 1:] + np.uint32(n)
        good = rows[:last] == rows[n - 1:]
        if n == 1:
            good = good & (codes != 32)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out[rows[:last][good], (mixed >> np.uint32(32 - BITS))[good]] = True
    return out


def has_letter(text: str) -> bool:
    """Whether a character is a letter; signs such as a superscript two or a half are none."""
    return any(map(str.isalpha, LETTER.findall(text, 0, 200))) or any(m.group().isalpha() for m in LETTER.finditer(text, 200))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    order: int

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        x = presence(texts, self.order).astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(1), 1))
        scores = (x @ self.weights) / norm[:, None]
        best = scores.argmax(1)
        value = np.clip(scores[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        spoken = [has_letter(t) for t in texts]
        names = [self.labels[b] if s else UNKNOWN for b, s in zip(best, spoken)]
        value[[not s for s in spoken]] = 0
        return names, value


def unit_rows(bits: np.ndarray) -> np.ndarray:
    """Presence rows of length 1 from packed rows."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    return x


def fit(bits: np.ndarray, labels: list[str], landmarks: int, ridge: float, order: int) -> Model:
    """bits: packed presence rows. They are unpacked ROWS at a time, which bounds the driver's memory."""
    names = sorted(set(labels))
    y = np.array([[float(a == n) for n in names] for a in labels])
    z = unit_rows(bits[np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).astype(int)])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([unit_rows(bits[i:i + ROWS]) @ z.T for i in range(0, len(bits), ROWS)])
    phi = kernel.astype(np.float64) @ root
    w = np.linalg.solve(phi.T @ phi + ridge * len(bits) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, z.T @ (root @ w).astype(np.float32), order)


def _features(batches, order: int):
    for batch, texts in text_batches(batches, rows=ROWS):
        bits = np.packbits(presence(texts, order), axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "bits"])


def train(labelled: DataFrame, sample_docs: int = 2000, landmarks: int = 256,
          ridge: float = 1e-4, order: int = 3) -> Model | None:
    """Fit on a bounded sample: sample_docs texts in equal parts for each label, at least one (so sample_docs bounds the labels too).

    labelled: text and lang, rows without either are left out. Texts become bit rows of 4 KB on the executors
    before they reach the driver. None if nothing is labelled.
    """
    usable = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labels = max(1, usable.groupBy("lang").count().limit(sample_docs).count())
    sample, _ = bounded_sample(usable, "lang", max(1, sample_docs // labels), sample_docs, "text")
    rows = sample.mapInArrow(bind(_features, order=order), "lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows])
    return fit(bits, [r["lang"] for r in rows], landmarks, ridge, order)


def _predict(batches, model: Model | None):
    for batch, texts in text_batches(batches, rows=ROWS):
        names, scores = model.score(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)],
                                         [*kept, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None, carry: bool = False) -> DataFrame:
    """doc_id, (with carry: row, the document's own row), lang_pred and score (0 to 1) of every whole text; 'und' and 0 for a null text or one without letters.

    Without a model (no labelled text) every text is 'und'. Only doc_id and text are read, so extra columns
    do not matter; repeated rows and null ids come out as they went in. The model travels with the task: it has
    32768 numbers for each label, and labels are bounded by train().
    """
    chosen = id_and_text(docs, carry)
    names = [n for n in chosen.columns if n != "text"]
    return chosen.mapInArrow(bind(_predict, model=model), schema_with(chosen, names, "lang_pred string, score double"))
