"""Small helpers that the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiresift.session import ship  # noqa: F401

# Texts of one Arrow batch are worked on in slices of about so many characters, which bounds a task's memory.
SLICE_CHARS = 2_000_000


def bind(function: Callable, **fixed) -> Callable:
    """A function of one argument; Spark looks at the signature, so a partial object would not do."""
    def run(x):
        return function(x, **fixed)
    return run


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS, rows: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive slices; a null text is empty."""
    start, size, part = 0, 0, []
    row = -1
    for row, text in enumerate(texts):
        text = text or ""
        if part and (size + len(text) > chars or len(part) >= rows):
            yield start, part
            start, size, part = row, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS, rows: int = 1 << 20):
    """(slice of the batch, its texts) for every slice of every batch."""
    for batch in batches:
        # a carried row holds the text already
        values = batch.column(column) if column in batch.schema.names else pc.struct_field(batch.column("row"), column)
        for start, texts in slices((v.as_py() for v in values), chars, rows):
            yield batch.slice(start, len(texts)), texts


def id_and_text(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and text in their types; with carry doc_id and the whole row as a struct, whose names clash with nothing."""
    text = F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)


def schema_with(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """Schema of some columns of a table, and then of more."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(more).fields)


def id_crc(col: Column | str = "doc_id") -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start..start+length-1 for all pairs."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def pack_bytes(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 6)


def unpack_bytes(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def bounded_sample(df: DataFrame, label: str, per_class: int, classes: int, *key: str) -> tuple[DataFrame, dict]:
    """At most per_class rows of each of the most frequent classes, and all rows' count of these classes.

    Rows are chosen by a hash of the key columns. A threshold on the hash, from the counts, leaves about
    twice the rows needed before they are ranked, so no class is sorted whole.
    """
    top = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(classes)
    counts = {r[label]: r["count"] for r in top.collect()}
    if not counts:
        return df.limit(0), counts
    hash_ = F.xxhash64(*key)
    share = F.pmod(hash_, F.lit(1 << 30)) / (1 << 30)
    # one row for each of at most ``classes`` classes
    borders = df.sparkSession.createDataFrame(
        [(name, min(1.0, 2.0 * per_class / n + 50.0 / n)) for name, n in counts.items()], f"_class {df.schema[label].dataType.simpleString()}, _share double")
    chosen = df.join(F.broadcast(borders), F.col(label) == F.col("_class")).filter(share < F.col("_share")).drop("_class", "_share")
    ranked = chosen.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(label).orderBy(hash_, *key)))
    return ranked.filter(F.col("_rank") <= per_class).drop("_rank"), counts
