"""Token counts of many texts, chunk by chunk.

A chunk is a bounded number of texts that follow each other. Its tokens become numbers of a dictionary of its own, so what is shuffled is
one row for each chunk and each of its different tokens, not one for each token of each text: these rows meet the counts of all
chunks (or of a stored model) in groups of tokens, and go back to their chunk, where numpy sums up the texts. A chunk, and a group of tokens,
is all that a task holds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.session import cut, ship

# Two or more word characters, hyphens inside, as ``text.words_and_hyphens`` has them.
WORDS = re.compile(r"\w[\w-]*\w").findall
# A chunk takes texts until it holds so many tokens or texts.
CHUNK_TOKENS = 2_000_000
CHUNK_TEXTS = 1 << 16
# Numbers that a group of tokens may hold.
GROUP_NUMBERS = 4_000_000
_ROWS = 20_000

_TOKENS = {"code": pa.int32(), "token": pa.string(), "cells": pa.list_(pa.string()), "ns": pa.list_(pa.int64())}
_TEXTS = {"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "marks": pa.list_(pa.int32()),
          "lengths": pa.list_(pa.int32()), "codes": pa.list_(pa.int32())}
_SCHEMA = pa.schema({"chunk": pa.int64(), **_TOKENS, **_TEXTS})
SCHEMA = ("chunk long, code int, token string, cells array<string>, ns array<long>, "
          "ids array<long>, labels array<string>, marks array<int>, lengths array<int>, codes array<int>")


def _list_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _batch(chunk: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, chunk)) if f.name == "chunk" else columns.get(f.name, pa.nulls(rows, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _encoded(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The number of each value in their dictionary, and the dictionary."""
    found = pa.concat_arrays(values.chunks).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


class _Chunk:
    """The texts of a chunk while it is filled."""

    def __init__(self, parts: int):
        self.codes: list[list[np.ndarray]] = [[] for _ in range(parts)]
        self.rows: list[tuple] = []
        self.size = 0
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def add(self, row: tuple, texts: list[str | None]) -> None:
        self.rows.append(row)
        for codes, text in zip(self.codes, texts):
            words = WORDS(text or "")
            codes.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def written(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """Rows of the tokens, each with its count by cell, and one row with the texts. Codes and lengths stand part by part."""
        parts = len(self.codes)
        lengths = np.array([len(c) for part in self.codes for c in part], np.int64)
        codes = np.concatenate([c for part in self.codes for c in part])
        tokens = pa.array(list(self.number), pa.string())
        ids, labels, marks, of = zip(*self.rows)
        cells = {c: i for i, c in enumerate(dict.fromkeys(of))}
        cell = np.array([cells[c] for c in of], np.int64)
        names = [c if parts == 1 else f"{p}|{c}" for c in cells for p in range(parts)]
        held = np.repeat(np.tile(cell, parts) * parts + np.repeat(np.arange(parts), len(of)), lengths)
        pairs, n = np.unique(codes.astype(np.int64) * len(names) + held, return_counts=True)
        each = np.bincount(pairs // len(names), minlength=len(tokens))
        which = pa.array(names, pa.string()).take(pa.array(pairs % len(names)))
        ends = np.cumsum(each)
        for a in range(0, len(tokens), _ROWS):
            b = min(a + _ROWS, len(tokens))
            lo, hi = ends[a] - each[a], ends[b - 1]
            yield _batch(chunk, b - a, code=pa.array(np.arange(a, b), pa.int32()), token=tokens.slice(a, b - a),
                         cells=_list_of(which.slice(lo, hi - lo), each[a:b]), ns=_list_of(pa.array(n[lo:hi], pa.int64()), each[a:b]))
        one = {"ids": ids, "labels": labels, "marks": marks, "lengths": lengths, "codes": codes}
        yield _batch(chunk, 1, code=pa.array([-1], pa.int32()), **{
            name: _list_of(pa.array(values, _TEXTS[name].value_type), np.array([len(values)])) for name, values in one.items()})


def chunked(rows: DataFrame, parts: int = 1, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The written chunks of rows (id, label, mark, cell, t0, t1, ...: folded texts), in the order of the rows and their partitions.

    Rows with a code stand for a token of a chunk: its counts ``ns`` by ``cells`` (of several parts as "part|cell"). The row with
    code -1 holds the texts of the chunk.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk(parts)
        for batch in batches:
            own = zip(*(batch.column(name).to_pylist() for name in ("id", "label", "mark", "cell")))
            texts = zip(*((v.as_py() for v in batch.column(f"t{p}")) for p in range(parts)))
            for row, text in zip(own, texts):
                chunk.add(row, text)
                if chunk.size >= tokens or len(chunk.rows) >= CHUNK_TEXTS:
                    yield from chunk.written(number)
                    number, chunk = number + 1, _Chunk(parts)
        if chunk.rows:
            yield from chunk.written(number)

    chosen = rows.select(F.col("id").cast("long").alias("id"), "label", F.col("mark").cast("int").alias("mark"), "cell", *[f"t{p}" for p in range(parts)])
    return cut(chosen.mapInArrow(run, SCHEMA))


def tokens_of(chunks: DataFrame) -> DataFrame:
    return chunks.where("code >= 0").select("chunk", "code", "token", "cells", "ns")


def texts_of(chunks: DataFrame) -> DataFrame:
    return chunks.where("code < 0").select("chunk", "ids", "labels", "marks", "lengths", "codes")


def counts_by_cell(chunks: DataFrame) -> DataFrame:
    """token, cell, n over all chunks."""
    pairs = tokens_of(chunks).select("token", F.explode(F.arrays_zip("cells", "ns")).alias("c"))
    return pairs.groupBy("token", F.col("c.cells").alias("cell")).agg(F.sum("c.ns").alias("n"))


def _dense(
    table: pa.Table, at: np.ndarray, rows: int, cells: pa.Array, columns: np.ndarray | None = None, width: int | None = None
) -> np.ndarray:
    """(rows, width): the counts of the table's rows, summed up in the row that ``at`` names and the column of their cell."""
    columns, width = (np.arange(len(cells)), len(cells)) if columns is None else (columns, width)
    lists = pa.concat_arrays(table.column("cells").chunks)
    n = pa.concat_arrays(table.column("ns").chunks).flatten().to_numpy(zero_copy_only=False)
    cell = pc.index_in(lists.flatten(), value_set=cells).fill_null(-1).to_numpy(zero_copy_only=False)
    column = np.append(columns, -1)[cell]  # of an unknown cell, -1, the last
    place = np.repeat(at, pc.list_value_length(lists).to_numpy(zero_copy_only=False)) * width + column
    keep = column >= 0
    # sums of counts are whole numbers below 2^53, which float64 holds exactly
    return np.bincount(place[keep], n[keep], rows * width).reshape(rows, width)


def meet(
    chunks: DataFrame, cells: list[str], stored: DataFrame | None = None, columns: np.ndarray | None = None, width: int = 0
) -> DataFrame:
    """chunk, code, counts, first: what the counts of a token are by cell.

    Without ``columns``: over all earlier chunks and ``stored`` (token, cells, ns). With it, a row for each cell: over all
    chunks, added up in ``width`` columns; a row names the columns that its cell counts for (-1: none). first marks the first of all chunks that hold a token which is not stored.
    """
    rows = tokens_of(chunks)
    groups = -(-rows.count() * max(1, width or len(cells)) // GROUP_NUMBERS) or 1
    if stored is not None:
        rows = rows.unionByName(stored.select(F.lit(-1).cast("long").alias("chunk"), F.lit(-1).alias("code"), "token", "cells", "ns"))
    names = list(cells)

    def run(table: pa.Table) -> pa.Table:
        values = pa.array(names, pa.string())
        token, different = _encoded(table.column("token"))
        chunk = table.column("chunk").to_numpy()
        order = np.lexsort((chunk, token))
        starts = np.flatnonzero(np.diff(token[order], prepend=-1))
        first = np.zeros(len(order), bool)
        first[order[starts]] = True
        if columns is not None:
            counts = sum(_dense(table, token, len(different), values, of, width) for of in columns.T)[token]
        else:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            here = _dense(table, place, len(order), values)
            upto = np.cumsum(here, axis=0) - here
            upto -= np.repeat(upto[starts], np.diff(np.append(starts, len(order))), axis=0)
            counts = upto[place]
        keep = chunk >= 0
        counts = counts[keep]
        return pa.table({
            "chunk": chunk[keep], "code": table.column("code").to_numpy()[keep].astype(np.int32),
            "counts": _list_of(pa.array(counts.ravel().astype(np.int64)), np.full(len(counts), counts.shape[1])), "first": first[keep]})

    hashed = rows.withColumn("_g", F.pmod(F.xxhash64("token"), F.lit(groups)))
    return hashed.groupBy("_g").applyInArrow(run, "chunk long, code int, counts array<long>, first boolean")


class Texts:
    """The texts of one chunk, with the counts of its tokens."""

    def __init__(self, texts: pa.Table, met: pa.Table, width: int, parts: int):
        def flat(name: str) -> pa.Array:
            return pa.concat_arrays(texts.column(name).chunks).flatten()

        self.ids, self.labels, self.marks = flat("ids"), flat("labels"), flat("marks").to_numpy(zero_copy_only=False)
        lengths, self.codes = flat("lengths").to_numpy(), flat("codes").to_numpy().astype(np.int64)
        self.size = len(self.ids)
        self.lengths = lengths.reshape(parts, self.size).astype(np.int64)
        self.text = np.repeat(np.tile(np.arange(self.size), parts), lengths)
        self.part_ends = np.concatenate([[0], np.cumsum(self.lengths.sum(axis=1))])
        code = met.column("code").to_numpy()
        self.counts = np.zeros((met.num_rows, width))
        self.first = np.zeros(met.num_rows, bool)
        if met.num_rows:
            self.counts[code] = pa.concat_arrays(met.column("counts").chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            self.first[code] = met.column("first").to_numpy(zero_copy_only=False)

    def pairs(self, chosen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, text, n) of the different tokens of each text, ordered by code, then text; of some parts or all."""
        spans = [np.arange(self.part_ends[p], self.part_ends[p + 1]) for p in (range(len(self.lengths)) if chosen is None else chosen)]
        at = np.concatenate(spans)
        keys, n = np.unique(self.codes[at] * max(1, self.size) + self.text[at], return_counts=True)
        return keys // max(1, self.size), keys % max(1, self.size), n

    def sums(self, text: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, self.size).astype(float)


def by_chunk(chunks: DataFrame, met: DataFrame, width: int, work: Callable[[Texts], pa.Table], schema: str, parts: int = 1) -> DataFrame:
    """The rows that ``work`` makes of each chunk and the counts of its tokens."""
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        return work(Texts(texts, found, width, parts))

    return texts_of(chunks).groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(run, schema)
