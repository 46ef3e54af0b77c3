"""Packing of documents into sequences of a fixed length.

First-fit decreasing inside randomised groups of documents: a tournament tree over the free room of
the open sequences finds the first one with room enough in logarithmic time. A document longer than
a sequence is cut into full sequences and a rest; rests are packed, and what room remains is closed
by cutting pieces of the emptiest sequences.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import SLICE_CHARS, bind
from hiresift.llm.tokens import encoder
from hiresift.session import cut

# About so many characters are packed together, which bounds a task's memory.
GROUP_CHARS = 32_000_000
# So many ids leave a task in one Arrow batch, or one sequence.
BATCH_TOKENS = 1 << 18
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, padded_tokens long")


class TournamentTree:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger child."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def first_with(self, size: int) -> int:
        """Index of the first bin with room for size; there must be one."""
        node, tree, leaves = 1, self.tree, self.leaves
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        return node - leaves

    def take(self, at: int, size: int) -> None:
        node, tree = at + self.leaves, self.tree
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items of each bin; larger items first, equal ones in their order."""
    if not sizes:
        return []
    tree, bins = TournamentTree(len(sizes), room), {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.first_with(sizes[item])
        tree.take(at, sizes[item])
        bins.setdefault(at, []).append(item)
    return [bins[at] for at in sorted(bins)]


def plan(sizes: list[int], room: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of every document once."""
    full = [[(d, s, room)] for d, n in enumerate(sizes) for s in range(0, n - room + 1, room)]
    rests = [(d, n - n % room, n % room) for d, n in enumerate(sizes) if n % room]
    bins = [[rests[i] for i in bin_] for bin_ in first_fit_decreasing([r[2] for r in rests], room)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    left, right = 0, len(bins) - 1
    while left < right:
        free = room - sum(p[2] for p in bins[left])
        while free >= min_cut and left < right:
            doc, start, size = bins[right].pop()
            part = min(size, free)
            bins[left].append((doc, start, part))
            free -= part
            if part < size:
                bins[right].append((doc, start + part, size - part))
            elif not bins[right]:
                right -= 1
        left += 1
    return full + [b for b in bins if b]


def _rows(pieces: list[tuple[int, ...]], docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, room: int) -> pa.RecordBatch:
    """Rows of pieces (document, start, length, sequence, offset, tokens of the sequence); ids are those of all documents in turn."""
    at, start, size, number, offset, total = np.array(pieces, np.int64).T
    first = (np.cumsum(lengths) - lengths)[at] + start
    flat = np.concatenate([ids[a:a + n] for a, n in zip(first.tolist(), size.tolist())])
    ends = np.append(0, np.cumsum(size * 4)).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    padded = np.where(total & (total - 1) == 0, total, room)
    columns = [pa.array([docs[d] for d in at.tolist()], pa.int64()), pa.array(start), pa.array(size), packed, pa.array(lengths[at]),
               pa.array(number), pa.array(offset), pa.array(total), pa.array(padded)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _pack_run(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, sequences: list[list[tuple[int, int, int]]], base: int, room: int):
    """Sequences numbered from base, in batches of about BATCH_TOKENS ids."""
    pieces, held = [], 0
    for number, sequence in enumerate(sequences, base):
        offset, total = 0, sum(p[2] for p in sequence)
        if pieces and held + total > BATCH_TOKENS:
            yield _rows(pieces, docs, lengths, ids, room)
            pieces, held = [], 0
        for d, start, size in sequence:
            pieces.append((d, start, size, number, offset, total))
            offset += size
        held += total
    if pieces:
        yield _rows(pieces, docs, lengths, ids, room)


def _pack_groups(batches, most_docs: int, path: str | None, room: int, end_id: int, min_cut: int):
    """Packs sorted rows group by group; a group is closed at most_docs documents or GROUP_CHARS characters and begun anew.

    Texts are encoded about SLICE_CHARS at a time and let go, so a group is held as ids alone.
    """
    docs, counts, parts, size, group, base = [], [], [], 0, None, 0
    waiting, chars = [], 0

    def encoded():
        nonlocal waiting, chars
        flat, sizes = encoder(path).encode(waiting)
        parts.append(np.insert(flat.astype("<u4", copy=False), np.cumsum(sizes), end_id))
        counts.append(sizes + 1)
        waiting, chars = [], 0

    def closed():
        nonlocal docs, counts, parts, size, base
        if docs:
            if waiting:
                encoded()
            lengths, ids = np.concatenate(counts), np.concatenate(parts)
            run, docs, counts, parts, size = docs, [], [], [], 0
            sequences = plan(lengths.tolist(), room, min_cut)
            yield from _pack_run(run, lengths, ids, sequences, base, room)
            base += len(sequences)

    for batch in batches:
        for number, doc, text in zip(*(batch.column(c) for c in ("_g", "doc_id", "text"))):
            number, text = number.as_py(), text.as_py() or ""
            if number != group:
                yield from closed()
                group, base = number, number << 32
            if docs and (len(docs) >= most_docs or size + len(text) > GROUP_CHARS):
                yield from closed()
            if waiting and chars + len(text) > SLICE_CHARS:
                encoded()
            docs.append(doc.as_py())
            waiting.append(text)
            size += len(text)
            chars += len(text)
    yield from closed()


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = 1024, end_id: int = 0,
         group_docs: int = 2048, min_cut: int = 8) -> DataFrame:
    """One row per piece of a document in a sequence, with the piece's ids as little-endian uint32 bytes.

    Every document (null text: empty) is its token ids and then end_id. Groups hold about group_docs
    documents chosen by a hash of id and text; one is closed at twice that or at GROUP_CHARS characters (or one
    document), so a task's memory does not depend on the input. Where more than group_docs rows have one id and text, each
    input partition has a group of its own for them, so no key is hot. Room below min_cut tokens stays as padding; sequence_tokens is the used length and
    padded_tokens the length after padding, which a power of two does not need. Null ids and repeated
    rows are documents like others; an empty table gives no rows; extra columns are not read.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = max(1, -(-docs.select(F.lit(1)).count() // group_docs))
    keyed = chosen.withColumn("_h", F.xxhash64("doc_id", "text"))
    # A written table, so that Spark knows its size when it chooses the join.
    often = cut(keyed.groupBy("_h").count().filter(F.col("count") > group_docs).select(F.col("_h").alias("_often")))
    apart = F.when(F.col("_often").isNotNull(), F.xxhash64("_h", F.spark_partition_id())).otherwise(F.col("_h"))
    keyed = keyed.join(often, F.col("_h") == F.col("_often"), "left").withColumn("_at", apart).drop("_often")
    dealt = keyed.withColumn("_g", F.pmod("_at", F.lit(groups))).drop("_at").repartition("_g")
    # The order of rows in a group must not depend on the shuffle.
    run = bind(_pack_groups, most_docs=2 * group_docs, path=tokenizer, room=room, end_id=end_id, min_cut=min_cut)
    return dealt.sortWithinPartitions("_g", "doc_id", "_h").mapInArrow(run, SCHEMA)
