"""Benchmark decontamination by edit distance.

Texts become words (lower case, punctuation dropped). The CGK embedding walks through a window of
words: step j writes the word it stands on, and a random bit that depends on j and the word says whether
it moves on. Windows at a small edit distance come out at a small Hamming distance, so hashing sampled
positions of the embedded string finds them: a table samples few positions, and enough tables and
independent walks make it likely that one agrees. Windows are sized by the item: an item of m words is filed
under all its windows of w <= 2m/3 words (a power of two, LARGEST at most), and documents are read in windows of w words
at every w/4th word, so an occurrence holds several windows of both kinds. A window holds few edits however long the item
is, and longer items have more windows. The walks of a window size are repeated until a seeded trial of the shortest items that use it, edited
at the full rate in every way, reaches the target recall.

What agrees is verified: as an edit takes away one word of the item at most, the place around the window must hold
nearly all of its words, and then the exact edit distance of the whole item to the best part of that place decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import bind, id_and_text, mix64, ranges, text_batches
from hiresift.session import cut, forget

BLOCK_BYTES = 50_000_000
BYTES_A_WINDOW = 8 + 4 + 4
RECALL = 0.95
TRIALS = 300
MOST_WALKS = 8
TABLES = 8
LARGEST = 16
_DROP = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_DROP).split()


def symbols_of(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    for w in words:
        if w not in known:
            known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Walk:
    """One embedding and the positions that its tables sample, for windows of a size."""

    def __init__(self, size: int, seed: int):
        draw = np.random.default_rng([size, seed])
        self.size = size
        # Beyond 1.6 steps for each word the walk has often left the window and says nothing.
        self.steps = max(1, int(1.6 * size))
        self.factors = draw.integers(1, 1 << 63, self.steps).astype(np.uint64) | np.uint64(1)
        self.k = min(self.steps, 4 if size <= 8 else 5)
        self.sampled = [np.sort(draw.choice(self.steps, self.k, replace=False)) for _ in range(TABLES)]
        self.odd = draw.integers(1, 1 << 63, (TABLES, self.k)).astype(np.uint64) | np.uint64(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(tables, windows): the hash of the sampled positions of each window's embedding."""
        out = np.zeros((TABLES, len(starts)), np.uint64)
        uses: dict[int, list[tuple[int, int]]] = {}
        for t, at in enumerate(self.sampled):
            for c, step in enumerate(at.tolist()):
                uses.setdefault(step, []).append((t, c))
        place, end = starts.astype(np.int64), starts + self.size
        padded = np.append(symbols, np.uint64(0))
        for step in range(max(uses) + 1):
            now = padded[np.minimum(place, len(symbols))]
            now[place >= end] = 0
            for t, c in uses.get(step, ()):
                out[t] += now * self.odd[t, c]
            place = place + ((now * self.factors[step]) >> np.uint64(63)).astype(np.int64)
        return mix64(out.ravel()).reshape(out.shape)


def window_size(m: int) -> int:
    return min(LARGEST, 1 << int(log2(max(1, 2 * m // 3))))


def stride(size: int) -> int:
    return max(1, size // 4)


def edited(item: np.ndarray, edits: int, kind: str, draw: np.random.Generator) -> np.ndarray:
    """The item with so many of its places deleted, replaced, or given a new word before them (mixed: each in turn)."""
    places = set(draw.choice(len(item), edits, replace=False).tolist())
    out, turn = [], 0
    for i, word in enumerate(item.tolist()):
        if i not in places:
            out.append(word)
            continue
        how = ("deleted", "replaced", "inserted")[turn % 3] if kind == "mixed" else kind
        turn += 1
        if how != "deleted":
            out.append(int(draw.integers(1 << 62)))
        if how == "inserted":
            out.append(word)
    return np.array(out, np.uint64)


def found_by_walk(m: int, size: int, seed: int, edits: int, kind: str, trial: int) -> bool:
    """Whether a window of an edited item of m words, within other words, agrees with one of the item in a table of this walk."""
    draw = np.random.default_rng([m, trial, len(kind)])
    item = draw.integers(1 << 62, size=m).astype(np.uint64)
    around = draw.integers(1 << 62, size=2 * size + int(draw.integers(size))).astype(np.uint64)
    text = np.concatenate([around[:len(around) // 2], edited(item, edits, kind, draw), around[len(around) // 2:]])
    walk = Walk(size, seed)
    mine = walk.keys(item, np.arange(m - size + 1))
    theirs = walk.keys(text, np.append(np.arange(0, len(text) - size, stride(size)), len(text) - size))
    return any(np.isin(a, b).any() for a, b in zip(theirs, mine))


@lru_cache
def walks_needed(size: int, rate: float, recall: float = RECALL) -> int:
    """How many walks the shortest items of this window size need to be found with the target recall, whatever the kind of edits."""
    m = next(n for n in range(1, 4 * LARGEST) if window_size(n) == size)
    worst = 1
    for kind in ("deleted", "replaced", "inserted", "mixed"):
        lost = [t for t in range(TRIALS) if int(rate * m)]
        for walk in range(MOST_WALKS):
            lost = [t for t in lost if not found_by_walk(m, size, walk, int(rate * m), kind, t)]
            if len(lost) <= (1 - recall) * TRIALS:
                break
        worst = max(worst, walk + 1)
    return worst


class Index:
    """The items' windows by table; one for every window size that the items need."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float, recall: float = RECALL):
        self.items, self.rate = items, rate
        self.held = [frozenset(words) for _, words in items]
        known: dict[bytes, int] = {}
        by_size: dict[int, list[int]] = {}
        for at, (_, words) in enumerate(items):
            if words:
                by_size.setdefault(window_size(len(words)), []).append(at)
        self.parts = []
        for size, ats in sorted(by_size.items()):
            owner = np.concatenate([np.full(len(items[a][1]) - size + 1, a) for a in ats])
            offset = np.concatenate([np.arange(len(items[a][1]) - size + 1) for a in ats])
            base = np.cumsum([0, *(len(items[a][1]) for a in ats)])
            starts = np.concatenate([b + np.arange(len(items[a][1]) - size + 1) for a, b in zip(ats, base)])
            symbols = symbols_of([w for a in ats for w in items[a][1]], known)
            tables, walks = [], [Walk(size, seed) for seed in range(walks_needed(size, rate, recall))]
            for seed, walk in enumerate(walks):
                for t, keys in enumerate(walk.keys(symbols, starts)):
                    order = np.argsort(keys, kind="stable")
                    screen = np.zeros(1 << 16, bool)
                    screen[(keys >> np.uint64(48)).astype(int)] = True
                    tables.append((seed, t, keys[order], owner[order].astype(np.int32), offset[order].astype(np.int32), screen))
            self.parts.append((size, walks, tables))

    def candidates(self, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, word at which the item would begin), each once, for documents whose words lie between bounds."""
        for size, walks, tables in self.parts:
            step = stride(size)
            count = np.maximum(0, (np.diff(bounds) - size) // step + 1) * (np.diff(bounds) >= size)
            # The last window of a document ends with it.
            doc = np.repeat(np.arange(len(count)), count)
            starts = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * step
            rest = np.flatnonzero((np.diff(bounds) >= size) & ((np.diff(bounds) - size) % step > 0))
            doc, starts = np.concatenate([doc, rest]), np.concatenate([starts, bounds[rest + 1] - size])
            if not len(doc):
                continue
            keys = [w.keys(symbols, starts) for w in walks]
            hits = []
            for seed, t, sorted_, owner, offset, screen in tables:
                mine = keys[seed][t]
                at = np.flatnonzero(screen[(mine >> np.uint64(48)).astype(np.int64)])
                first, last = (np.searchsorted(sorted_, mine[at], side) for side in ("left", "right"))
                at, first, many = at[last > first], first[last > first], (last - first)[last > first]
                place = ranges(first, many)
                window = np.repeat(at, many)
                hits.append(np.stack([doc[window], owner[place], starts[window] - bounds[doc[window]] - offset[place]], axis=1))
            for hit in np.unique(np.concatenate(hits), axis=0).tolist():
                yield tuple(hit)


def edit_distance_in(item: list[bytes], text: list[bytes]) -> int:
    """Smallest edit distance (in words) of the item to any part of the text; bit-parallel, one step a word."""
    m = len(item)
    match: dict[bytes, int] = {}
    for i, w in enumerate(item):
        match[w] = match.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = match.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        best = min(best, score)
    return best


def _found(index: Index, texts: list[str]) -> list[dict[int, int]]:
    """For each text the items found, with their edit distance."""
    known: dict[bytes, int] = {}
    words = [words_of(t) for t in texts]
    symbols = symbols_of([w for ws in words for w in ws], known)
    bounds = np.cumsum([0, *map(len, words)])
    out: list[dict[int, int]] = [{} for _ in texts]
    for doc, at, start in index.candidates(symbols, bounds):
        item = index.items[at][1]
        most = int(index.rate * len(item))
        if out[doc].get(at) == 0:
            continue
        place = words[doc][max(0, start - most - 1):max(0, start + len(item) + 2 * most + 1)]
        if sum(map(index.held[at].__contains__, place)) < len(item) - most:
            continue
        distance = edit_distance_in(item, place)
        if distance <= most:
            out[doc][at] = min(distance, out[doc].get(at, distance))
    return out


def _scan(batches, index: Index):
    for batch, texts in text_batches(batches, chars=1_000_000):
        found = _found(index, texts)
        items, distances = batch.column("items").to_pylist(), batch.column("distances").to_pylist()
        for i, more in enumerate(found):
            for at in sorted(more, key=lambda a: index.items[a][0]):
                items[i] = [*items[i], index.items[at][0]]
                distances[i] = [*distances[i], more[at]]
        kind = pa.list_(pa.int64())
        columns = {"items": pa.array(items, kind), "distances": pa.array(distances, kind)}
        yield pa.RecordBatch.from_arrays(
            [columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks whose index takes at most about BLOCK_BYTES (or one item), each with another word sequence."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size = [], 0
    for r in rows.filter("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(r["text"])
        if not words:
            continue
        need = 60 * len(words) + len(words) * BYTES_A_WINDOW * TABLES * walks_needed(window_size(len(words)), rate)
        if block and size + need > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], words))
        size += need
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, (with carry: row, the document's own row,) contaminated, items (ids found) and
    distances (their edit distances in words).

    An item counts as found where its whole word sequence is within rate * its words edits of a part of the text.
    Null and empty texts and items match nothing; an item without an id is reported as null; of items with equal words
    each is reported. Repeated rows and null ids come out as they went in; without carry only doc_id and text are
    read. The items travel with the tasks in blocks of bounded size, which all documents pass in turn, without a shuffle; between
    blocks the rows are written, so the driver holds one block at a time.
    """
    empty = F.array().cast("array<bigint>")
    rows = id_and_text(docs, carry).withColumn("items", empty).withColumn("distances", empty)
    held = None
    for block in _blocks(benchmark, rate):
        if held is not None:  # a further block: the rows with what was found so far are written first
            rows = cut(rows)
            if isinstance(held, str):
                forget(docs.sparkSession, held)
            held = rows.cut_path
        rows, held = rows.mapInArrow(bind(_scan, index=Index(block, rate)), rows.schema), held or ()
    return rows.drop("text").withColumn("contaminated", F.size("items") > 0)
