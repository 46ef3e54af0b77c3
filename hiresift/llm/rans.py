"""Token files: ids of all documents in ascending doc_id order, coded by a static range asymmetric numeral system.

A file folder is Parquet with one row per segment of about `segment` tokens (whole documents). A
segment has one frequency table that all its blocks share. A block codes its ids in `lanes`
interleaved streams; the index holds for each block a checkpoint (first word of its payload, lane
states to begin from) and the crc32 of its ids, so blocks decode independently and in any order.

Columns: part, segment, part_start (tokens of the part before it), n_tokens, doc_ids, doc_tokens,
bits and table (zlib: symbols, then frequencies, uint32), index (zlib: words before each block and
crc32, uint32 pairs), states (uint64, lanes for each block), payload (uint32 words).
Segments of a part follow each other, and parts follow each other by number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.llm.common import bind, pack_bytes, text_batches, unpack_bytes
from hiresift.llm.tokens import encoder
from hiresift.session import work_path

SCHEMA = ("part int, segment int, part_start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
          "bits int, table binary, index binary, states binary, payload binary")
ROWS = "doc_id long, start long, n_tokens long, ids binary"
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("bits", pa.int32()),
    ("table", pa.binary()), ("index", pa.binary()), ("states", pa.binary()), ("payload", pa.binary())])
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies scaled to a power of two; every symbol that occurs keeps at least one slot."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.freqs, self.bits = symbols.astype("<u4"), freqs.astype("<u4"), bits
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.cum[symbols] = np.cumsum(freqs, dtype=np.int64) - freqs

    @classmethod
    def of(cls, ids: np.ndarray, bits: int = 18) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols].astype(np.int64)
        bits = max(bits, len(symbols).bit_length() + 2)
        freqs = counts * ((1 << bits) - len(symbols)) // max(1, counts.sum()) + 1
        if len(freqs):
            freqs[np.argmax(freqs)] += (1 << bits) - freqs.sum()
        return cls(symbols, freqs, bits)

    def slots(self) -> np.ndarray:
        return np.repeat(self.symbols, self.freqs)


def encode_block(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(states a decoder begins with, payload words in the order a decoder reads them)."""
    x = np.full(lanes, LOW, np.uint64)
    freq, cum = table.freq[ids], table.cum[ids]
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    words = []
    for start in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[start:start + lanes], cum[start:start + lanes]
        now = x[:len(f)]
        over = now >= (f << room)
        words.append((now[over] & MASK).astype("<u4"))
        now = np.where(over, now >> WORD, now)
        q = now // f
        x[:len(f)] = (q << bits) + (now - q * f) + c
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")


def decode_block(n: int, states: np.ndarray, words: np.ndarray, table: Table, slots: np.ndarray) -> np.ndarray:
    x, lanes, at = states.astype(np.uint64), len(states), 0
    words = words.astype(np.uint64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(n, "<u4")
    for start in range(0, n, lanes):
        now = x[:min(lanes, n - start)]
        slot = now & mask
        symbol = slots[slot]
        out[start:start + len(now)] = symbol
        now = table.freq[symbol] * (now >> bits) + slot - table.cum[symbol]
        low = np.flatnonzero(now < LOW)
        now[low] = (now[low] << WORD) | words[at:at + len(low)]
        at += len(low)
        x[:len(now)] = now
    return out


def encode_segment(ids: np.ndarray, block: int, lanes: int) -> dict:
    table = Table.of(ids)
    states, words, index, before = [], [], [], 0
    for start in range(0, len(ids), block):
        part = ids[start:start + block]
        x, w = encode_block(part, table, lanes)
        index += [before, zlib.crc32(part.astype("<u4").tobytes())]
        before += len(w)
        states.append(x)
        words.append(w)
    return {
        "n_tokens": len(ids), "bits": table.bits, "table": pack_bytes(np.concatenate([table.symbols, table.freqs])),
        "index": pack_bytes(np.array([*index, before, block], "<u4")),
        "states": np.concatenate(states).astype("<u8").tobytes() if states else b"",
        "payload": np.concatenate(words).tobytes() if words else b"",
    }


def decode_segment(row: dict, blocks: range | None = None) -> np.ndarray:
    """Ids of a segment, or of some of its blocks; a wrong checksum is an error."""
    both = unpack_bytes(row["table"], "<u4")
    table = Table(both[:len(both) // 2], both[len(both) // 2:], row["bits"])
    index = unpack_bytes(row["index"], "<u4").astype(np.int64)
    block, n = int(index[-1]), row["n_tokens"]
    begins, sums = [*index[:-2:2].tolist(), int(index[-2])], index[1:-2:2]
    if not len(sums):
        return np.zeros(0, "<u4")
    states = np.frombuffer(row["states"], "<u8").reshape(len(sums), -1)
    words = np.frombuffer(row["payload"], "<u4")
    slots, out = table.slots(), []
    for b in range(len(sums)) if blocks is None else blocks:
        ids = decode_block(min(block, n - b * block), states[b], words[begins[b]:begins[b + 1]], table, slots)
        if zlib.crc32(ids.tobytes()) != sums[b]:
            raise ValueError(f"block {b} of segment {row['segment']} of part {row['part']} is damaged")
        out.append(ids)
    return np.concatenate(out)


def _write(batches, path: str, end_id: int, segment: int, block: int, lanes: int):
    from pyspark import TaskContext

    part, number, before = TaskContext.get().partitionId(), 0, 0
    docs, sizes, held = [], [], []

    def row():
        ids = np.concatenate(held)
        coded = encode_segment(ids, block, lanes)
        coded |= {"part": part, "segment": number, "part_start": before, "doc_ids": docs, "doc_tokens": sizes}
        return pa.RecordBatch.from_pylist([coded], _ARROW)

    total = 0
    for batch, texts in text_batches(batches):
        flat, counts = encoder(path).encode(texts)
        at = 0
        for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
            held += [flat[at:at + n], np.array([end_id], np.uint32)]
            docs.append(doc)
            sizes.append(n + 1)
            at += n
            total += n + 1
            if total >= segment:
                yield row()
                number, before, total = number + 1, before + total, 0
                docs, sizes, held = [], [], []
    if docs:
        yield row()


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_segment(row)
            sizes = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            for a in range(0, len(sizes), 1000):
                z = min(len(sizes), a + 1000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"][a:z], pa.int64()), pa.array(starts[a:z] + row["base"] + row["part_start"]),
                    pa.array(sizes[a:z]),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts[a:z], ends[a:z])], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])


# Readers of the folder pass over names that begin with an underscore.
MANIFEST = "_manifest"


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2,
                 segment: int = 1 << 22, block: int = 1 << 18, lanes: int = 1024) -> str:
    """Write the token files of all documents (null text: empty) and return their folder.

    Texts are range-partitioned and sorted by doc_id (null first), then by a hash of the text, so equal
    ids are split too. A task holds one segment at a time. Spark's committer makes a lost or repeated
    task harmless. Repeated rows are written as often as they occur; extra columns are not read; an
    empty table gives an empty folder.
    """
    path = path or work_path(docs.sparkSession, "tokens")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    run = bind(_write, path=tokenizer, end_id=end_id, segment=segment, block=block, lanes=lanes)
    ordered = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)
    _held(docs.sparkSession.read.schema(SCHEMA).parquet(path)).coalesce(1).write.json(f"{path}/{MANIFEST}")
    return path


def _held(files: DataFrame) -> DataFrame:
    """What token files hold: the last part, segments, tokens."""
    return files.agg(F.coalesce(F.max("part"), F.lit(-1)).alias("last_part"), F.count("*").alias("segments"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids.

    A part's first position is the sum of the parts before it: one number for each task that wrote
    (bounded by the partitions of the write, whatever the rows), so it is broadcast. The files are first compared with the
    folder's manifest: a folder that has lost a file is an error.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    held = _held(files)
    there, wanted = held.first(), spark.read.schema(held.schema).json(f"{path}/{MANIFEST}").first()
    if there != wanted:
        raise ValueError(f"token files in {path} are not whole: {there} instead of {wanted}")
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.expr("sum(_n) OVER (ORDER BY part) - _n").alias("base"))
    return files.join(F.broadcast(bases), "part").mapInArrow(_read, ROWS)
