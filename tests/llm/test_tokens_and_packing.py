import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hiresift.llm import packing, rans, tokens
from hiresift.session import work_path

PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "!", "..", "É", "12", " 3", "€", "中", " \n", "\r\n", "ª", "I'm", "<|endoftext|>"]
ODD = [(1, "one two  three"), (2, None), (3, ""), (None, "no id"), (4, "word " * 5000), (5, "same"), (5, "same"), (6, "中文 €")]


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(tokens.default_path())
    lib.encode_special_tokens = True
    return lib


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    lib = tokens.encoder(tokens.default_path())
    flat, counts = lib.encode(texts)
    want = [e.ids for e in lib.library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_long_texts_are_cut_safely(library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 20)
    text = "some words, and more\nof them  " * 20
    flat, _ = tokens.encoder(tokens.default_path()).encode([text, "x " * 100])
    assert flat.tolist() == library.encode(text).ids + library.encode("x " * 100).ids


def test_a_small_cache_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "FLUSH_PARTS", 10)
    encoder = tokens.Encoder(tokens.default_path())
    texts = [f"the word{i} and, again\n\nthe é{i % 7}|x\nend\n" + "a" * i for i in range(120)]
    for text in texts + texts:
        flat, counts = encoder.encode([text])
        assert flat.tolist() == library.encode(text).ids and counts.tolist() == [len(flat)]
    assert len(encoder.index) < 80


@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing_equals_a_plain_scan(sizes):
    bins = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        home = next((b for b in bins if sum(sizes[i] for i in b) + sizes[item] <= 64), None)
        if home is None:
            bins.append([item])
        else:
            home.append(item)
    assert packing.first_fit_decreasing(sizes, 64) == bins


@given(st.lists(st.integers(0, 300), max_size=40))
def test_plan_holds_every_token_once(sizes):
    seen = defaultdict(list)
    found = packing.plan(sizes, 64, 4)
    for pieces in found:
        assert 0 < sum(p[2] for p in pieces) <= 64
        for d, start, n in pieces:
            seen[d].append((start, n))
    for d, n in enumerate(sizes):
        at = 0
        for start, size in sorted(seen[d]):
            assert start == at and size > 0
            at += size
        assert at == n
    assert sum(64 - sum(p[2] for p in b) >= 4 for b in found) <= 1


def test_pack_rows(docs, library):
    rows = packing.pack(docs(ODD), group_docs=3).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.sequence_id].append(r)
    for pieces in groups.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].sequence_tokens <= 1024
    got = sorted((r.doc_id or 0, r.start, r.ids) for r in rows if r.doc_id not in (5,))
    whole = defaultdict(bytes)
    for doc, _, ids in got:
        whole[doc] += bytes(ids)
    for doc, text in ODD:
        if doc != 5:
            assert np.frombuffer(whole[doc or 0], "<u4").tolist() == library.encode(text or "").ids + [0]
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert packing.pack(docs([])).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 70000), min_size=1, max_size=400), st.integers(1, 9), st.integers(1, 50))
def test_blocks_round_trip(ids, lanes, block):
    ids = np.array(ids, "<u4")
    row = rans.encode_segment(ids, block, lanes) | {"segment": 0, "part": 0}
    assert rans.decode_segment(row).tolist() == ids.tolist()
    last = (len(ids) - 1) // block
    assert rans.decode_segment(row, range(last, last + 1)).tolist() == ids[last * block:].tolist()


def test_damage_is_found():
    ids = np.arange(1000, dtype="<u4") % 50
    row = rans.encode_segment(ids, 100, 4) | {"segment": 0, "part": 0}
    row["payload"] = row["payload"][:-4] + b"\x01\x02\x03\x04"
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_segment(row)


def test_files_round_trip(spark, docs, library):
    path = rans.write_tokens(docs(ODD), work_path(spark, "t"), segment=50, block=16, lanes=4)
    rows = sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6]
    text, at = dict(ODD), 0
    for r in rows:
        ids = np.array(library.encode(text[r.doc_id] or "").ids + [2], "<u4")
        assert r.start == at and r.n_tokens == len(ids) and zlib.crc32(bytes(r.ids)) == zlib.crc32(ids.tobytes())
        at += len(ids)
    empty = rans.write_tokens(docs([]), work_path(spark, "t"))
    assert rans.read_tokens(spark, empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_ids_equal_an_untouched_library(texts):
    flat, counts = tokens.encoder(tokens.default_path()).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(tokens.default_path()).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_added_tokens_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 5)
    flat, counts = tokens.Encoder(tokens.default_path()).encode(["x y", "a <|endoftext|> b", "a b"])
    assert flat.tolist()[counts[0]:counts[0] + counts[1]] == [64, 220, 50256, 275] and counts[1] == 4


def test_repeated_rows_do_not_meet_in_one_group(docs, monkeypatch):
    rows = [(None, "same words here")] * 300 + [(i, f"text {i}") for i in range(100)]
    found = packing.pack(docs(rows).repartition(8), group_docs=20).collect()
    assert sum(r.doc_tokens for r in found if r.start == 0) == sum(r.length for r in found) and len({r.sequence_id for r in found}) > 8
    groups = defaultdict(int)
    for r in found:
        groups[r.sequence_id] += r.doc_id is None
    assert sum(groups.values()) >= 300 and max(groups.values()) <= 40
    monkeypatch.setattr(packing, "GROUP_CHARS", 100)
    batch = pa.RecordBatch.from_pylist([{"_g": 5, "doc_id": i, "text": "a b " * 10} for i in range(9)])
    out = list(packing._pack_groups([batch.slice(0, 4), batch.slice(4)], 50, path=tokens.default_path(), room=1024, end_id=0, min_cut=8))
    assert [b.num_rows for b in out] == [2, 2, 2, 2, 1]
    assert sorted({i for b in out for i in b.column("sequence_id").to_pylist()}) == [(5 << 32) + k for k in range(5)]


def test_a_group_is_held_as_ids_and_leaves_in_small_batches(monkeypatch):
    texts = [f"the words {'of a text ' * (20 + i % 700)}{i}" for i in range(3000)]
    chars = sum(map(len, texts))
    fixed = {"path": tokens.default_path(), "room": 1024, "end_id": 0, "min_cut": 8}

    def batches():
        for at in range(0, 3000, 250):
            yield pa.RecordBatch.from_pylist([{"_g": 5, "doc_id": i, "text": texts[i]} for i in range(at, at + 250)])

    whole = {i: b"" for i in range(3000)}
    lib = tokens.encoder(tokens.default_path())
    for i, text in enumerate(texts):
        flat, _ = lib.encode([text])
        whole[i] = np.append(flat, 0).astype("<u4").tobytes()
    held = []
    monkeypatch.setattr(packing, "plan", lambda *a, f=packing.plan: held.append(tracemalloc.get_traced_memory()[0]) or f(*a))
    tracemalloc.start()
    out = []
    for batch in packing._pack_groups(batches(), 5000, **fixed):
        out.append(batch)
    tracemalloc.stop()
    # texts held whole would be as many bytes as characters, beside the ids
    assert len(held) == 1 and held[0] - sum(map(len, whole.values())) < chars / 2
    sizes = [sum(b.column("length").to_pylist()) for b in out]
    assert len(out) > 2 and max(sizes) <= packing.BATCH_TOKENS
    got = sorted((r["doc_id"], r["start"], r["ids"], r["length"]) for b in out for r in b.to_pylist())
    found = {i: b"" for i in range(3000)}
    for i, start, ids, length in got:
        assert start * 4 == len(found[i]) and len(ids) == 4 * length
        found[i] += ids
    assert found == whole
    numbers = [n for b in out for n in b.column("sequence_id").to_pylist()]
    assert numbers == sorted(numbers) and set(numbers) == set(range(5 << 32, (5 << 32) + len(set(numbers))))
