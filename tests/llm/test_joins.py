import random

import numpy as np
import pyarrow as pa
import pytest

from hiresift.llm import decontam, jaccard


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = {}
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out[doc] = (len(sets[i]), min(ids) if sets[i] and ids else doc)
    return out


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("chunk,group", [(jaccard.CHUNK, jaccard.SLICE), (1200, 6)])
def test_components_equal_brute_force(docs, monkeypatch, chunk, group):
    monkeypatch.setattr(jaccard, "SLICE", group)
    rng = random.Random(5)
    texts = [t for size, words, edits in [(30, 60, 3), (12, 200, 8), (8, 20, 1), (10, 9, 1), (6, 700, 30)]
             for t in family(rng, size, words, edits)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    line = " ".join(f"c{i}" for i in range(12))
    texts += [line + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(n)) for n in (0, 1, 2, 3, 20, 40)]
    texts += ["", None, " \t\n", "one two", "One  TWO", "one two three", "É a b c d e", "é a b c d e"] + texts[:5]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(rows), chunk).collect()}
    assert got == plain_components(rows)


def test_odd_rows(docs):
    text = "a b c d e f g h"
    rows = jaccard.near_duplicates(docs([(None, text), (3, text), (3, text), (None, "p q"), (9, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows if r.component_id is not None) == [
        (0, 4, 3), (3, 4, 3), (3, 4, 3), (9, 0, 9)]
    assert sum(r.component_id is None for r in rows) == 1
    assert jaccard.near_duplicates(docs([])).count() == 0


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, v in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (w != v))
    return min(row)


def test_edit_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 15))]
        assert decontam.edit_distance_in(item, text) == plain_distance(item, text)


def test_edited_items_are_found(spark, docs):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 55)))) for i in range(40)]
    rows, want = [], {}
    for doc in range(200):
        item, text = items[doc % 40]
        words = text.split()
        for _ in range(rng.randint(0, int(0.2 * len(words)))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at:at + 1] = [] if kind == 0 else [word()] if kind == 1 else [words[at], word()]
        around = [word() for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(around))
        rows.append((doc, " ".join(around[:at] + words + around[at:]).title()))
        want[doc] = item
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(100)]
    bench = spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs(rows), bench).collect()}
    found = sum(want[d] in got[d]["items"] for d in want)
    assert found >= 0.95 * len(want)
    for doc, text in rows:
        for item, distance in zip(got[doc]["items"], got[doc]["distances"]):
            words = dict(items)[item].encode().split()
            assert plain_distance(words, text.lower().encode().split()) <= distance <= 0.2 * len(words)
    assert not any(got[1000 + i].contaminated for i in range(100))


def test_contamination_of_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha")], "item_id long, text string")
    rows = decontam.contamination(docs([(1, None), (2, ""), (None, "Alpha, beta gamma delta!"), (2, "")]), bench).collect()
    assert [sorted(r["items"]) for r in rows if r.contaminated] == [[1, 2]] and len(rows) == 4
    assert not decontam.contamination(docs([(1, "alpha")]), bench.limit(0)).first().contaminated
    assert decontam.contamination(docs([]), bench).count() == 0


@pytest.mark.parametrize("m", [24, 48, 96, 200, 400])
def test_recall_at_the_full_edit_rate(m):
    rng = random.Random(m)
    word = lambda: b"v%d" % rng.randrange(3000)
    items = [(i, [word() for _ in range(m)]) for i in range(100)]
    texts = []
    for _, words in items:
        words = list(words)
        for at in sorted(rng.sample(range(m), m // 5), reverse=True):
            words[at:at + 1] = rng.choice([[], [b"x%d" % at], [words[at], b"x%d" % at]])
        around = [word() for _ in range(rng.randint(0, 150))]
        texts.append(b" ".join(around + words + around).decode())
    found = decontam._found(decontam.Index(items, 0.2), texts)
    assert sum(i in f for i, f in enumerate(found)) >= 98


def linked_by(edges, start):
    linked = {start}
    while more := {x for e in edges for x in e if linked & set(e)} - linked:
        linked |= more
    return linked


def group_batch(token, node, n, vectors):
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(n), pa.array(jaccard.packed(vectors))], ["token", "node", "n", "point"])


def forest(batches):
    return [e for out in jaccard._forests(batches) for e in zip(*(c.to_pylist() for c in out.columns))]


@pytest.mark.parametrize("rows,slices", [(7, 128), (9, 128), (12, 128), (12, 1)])
def test_a_large_group_is_joined_wherever_batches_end(monkeypatch, rows, slices):
    monkeypatch.setattr(jaccard, "SLICE", 3)
    monkeypatch.setattr(jaccard, "SLICES", slices)
    # Two kinds of points that pass among themselves alone; beyond the last slice everything is one tree.
    vectors = np.zeros((rows + 3, jaccard.GROUPS), np.uint8)
    vectors[:, 0] = 50
    vectors[2:2 + rows:2] = 0
    vectors[2:2 + rows:2, 9] = 50
    token, node = [1, 1] + [2] * rows + [3], [100, 101, *range(rows), 200]
    whole = group_batch(token, node, [50] * len(node), vectors)
    want = set(range(0, rows, 2)) if slices > 1 else set(range(rows)) - {1}
    for a in range(len(node) + 1):
        for b in range(a, len(node) + 1):
            edges = forest([whole.slice(0, a), whole.slice(a, b - a), whole.slice(b)])
            assert linked_by(edges, 0) >= want and (slices == 1 or linked_by(edges, 0) == want), (a, b)
            assert linked_by(edges, 100) == {100, 101}


def test_packed_points_bound_the_counts():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(0, top, (50, jaccard.GROUPS)) for top in (2, 9, 16, 40, 200, 256)]).astype(np.uint8)
    back = jaccard.unpacked(jaccard.packed(vectors))
    assert (back >= vectors).all() and (back[:150] == vectors[:150]).all()
    assert (back.astype(int) - vectors <= np.where(back == 255, 255, 17)).all()


def test_unlinked_texts_that_share_a_shingle_make_no_block(docs):
    """20,000 texts begin with one line and share nothing else: the trees tell them apart, and no block is verified."""
    rng = np.random.default_rng(2)
    n = 20_000
    vectors = np.zeros((n, jaccard.GROUPS), np.uint8)
    np.add.at(vectors, (np.repeat(np.arange(n), 24), rng.integers(0, jaccard.GROUPS, 24 * n)), 1)
    whole = group_batch([5] * n, list(range(n)), [24] * n, vectors)
    edges = forest([whole.slice(i, 3000) for i in range(0, n, 3000)])
    plain = jaccard.unpacked(jaccard.packed(vectors)).astype(int)
    few = rng.integers(0, n, 200)
    passing = {(int(i), int(j)) for i in few for j in np.flatnonzero(np.minimum(plain[i], plain).sum(1) >= jaccard._shared(24, 24)) if i != j}
    root = {}
    for a, b in edges:
        root.setdefault(a, set()).add(b)
        root.setdefault(b, set()).add(a)
    for i, j in list(passing)[:50]:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            todo += [y for y in root.get(x, ()) if y not in seen]
            seen |= root.get(x, set())
        assert j in seen
    assert len(edges) < n


def test_a_chunk_meets_the_probes_of_one_chunk_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(60)]
    sets += [np.sort(np.append(s[:-2], rng.integers(0, 1 << 63, 2).astype(np.uint64))) for s in sets]
    rows = [(7, 0, -1, i) for i in range(60)] + [(7, 0, 1 + i % 12, 60 + i) for i in sorted(range(60), key=lambda i: i % 12)]
    batch = pa.RecordBatch.from_pylist([
        {"block": b, "chunk": c, "sender": s, "n": len(sets[i]), "hashes": sets[i].tobytes(), "comp": i} for b, c, s, i in rows])
    held, make = [], jaccard._runs
    monkeypatch.setattr(jaccard, "_runs", lambda *a: (held.append(t.num_rows) or t for t in make(*a)))
    edges = [e for out in jaccard._ask([batch.slice(0, 50), batch.slice(50)]) for e in zip(*(c.to_pylist() for c in out.columns))]
    assert sorted(edges) == [(60 + i, i) for i in range(60)] and held == [60] + [5] * 12


def test_recall_of_every_kind_of_edit():
    rng = random.Random(8)
    word = lambda: b"v%d" % rng.randrange(3000)
    for m in (5, 12, 16, 24, 30, 60, 300, 1000):
        items = [(i, [word() for _ in range(m)]) for i in range(100 if m < 300 else 25)]
        index = decontam.Index(items, 0.2)
        for kind in ("deleted", "replaced", "inserted", "mixed"):
            texts = []
            for _, words in items:
                words = list(words)
                for turn, at in enumerate(sorted(rng.sample(range(m), m // 5), reverse=True)):
                    how = ("deleted", "replaced", "inserted")[turn % 3] if kind == "mixed" else kind
                    words[at:at + 1] = [] if how == "deleted" else [b"x%d" % at] if how == "replaced" else [b"x%d" % at, words[at]]
                around = [word() for _ in range(rng.randint(0, 100))]
                texts.append(b" ".join(around + words + around).decode())
            found = decontam._found(index, texts)
            assert sum(i in f for i, f in enumerate(found)) >= 0.93 * len(items), (m, kind)


def test_items_come_in_blocks_of_bounded_size(spark, docs, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs([(i, f"so {t} it is") for i, t in items] + [(99, "nothing here at all")])
    whole = decontam.contamination(rows, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    assert len(list(decontam._blocks(bench, 0.2))) > 2
    assert decontam.contamination(rows, bench).orderBy("doc_id").collect() == whole
    assert [r["items"] for r in whole] == [[i] for i in range(12)] + [[]]
