import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.llm import vector_codes as V
from odd_tables import odd_vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain_codes(rows, entries=V.ENTRIES, rounds=V.ROUNDS):
    """The contract, one row at a time: {(vec_id, code, error, books)} as a list, vectors of each length on their own."""
    out = []
    kept = [(i, lab, [int(np.floor(float(np.float32(x)) * 1024)) for x in e]) for i, lab, e in rows
            if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for dim in sorted({len(w) for _, _, w in kept}):
        own = [r for r in kept if len(r[2]) == dim]
        first = {}
        for i, _, w in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
            first.setdefault(i, w)
        cut = [k * dim // 4 for k in range(5)]
        books = [[w[a:b] for w in list(first.values())[:entries]] for a, b in zip(cut, cut[1:])]

        def assign(p, w):
            part = w[cut[p]:cut[p + 1]]
            return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            moved = []
            for p in range(4):
                of = {}
                for _, _, w in own:
                    of.setdefault(assign(p, w)[1], []).append(w[cut[p]:cut[p + 1]])
                moved.append([[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])])
            books = moved
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, lab, w in own:
            best = [assign(p, w) for p in range(4)]
            out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), digest))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 80), st.integers(1, 5), st.sampled_from([2, 9, 1000, 1 << 24]))
def test_tree_finds_the_nearest_entry_and_the_lower_of_ties(seed, n, dim, most):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-most, most + 1, (n, dim))
    queries = np.concatenate([rng.integers(-most, most + 1, (30, dim)), entries[:5]])
    d2 = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(q, e)) for e in entries] for q in queries])
    entry, best = V.Gnat(entries).nearest(queries)
    assert entry.tolist() == d2.argmin(axis=1).tolist() and best.tolist() == d2.min(axis=1).tolist()


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (20, 16))
    entries = centres[rng.integers(0, 20, 256)] + rng.integers(-60, 60, (256, 16))
    queries = centres[rng.integers(0, 20, 500)] + rng.integers(-60, 60, (500, 16))
    best, entry = np.full(500, 1 << 62), np.full(500, 1 << 62)
    work = V.Gnat(entries).search(queries, np.arange(500), best, entry)
    assert work < 500 * 256 / 4
    assert (best == V.squared_distances(queries, entries).min(axis=1)).all()


def rows_of(df):
    return sorted(((r.vec_id, r.label, r.code, r.error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_codes_of_odd_vectors(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS code", "2 AS part", "3 AS dim", "'x' AS total")
    assert rows_of(V.encode(df)) == sorted(plain_codes(rows), key=str)


def test_more_vectors_than_entries_and_moved_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) * 3, int(i) % 5, [float(np.float32(x)) for x in rng.normal(size=8).round(2)]) for i in rng.permutation(400)]
    assert rows_of(V.encode(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(plain_codes(rows), key=str)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_label_errors(spark, monkeypatch, broadcast):
    monkeypatch.setattr(V, "BROADCAST_IDS", broadcast)
    rows = odd_vectors()
    got = V.with_label_errors(V.encode(spark.createDataFrame(rows, SCHEMA))).collect()
    want = {}
    for _, lab, _, error, _ in plain_codes(rows):
        want[lab] = want.get(lab, 0) + error
    assert len(got) == len(plain_codes(rows)) and all(r.label_error == want[r.label] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.with_label_errors(V.encode(none)).collect() == []
    assert V.encode(spark.createDataFrame([(1, 1, None), (2, 2, [1.0, None])], SCHEMA)).collect() == []
