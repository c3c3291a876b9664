import hashlib
import random

import numpy as np
import pytest

SF001 = "/root/testdata/sf0.001"
from corpusfold.llm import decontaminate as D
from corpusfold.llm import source_mix as M
from corpusfold.llm import topk_search as K
from corpusfold.llm import warc as W
from corpusfold.llm.common import read_table


def targets_brute(sizes):
    """The excess shared again by weight, until no target is above twice its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("chain", [4, 8192])
def test_mix(spark, odd, monkeypatch, chain):
    monkeypatch.setattr(M, "CHAIN_ROWS", chain)
    rows = M.copies(odd).collect()
    docs = odd.select("doc_id", "text", "source").collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(d), size(t)) for d, t, _ in docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets_brute(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.copies <= 2 for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own) + 1e-6
    again = M.copies(odd.repartition(3)).collect()
    key = lambda x: sorted((str(r.doc_id), r["size"], str(r.source), r.copies) for r in x)
    assert key(again) == key(rows)
    mixed = M.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows if r.copies)


def test_mix_of_nothing(empty, spark):
    assert M.copies(empty).collect() == [] and M.mixed(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.copies) for r in M.copies(blank).collect()} == {(0.0, 0)}


def test_pivotal_keeps_the_sum_and_the_expectation():
    w = np.array([5.0, 3.0, 8.0, 2.0, 6.0, 4.0])
    p = np.array([0.3, 0.5, 0.2, 0.7, 0.6, 0.4])
    total = np.zeros(6)
    for seed in range(4000):
        q, left = M.pivotal(p, w, seed)
        assert abs((q * w).sum() - (p * w).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(q) if i != left)
        total += q
    assert np.abs(total / 4000 - p).max() < 0.04


def test_edit_place_against_all_substrings():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        return d[-1]

    rng = random.Random(4)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(6)], np.uint64)
        text = np.array([rng.randrange(4) for _ in range(12)], np.uint64)
        got, s, e = D.edit_place(item, text)
        best = min(distance(item.tolist(), text[i:j].tolist()) for i in range(13) for j in range(i, 13))
        assert got == best == distance(item.tolist(), text[s:e].tolist())


def test_leaks_recall(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(rng.choice([4, 7, 12, 15, 25, 40, 58])))) for i in range(60)]
    rows, planted, exact = [], set(), set()
    for k in range(300):
        i, text = rng.choice(items)
        w = text.split()
        edits = rng.randrange(0, int(0.2 * len(w)) + 1)
        for _ in range(edits):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], ["new"], [w[at], "more"]]) if len(w) > 4 else [w[at]]
        pad = [f"c{rng.randrange(9000)}" for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(pad) + 1)
        rows.append((k, " ".join(pad[:at] + [x.upper() + "," for x in w] + pad[at:])))
        planted.add((k, i))
        if not edits:
            exact.add((k, i))
    rows += [(1000 + k, " ".join(f"c{rng.randrange(9000)}" for _ in range(150))) for k in range(100)]
    found = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert exact <= got and len(planted & got) >= 0.9 * len(planted) and not any(d >= 1000 for d, _ in got)


def test_leaks_of_odd_documents(spark, odd, empty):
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one two", 1), (4, "ONE two, three four", 1), (4, "one two three four", 2),
                                   (None, "lonely words here again", 3)], "item_id long, text string, start int")
    found = {(r.doc_id, r.item_id, r.distance) for r in D.find_leaks(odd, bench).collect()}
    assert {(14, 4, 0), (15, 4, 0)} <= found and not any(i in (1, 2) for _, i, _ in found)
    assert {d for d, i, _ in found if i == 3} == {9, 14, 15}          # "one two", exactly
    assert D.find_leaks(empty, bench).collect() == [] and D.find_leaks(odd, bench.where("false")).collect() == []
    assert D.find_leaks(spark.createDataFrame([(None, "one two three four")], "doc_id long, text string"), bench).count() == 2


def test_leaks_in_several_blocks_of_items(spark, monkeypatch):
    docs, bench = read_table(spark, SF001, "documents"), read_table(spark, SF001, "benchmark")
    key = lambda x: sorted(map(tuple, x.collect()))
    one = key(D.find_leaks(docs, bench))
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    assert key(D.find_leaks(docs, bench)) == one


VECTORS = "vec_id long, embedding array<float>, label int, score long"


def search_brute(rows, k):
    good = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in good if c != q and len(y) == len(x))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "QUERY_BLOCK", max(2, block // 8))
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).astype(float).tolist(), 1, 1) for i in range(400)]
    same = rows[7][1]
    rows += [(400 + i, same, 0, 0) for i in range(120)]                              # a very common vector
    rows += [(600, None, 1, 1), (650, [], 1, 1), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1), (750, [float("nan")] * 6, 1, 1),
             (800, [float("inf")] + [0.0] * 5, 1, 1), (None, same, 1, 1), (850, [1.0, 2.0], 1, 1), (851, [3.0, -2.0], 1, 1),
             (900, [0.0] * 6, None, None), rows[0], rows[7]]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_inner_products(df, F.col("vec_id") % 50 == 0).collect())
    assert got == search_brute(df.collect(), 5)
    assert K.top_inner_products(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_loser_tree():
    rng = random.Random(8)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert W.url_key("https://www.Example.org:8080/a/B?x=1#top") == "org,example:8080)/a/b?x=1"
    assert W.url_key(None) == W.url_key("") == "-"


@pytest.mark.parametrize("size", [3, 20000])
def test_archives(spark, tmpdir_path, monkeypatch, size):
    monkeypatch.setattr(W, "RANGE_ROWS", size)
    monkeypatch.setattr(W, "RUN_BLOCK", max(2, size // 4000))
    monkeypatch.setattr(W, "PART_BYTES", 5000)
    big, mid = "é" * 700, "x" * 999
    rows = [(1, "http://a.org/1", big, 0), (2, "http://a.org/2", big, 0), (5, "http://b.org/", big, 0), (3, "http://a.org/1", mid, 0),
            (4, "http://c.org", mid, 0), (6, None, None, 0), (7, "http://b.org/\r\nx: y", "", 0), (8, "u", "y" * 1000, 0),
            (9, "u", "y" * 1000, 0), (None, "n", big, 0), (11, "http://long", "<p>\r\n\r\n" * 20000, 0), (12, "http://t/1", "t" * 2000, 0),
            (12, "http://t/2", "t" * 2000, 0), (10, "http://t/0", "t" * 2000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(4)
    W.write_archives(df, tmpdir_path + "/w")
    got = W.capture_index(spark, tmpdir_path + "/w").collect()
    payload = lambda h: (h or "").encode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len(payload(h)), hashlib.sha1(payload(h)).hexdigest()) for i, _, h, _ in rows)
    kind = {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"}
    assert kind == {(1, 5), (2, 5), (8, 9), (12, 12), (10, 12)} and sum(r.record_type == "response" for r in got) == len(rows) - 5
    order = [(r.urlkey.encode(), r.stamp) for r in sorted(got, key=lambda r: (r["range"], r.place))]
    assert order == sorted(order)


def test_archives_of_nothing(spark, tmpdir_path):
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), tmpdir_path + "/w")
    assert W.capture_index(spark, tmpdir_path + "/w").collect() == []


@pytest.mark.parametrize("scale", [1, 5000])
def test_entries_stay_in_the_task_that_finds_them(spark, scale):
    """All vectors are far above the cutoff at one node and below tau as a whole: none of these pairs leaves a task."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(21)
    rows = [(i, [float(rng.integers(900, 1000) * scale), float(-rng.integers(900, 1000) * scale)], 1, 1) for i in range(1, 300)]
    rows += [(1000 + i, [1000.0 * scale + i, 1000.0 * scale], 1, 1) for i in range(8)] + [(0, [1.0, 1.0], 1, 1), (50, [1.0, 0.5], 1, 1)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    classes = df.select(F.col("vec_id").alias("cls"), K.whole_components().alias("vector")).withColumn("dim", F.size("vector"))
    nodes = K.node_blocks(classes, 3)
    block = spark.sparkContext.broadcast(K.Asked(classes.where("cls = 0").collect()))
    listed = nodes.mapInArrow(K._gather(block, 5), K._SCORE).collect()
    tau = sorted((r.score for r in listed), reverse=True)[5]
    got = nodes.mapInArrow(K._resolve(block, spark.sparkContext.broadcast({0: tau})), K._SCORE).collect()
    assert {r.cls for r in got} == {1000 + i for i in range(2, 8)} and min(r.score for r in got) == tau
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_inner_products(df, F.col("vec_id") % 50 == 0).collect())
    assert found == search_brute(df.collect(), 5)
