"""Skew: one expert holds 90 % of the log; its pushes span many range partitions."""
import random

import pytest

from corpusfold.operators import sequence as SQ
from corpusfold.operators import updates as U
from test_updates import _sequential


def _skewed(n=3000, seed=5):
    rnd = random.Random(seed)
    version, rows = {}, []
    for seq in range(n):
        e = "hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", "c"])
        v = version.get(e, 0)
        rows.append((e, seq, v - min(v, rnd.randint(0, 5)), rnd.uniform(-1, 1)))
        version[e] = v + 1
    return rows


def test_skewed_fold_matches_sequential(spark):
    rows = _skewed()
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    folded = U.fold_scalar(log)
    # rows meet only a (key, range partition) offset: no window holds a key's rows
    assert "Window" not in folded._jdf.queryExecution().optimizedPlan().toString()
    got = {r.expert: (r.version, r.state) for r in folded.collect()}
    version, state, _, _ = _sequential(rows)
    assert got.keys() == version.keys()
    for e in version:
        assert got[e][0] == version[e] and got[e][1] == pytest.approx(state[e], abs=1e-9)
    assert version["hot"] > 0.85 * len(rows)


def test_rank_equals_plain_rank_under_skew(spark):
    rows = _skewed(n=2000, seed=9)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    got = SQ.running_rank(log, ["expert"], "seq", partitions=13).collect()
    expected = {}
    for e, seq, _w, _d in sorted(rows, key=lambda r: r[1]):
        expected.setdefault(e, []).append(seq)
    pos = {(e, s): i + 1 for e, seqs in expected.items() for i, s in enumerate(seqs)}
    assert all(r.rank == pos[(r.expert, r.seq)] for r in got)


def test_sparse_orders_and_ties(spark):
    rows = [("a", 1_700_000_000_000_000 + i * 977_000) for i in range(500)] + [("a", 5)] * 300 + [(None, i % 3) for i in range(50)]
    got = SQ.running_rank(spark.createDataFrame(rows, "k string, s long"), ["k"], "s", partitions=9).collect()
    for k in ("a", None):
        own = sorted((r["rank"], r.s) for r in got if r.k == k)
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1] for x in own] == sorted(x[1] for x in own)


def test_skewed_stream_equals_batch(spark, tmpdir_path):
    from corpusfold.streaming import fold as ST
    log = spark.createDataFrame(_skewed(n=1200, seed=3), "expert string, seq long, worker_version long, delta double")
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 3, files=4)
    ST.stream_fold(spark, src, sink, ckpt, files_per_trigger=4, registry=["hot", "a"])
    got = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    want = {r.expert: (r.version, r.state) for r in U.fold_scalar(U.accepted(log, ["hot", "a"])).collect()}
    assert got.keys() == want.keys() == {"hot", "a"}
    assert all(got[e][0] == want[e][0] and got[e][1] == pytest.approx(want[e][1], abs=1e-9) for e in want)
