"""Update folds against a sequential re-statement of the coordinator's semantics, and the
algebraic identities of the survey (section 5 d, e)."""
import random

import pytest
from pyspark.sql import functions as F

from corpusfold.operators import updates as U
from corpusfold.operators.sequence import running_rank
from corpusfold.streaming import fold as ST


def _log(n=400, experts=("a", "b", "c"), seed=7, dim=None):
    rnd = random.Random(seed)
    version = {e: 0 for e in experts}
    rows = []
    for seq in range(n):
        e = rnd.choice(experts)
        lag = rnd.randint(0, 3)
        wv = version[e] - min(version[e], lag)
        delta = [rnd.uniform(-1, 1) for _ in range(dim)] if dim else rnd.uniform(-1, 1)
        rows.append((e, seq * 3 + 1, wv, delta))
        version[e] += 1
    return rows


def _sequential(rows, registered=None):
    """Coordinator semantics, one push at a time."""
    version, state, glob, gv = {}, {}, None, 0
    for e, _seq, wv, delta in sorted(rows, key=lambda r: r[1]):
        if registered is not None and e not in registered:
            continue
        v = version.get(e, 0)
        decay = 1.0 / (1.0 + 0.1 * (v - wv))
        if isinstance(delta, list):
            cur = state.get(e, [0.0] * len(delta))
            state[e] = [c + decay * d for c, d in zip(cur, delta)]
            glob = [g + decay * d for g, d in zip(glob or [0.0] * len(delta), delta)]
        else:
            state[e] = state.get(e, 0.0) + decay * delta
            glob = (glob or 0.0) + decay * delta
        version[e] = v + 1
        gv += 1
    return version, state, glob, gv


def test_running_rank_matches_row_number(spark):
    rows = [(k, s) for k in "xyz" for s in random.Random(1).sample(range(100000), 300)]
    df = spark.createDataFrame(rows, "k string, s long")
    got = running_rank(df, ["k"], "s", partitions=7).collect()
    for k in "xyz":
        ranks = sorted((r.s, r.rank) for r in got if r.k == k)
        assert [r for _, r in ranks] == list(range(1, len(ranks) + 1))


def test_scalar_fold_and_registry(spark):
    rows = _log()
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    reg = U.registry(spark, ["a", "b", "z", "a"])
    got = {r.expert: (r.version, r.state) for r in U.expert_states(reg, log).collect()}
    version, state, _, _ = _sequential(rows, {"a", "b"})
    assert set(got) == {"a", "b", "z"} and got["z"] == (0, 0.0)
    for e in ("a", "b"):
        assert got[e][0] == version[e] and got[e][1] == pytest.approx(state[e], abs=1e-9)
    g = U.global_scalar(U.accepted(log, reg)).collect()[0]
    g2 = U.global_scalar(U.accepted(log, ["a", "b"])).collect()[0]
    assert g2.global_version == g.global_version and g2.global_state == pytest.approx(g.global_state, abs=1e-9)
    _, _, glob, gv = _sequential(rows, {"a", "b"})
    assert g.global_version == gv and g.global_state == pytest.approx(glob, abs=1e-9)


def test_vector_fold(spark):
    rows = _log(n=120, dim=5)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta array<double>")
    got = U.fold_vectors(log).collect()
    version, state, glob, gv = _sequential(rows)
    for r in got:
        assert r.version == version[r.expert]
        assert r.value == pytest.approx(state[r.expert][r.pos], abs=1e-9)
    norms = {r.expert: r.l2_norm for r in got}
    for e, v in state.items():
        assert norms[e] == pytest.approx(sum(x * x for x in v) ** 0.5, abs=1e-9)
    gl = {r.pos: r.value for r in U.global_vectors(log).collect()}
    assert [gl[i] for i in range(5)] == pytest.approx(glob, abs=1e-9)


def test_two_halves_with_carried_version_equal_one_pass(spark):
    rows = _log(n=300)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    whole = {r.expert: (r.version, r.state) for r in U.fold_scalar(log).collect()}
    cut = 450
    first = {r.expert: (r.version, r.state) for r in U.fold_scalar(log.filter(F.col("seq") <= cut)).collect()}
    # second half: versions continue from the first half's counts
    v2 = U.with_versions(log.filter(F.col("seq") > cut))
    carried = spark.createDataFrame([(e, v) for e, (v, _s) in first.items()], "expert string, base long")
    v2 = (v2.join(carried, "expert", "left").withColumn("base", F.coalesce("base", F.lit(0)))
          .withColumn("staleness", F.col("version") + F.col("base") - F.col("worker_version"))
          .withColumn("decay", U.decay(F.col("staleness"))))
    second = {r.expert: (r.n, r.s) for r in
              v2.groupBy("expert").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("decay") * F.col("delta")).alias("s")).collect()}
    for e, (v, s) in whole.items():
        v1, s1 = first.get(e, (0, 0.0))
        n2, s2 = second.get(e, (0, 0.0))
        assert v == v1 + n2 and s == pytest.approx(s1 + s2, abs=1e-9)


def test_diff_then_apply_restores_after(spark):
    keys = ["expert", "key", "pos"]
    before = spark.createDataFrame([("a", "k1", 0, 1.0), ("a", "k1", 1, 2.0), ("a", "k2", 0, 5.0)],
                                   "expert string, key string, pos int, value double")
    after = spark.createDataFrame([("a", "k1", 0, 1.5), ("a", "k1", 1, 1.0), ("a", "k3", 0, 7.0)],
                                  "expert string, key string, pos int, value double")
    diff = U.state_diff(after, before, keys)
    assert sorted((r.key, r.pos, r.value) for r in diff.collect()) == [("k1", 0, 0.5), ("k1", 1, -1.0)]
    applied = {(r.key, r.pos): r.value for r in U.apply_delta(before, diff, keys).collect()}
    assert applied == {("k1", 0): 1.5, ("k1", 1): 1.0, ("k2", 0): 5.0}
    ins = {(r.key, r.pos): r.value for r in U.apply_delta(before, after, keys, alpha=2.0).collect()}
    assert ins[("k3", 0)] == 14.0 and ins[("k2", 0)] == 5.0


def test_batch_combine(spark):
    b = spark.createDataFrame([(0, "a", [1.0, 1.0]), (0, "b", [3.0, 1.0]), (0, "c", [9.0]), (1, "a", [2.0, 2.0])],
                              "batch long, expert string, delta array<double>")
    st, contrib = U.batch_combine(b, 2, "weighted_average")
    vals = {r.pos: (r.value, r.version) for r in st.collect()}
    assert vals[0] == (pytest.approx(1 / 3 + 3 / 3 + 2.0), 2) and vals[1][0] == pytest.approx(2 / 3 + 2.0)
    assert {r.expert: r.weight for r in contrib.collect()} == {"a": 1.0, "b": pytest.approx(1 / 3)}
    st2, _ = U.batch_combine(b, 2, "sum")
    assert {r.pos: r.value for r in st2.collect()}[0] == pytest.approx(6.0)
    st3, _ = U.batch_combine(b, 2, "median")
    assert st3.collect()[0].version == 2


def test_keyed_fold_counts_pushes_not_keys(spark):
    log = spark.createDataFrame([("a", 1, 0, "l.lora_A", [1.0]), ("a", 1, 0, "l.lora_B", [2.0]),
                                 ("a", 2, 0, "l.lora_A", [1.0]), ("a", 2, 0, "l.base", [9.0])],
                                "expert string, seq long, worker_version long, key string, delta array<double>")
    got = {(r.key, r.pos): (r.version, r.value) for r in U.fold_keyed(U.adapter_keys(log)).collect()}
    assert got[("l.lora_A", 0)] == (2, pytest.approx(1.0 + 1 / 1.1)) and ("l.base", 0) not in got


def test_stream_equals_batch(spark, tmpdir_path):
    rows = _log(n=200)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 3)
    ST.stream_fold(spark, src, sink, ckpt)
    streamed = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    batch = {r.expert: (r.version, r.state) for r in U.fold_scalar(log).collect()}
    assert streamed.keys() == batch.keys()
    for e in batch:
        assert streamed[e][0] == batch[e][0] and streamed[e][1] == pytest.approx(batch[e][1], abs=1e-9)


def test_staleness_profile_and_curve(spark):
    rows = _log(n=60)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    prof = {r.expert: r for r in U.staleness_profile(log).collect()}
    assert all(r.negative_staleness == 0 and r.max_staleness <= 3 for r in prof.values())
    curve = U.version_curve(log.withColumn("step", (F.col("seq") % 7).cast("long"))).collect()
    top = max(r.step for r in curve)
    last = {r.expert: r.version for r in curve if r.step == top}
    assert sum(last.values()) == 60 and {r.global_version for r in curve if r.step == top} == {60}


def test_vector_stream_equals_batch(spark, tmpdir_path):
    rows = _log(n=90, dim=4)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta array<double>")
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 3)
    ST.stream_fold(spark, src, sink, ckpt, vector=True)
    streamed = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    version, state, _, _ = _sequential(rows)
    for e in version:
        assert streamed[e][0] == version[e]
        assert streamed[e][1] == pytest.approx(state[e], abs=1e-9)


def test_stream_resumes_from_checkpoint(spark, tmpdir_path):
    rows = _log(n=160)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    first = log.filter(F.col("seq") < 240)          # seq = 3 * i + 1: the first 80 pushes
    ST.write_push_files(first, src, 2)
    ST.stream_fold(spark, src, sink, ckpt)          # stops after the available files
    ST.write_push_files(log.filter(F.col("seq") >= 240), src, 2)
    ST.stream_fold(spark, src, sink, ckpt)          # restarts: state and offsets from the checkpoint
    streamed = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    batch = {r.expert: (r.version, r.state) for r in U.fold_scalar(log).collect()}
    assert streamed.keys() == batch.keys()
    for e in batch:
        assert streamed[e][0] == batch[e][0] and streamed[e][1] == pytest.approx(batch[e][1], abs=1e-9)


def test_continuous_stream_until_stopped(spark, tmpdir_path):
    rows = _log(n=80)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 2)
    q = ST.stream_fold(spark, src, sink, ckpt, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = {r.expert: r.version for r in ST.latest_states(spark, sink).collect()}
    assert streamed == {r.expert: r.version for r in U.fold_scalar(log).collect()}


def test_staleness_percentiles(spark):
    log = spark.createDataFrame(_log(n=120), "expert string, seq long, worker_version long, delta double")
    rows = U.staleness_profile(log, percentiles=[0.5, 1.0]).collect()
    assert all(len(r.staleness_percentiles) == 2 and r.staleness_percentiles[1] == r.max_staleness for r in rows)


def test_vector_methods_agree(spark):
    rows = _log(n=150, dim=6)
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta array<double>")
    a = {(r.expert, r.pos): (r.version, r.value, r.l2_norm) for r in U.fold_vectors(log, method="summarizer").collect()}
    b = {(r.expert, r.pos): (r.version, r.value, r.l2_norm) for r in U.fold_vectors(log, method="explode").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-12)
        assert a[k][2] == pytest.approx(b[k][2], abs=1e-12)
    ga = {r.pos: r.value for r in U.global_vectors(log, method="summarizer").collect()}
    gb = {r.pos: r.value for r in U.global_vectors(log, method="explode").collect()}
    assert ga.keys() == gb.keys() and all(ga[p] == pytest.approx(gb[p], abs=1e-12) for p in ga)


def test_keyed_methods_agree(spark):
    rows = []
    for e, seq, wv, d in _log(n=90, dim=4):
        rows += [(e, seq, wv, "l.lora_A", d[:2]), (e, seq, wv, "l.lora_B", d[2:])]
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, key string, delta array<double>")
    a = {(r.expert, r.key, r.pos): (r.version, r.value) for r in U.fold_keyed(log).collect()}
    b = {(r.expert, r.key, r.pos): (r.version, r.value) for r in U.fold_keyed(log, method="explode").collect()}
    assert a.keys() == b.keys()
    assert all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-12) for k in a)


def test_odd_pushes_count_and_add_nothing(spark):
    rows = [("a", 1, 0, [1.0, 2.0]), ("a", 2, 50, [9.0, 9.0]), ("a", 3, 2, [5.0]), ("a", 4, 3, [1.0, 1.0]), ("b", 5, 99, [7.0, 7.0]), ("b", 6, 1, None)]
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta array<double>")
    for method in ("summarizer", "explode"):
        got = {(r.expert, r.pos): (r.version, r.value) for r in U.fold_vectors(log, method=method).collect()}
        assert got == {("a", 0): (4, 2.0), ("a", 1): (4, 3.0), ("b", 0): (2, 0.0), ("b", 1): (2, 0.0)}
    why = {(r.expert, r.seq): r.reason for r in U.rejected(log).collect()}
    assert why == {("a", 2): "undefined decay", ("a", 3): "wrong shape", ("b", 5): "undefined decay", ("b", 6): "wrong shape"}
    assert {r.pos: (r.value, r.global_version) for r in U.global_vectors(log).collect()} == {0: (2.0, 6), 1: (3.0, 6)}


def test_snapshots(spark):
    rows = [("a", 1, 0, 1.0), ("b", 2, 0, 3.0), ("a", 3, 0, 1.0), ("x", 4, 0, 9.0)]
    log = spark.createDataFrame(rows, "expert string, seq long, worker_version long, delta double")
    now = {r.expert: (r.version, r.state) for r in U.snapshot(log, ["a", "b", "z"]).collect()}
    assert now == {"a": (2, pytest.approx(1 + 1 / 1.1)), "b": (1, 3.0), "z": (0, 0.0)}
    then = U.snapshot(log, ["a", "b", "z"], expert="a", as_of=2).collect()
    assert [(r.expert, r.version, r.state) for r in then] == [("a", 1, 1.0)]
    assert U.global_snapshot(log, ["a", "b"], as_of=2).collect()[0].global_state == 4.0
    with pytest.raises(KeyError):
        U.snapshot(log, ["a", "b"], expert="x")
    vectors = log.withColumn("delta", F.array("delta", "delta"))
    got = {(r.expert, r.pos): (r.version, r.value) for r in U.snapshot(vectors, ["b", "z"], dim=2).collect()}
    assert got == {("b", 0): (1, 3.0), ("b", 1): (1, 3.0), ("z", 0): (0, 0.0), ("z", 1): (0, 0.0)}
