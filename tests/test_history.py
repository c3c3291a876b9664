"""U1 in time, U8 histories and U9 incremental state against the coordinator, one push at a time."""
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusfold.operators import history as H
from corpusfold.operators import updates as U
from corpusfold.operators.sequence import running_count, running_rank
from corpusfold.streaming import fold as ST

SCALAR = "expert string, seq long, worker_version long, delta double"
VECTOR = "expert string, seq long, worker_version long, delta array<double>"


def pushes(n=300, dim=None, seed=5, hot=0.5, experts=("a", "b", "c")):
    rng = random.Random(seed)
    delta = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(dim)] if dim else round(rng.uniform(-1, 1), 3)
    return [("hot" if rng.random() < hot else rng.choice(experts), 3 * i + 1, rng.randrange(0, 5), delta()) for i in range(n)]


def coordinator(rows, registrations=None, upto=None):
    """{expert: (version, state)} and (version, state) of all, applying pushes and registrations in order."""
    events = [(s, 1, e, wv, d) for e, s, wv, d in rows if upto is None or s <= upto]
    known = None if registrations is None else set()
    events += [(s, 0, e, None, None) for e, s in registrations or [] if s is not None]
    states, whole = {}, [0, 0.0]
    for s, kind, e, wv, d in sorted(events, key=lambda x: x[:2]):
        if kind == 0:
            known.add(e)
            states.setdefault(e, (0, 0.0))
        elif known is None or e in known:
            v, st = states.get(e, (0, 0.0))
            den = 1 + 0.1 * (v - wv)
            add = [x / den for x in d] if isinstance(d, list) else d / den
            plus = lambda a, b: [x + y for x, y in zip(a or [0.0] * len(b), b)] if isinstance(b, list) else a + b
            states[e] = (v + 1, plus(st, add) if den > 0 else st)
            whole = [whole[0] + 1, plus(whole[1], add) if den > 0 else whole[1]]
    return states, tuple(whole)


def close(a, b):
    return a == pytest.approx(b, abs=1e-9)


# ---------------------------------------------------------------- U1 in time

REGISTRATIONS = [("hot", 300), ("hot", 60), ("hot", 900), ("a", 1), ("b", 400), ("b", 400), ("never", 7), ("c", None), (None, 5)]


def test_pushes_before_the_registration_never_came(spark):
    rows = pushes()
    log = spark.createDataFrame(rows, SCALAR).repartition(5)
    reg = spark.createDataFrame(REGISTRATIONS, "expert string, seq long")
    want, whole = coordinator(rows, [r for r in REGISTRATIONS if r[0] is not None])
    got = {r.expert: (r.version, r.state) for r in U.expert_states_in_time(reg, log).where("expert is not null").collect()}
    assert got.keys() == want.keys() == {"hot", "a", "b", "never"} and got["never"] == (0, 0.0)
    assert all(got[e][0] == want[e][0] and close(got[e][1], want[e][1]) for e in want)
    g = U.global_scalar(log, registrations=reg).first()
    assert g.global_version == whole[0] and close(g.global_state, whole[1])
    kept = {(r.expert, r.seq) for r in U.accepted_in_time(log, reg).collect()}
    assert kept == {(e, s) for e, s, _, _ in rows if {"hot": 60, "a": 1, "b": 400}.get(e, 10**9) <= s}


def test_vector_pushes_in_time_and_extra_columns(spark):
    rows = pushes(120, dim=3)
    log = spark.createDataFrame(rows, VECTOR).withColumn("rank", F.lit("x")).withColumn("mark", F.lit(1))
    reg = spark.createDataFrame(REGISTRATIONS, "expert string, seq long").withColumn("by", F.lit("operator"))
    kept = U.accepted_in_time(log, reg)
    assert kept.columns == log.columns
    want, _ = coordinator(rows, [r for r in REGISTRATIONS if r[0] is not None])
    got = {}
    for r in U.fold_vectors(kept).collect():
        got.setdefault(r.expert, {})[r.pos] = r.value
    for e, values in got.items():
        assert close([values[i] for i in range(3)], want[e][1])


def test_no_registrations_and_no_pushes(spark):
    log, none = spark.createDataFrame(pushes(20), SCALAR), spark.createDataFrame([], "expert string, seq long")
    assert U.accepted_in_time(log, none).collect() == [] and U.expert_states_in_time(none, log).collect() == []
    reg = spark.createDataFrame([("a", 1)], "expert string, seq long")
    assert [tuple(r) for r in U.expert_states_in_time(reg, log.where("false")).collect()] == [("a", 0, 0.0)]


def test_a_hot_expert_fills_many_partitions(spark):
    log = spark.range(20_000).select(F.lit("hot").alias("expert"), F.col("id").alias("seq"), (F.col("id") % 10 == 0).alias("mark"))
    ranked = running_rank(log, ["expert"], "seq", partitions=16, mark="mark")
    assert ranked.where("rank <> seq + 1 OR mark_rank <> 1").count() == 0
    counted = running_count(log, ["expert"], "seq", "mark")
    assert counted.where(F.col("marks") != F.floor(F.col("seq") / 10) + 1).count() == 0


# ------------------------------------------------------------------ U8 history

def check(spark, path, rows, points, dim=None):
    got = {}
    for r in H.read_as_of(spark, path, points).collect():
        got.setdefault(r.as_of, {})[r.expert] = (r.version, r.state)
    for p in points:
        want, _ = coordinator(rows, upto=p)
        for e, (v, s) in got[p].items():
            wv, ws = want.get(e, (0, [0.0] * dim if dim else 0.0))
            assert v == wv and close(s, ws), (p, e)
        assert set(want) <= set(got[p])


@pytest.mark.parametrize("dim,every", [(None, 4), (3, 4), (3, 64), (None, 2)])
def test_states_as_of_any_push(spark, tmpdir_path, dim, every):
    rows = pushes(300, dim=dim)
    log = spark.createDataFrame(rows, VECTOR if dim else SCALAR).repartition(4)
    path = f"{tmpdir_path}/h"
    assert H.write_history(log, path, every=every, parts=4)
    check(spark, path, rows, [-5, 0, 1, 2, 4, 100, 301, 302, 555, 10**6], dim)


def test_appended_segments(spark, tmpdir_path):
    rows = pushes(240, dim=2) + [("late", 5000 + i, 0, [1.0, 2.0]) for i in range(9)]
    log = spark.createDataFrame(rows, VECTOR)
    path = f"{tmpdir_path}/h"
    H.write_history(log.where("seq < 200"), path, every=4)
    assert H.append_history(log.where("seq >= 200 AND seq < 450"), path)
    assert not H.append_history(log.where("false"), path)
    assert H.append_history(log.where("seq >= 450"), path)
    assert len(H.heads(spark, path)) == 3
    check(spark, path, rows, [1, 150, 199, 200, 333, 449, 460, 5003, 9999], 2)
    with pytest.raises(ValueError):
        H.append_history(log.where("seq >= 450"), path)
    with pytest.raises(ValueError):
        H.write_history(log, path)
    for p in (150, 460, 9999):
        want = coordinator(rows, upto=p)[1]
        g = H.global_as_of(spark, path, [p]).first()
        assert g.global_version == want[0] and close(g.global_state, want[1])


def test_a_read_opens_the_parts_it_needs_only(spark, tmpdir_path):
    rows = pushes(400, dim=2, hot=0.8)
    path = f"{tmpdir_path}/h"
    H.write_history(spark.createDataFrame(rows, VECTOR), path, every=4, parts=32)
    one = H.read_as_of(spark, path, [700], experts=["hot"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("\n")[0] for x in plan.split("FileScan")[1:]]
    parts = {kind: re.findall(r"part#\d+ (?:= (\d+)|IN \(([\d,]+)\))", next(x for x in scans if kind in x).split("PartitionFilters")[1])
             for kind in ("vector#", "prefix#")}
    assert [len((a or b).split(",")) for a, b in parts["vector#"]] == [1] < [len(os.listdir(f"{path}/segment-0/pushes"))]
    assert parts["prefix#"]
    want = coordinator(rows, upto=700)[0]["hot"]
    got = one.first()
    assert got.version == want[0] and close(got.state, want[1])
    with pytest.raises(KeyError):
        H.read_as_of(spark, path, [700], experts=["nobody"])


def test_odd_pushes_and_registrations_in_a_history(spark, tmpdir_path):
    rows = [("a", 1, 0, [1.0, 1.0]), ("a", 2, 50, [1.0, 1.0]), ("a", 3, 0, [9.0]), ("a", 4, 3, [2.0, 0.0]), ("b", 5, 0, [5.0, 5.0])]
    path = f"{tmpdir_path}/h"
    H.write_history(spark.createDataFrame(rows, VECTOR), path, registry=["a"], every=2)
    got = {(r.as_of, r.expert): (r.version, r.state) for r in H.read_as_of(spark, path, [1, 3, 4]).collect()}
    assert got.keys() == {(1, "a"), (3, "a"), (4, "a")}
    assert got[3, "a"] == (3, [1.0, 1.0]) and got[4, "a"][0] == 4 and close(got[4, "a"][1], [3.0, 1.0])
    timed = f"{tmpdir_path}/t"
    reg = spark.createDataFrame([("a", 2), ("b", 99)], "expert string, seq long")
    H.write_history(spark.createDataFrame(rows, VECTOR), timed, registry=reg, dim=2)
    assert [(r.expert, r.version) for r in H.read_as_of(spark, timed, [4]).collect()] == [("a", 3)]


# ------------------------------------------------------------ U9 incremental state

def stream_check(spark, sink, rows, dim=None):
    want, whole = coordinator(rows)
    got = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    assert got.keys() == want.keys()
    assert all(got[e][0] == want[e][0] and close(got[e][1], want[e][1]) for e in want)
    g = ST.latest_global(spark, sink).first()
    assert g.global_version == whole[0] and close(g.global_state, whole[1])


def _names(sink, kind):
    return sorted(n for n in os.listdir(f"{sink}/{kind}") if not n.startswith(("_", ".")))


@pytest.mark.parametrize("dim", [None, 3])
def test_stream_with_compaction_and_retention(spark, tmpdir_path, dim):
    rows = pushes(200, dim=dim)
    log = spark.createDataFrame(rows, VECTOR if dim else SCALAR)
    src, sink, ckpt = (os.path.join(tmpdir_path, x) for x in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 7)
    ST.stream_fold(spark, src, sink, ckpt, vector=dim is not None, compact_every=2, horizon=3)
    stream_check(spark, sink, rows, dim)
    assert _names(sink, "base") == ["upto=3", "upto=5"]                          # the last one and the one before it
    assert _names(sink, "delta") == ["batch=4", "batch=5", "batch=6"]
    assert _names(sink, "seen") == ["batch=3", "batch=4", "batch=5", "batch=6"]


def test_files_delivered_twice(spark, tmpdir_path):
    rows = pushes(150, dim=2)
    log = spark.createDataFrame(rows, VECTOR)
    src, sink, ckpt = (os.path.join(tmpdir_path, x) for x in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 3)
    ST.stream_fold(spark, src, sink, ckpt, vector=True)
    log.where("seq > 200").coalesce(1).write.mode("append").parquet(src)         # other names
    log.where("seq > 100").unionAll(log).coalesce(1).write.mode("append").parquet(src)
    ST.stream_fold(spark, src, sink, ckpt, vector=True)
    stream_check(spark, sink, rows, 2)


def test_restart_in_the_middle_of_a_compaction(spark, tmpdir_path, monkeypatch):
    rows = pushes(160)
    log = spark.createDataFrame(rows, SCALAR)
    src, sink, ckpt = (os.path.join(tmpdir_path, x) for x in ("src", "sink", "ckpt"))
    ST.write_push_files(log, src, 6)
    marked = ST.mark_path

    def dies(session, path):
        if "/base/upto=3/" in path:
            raise RuntimeError("lost")                  # all written, but for the mark
        marked(session, path)
    monkeypatch.setattr(ST, "mark_path", dies)
    with pytest.raises(Exception):
        ST.stream_fold(spark, src, sink, ckpt, compact_every=2)
    monkeypatch.setattr(ST, "mark_path", marked)
    assert ST._numbers(spark, sink, "base", "upto") == [1]
    stream_check(spark, sink, [r for r in rows if r[1] <= max(s for s, n in _seen(spark, sink))])
    ST.stream_fold(spark, src, sink, ckpt, compact_every=2)
    stream_check(spark, sink, rows)
    assert ST._numbers(spark, sink, "base", "upto") == [3, 5]


def _seen(spark, sink):
    return [(r.seq, r.batch) for r in spark.read.parquet(f"{sink}/seen").collect()]


def test_a_batch_is_run_again_after_its_compaction(spark, tmpdir_path):
    rows = pushes(90)
    log = spark.createDataFrame(rows, SCALAR)
    sink = os.path.join(tmpdir_path, "sink")
    parts = [log.where(f"seq >= {a} AND seq < {a + 91}") for a in range(1, 273, 91)]
    for i, part in enumerate(parts):
        for _ in range(2):                              # each batch twice, its compaction too
            ST._fold_batch(part, sink, i, None, None, 64)
            ST.compact(spark, sink, i)
    stream_check(spark, sink, rows)


def test_stream_with_registrations(spark, tmpdir_path):
    rows = pushes(200)
    reg = [(e, s) for e, s in REGISTRATIONS if e is not None and s is not None]
    log = spark.createDataFrame(rows, SCALAR)
    src, sink, ckpt, regs = (os.path.join(tmpdir_path, x) for x in ("src", "sink", "ckpt", "regs"))
    spark.createDataFrame(reg, "expert string, seq long").write.parquet(regs)
    ST.write_push_files(log, src, 4)
    ST.stream_fold(spark, src, sink, ckpt, registrations=regs)
    want, whole = coordinator(rows, reg)
    got = {r.expert: (r.version, r.state) for r in ST.latest_states(spark, sink).collect()}
    assert got.keys() == {e for e, (v, _) in want.items() if v}
    assert all(got[e][0] == want[e][0] and close(got[e][1], want[e][1]) for e in got)
    assert ST.latest_global(spark, sink).first().global_version == whole[0]
