import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfold.llm import hard_negatives as H
from odd_tables import odd_vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain_negatives(rows):
    """The contract, pair by pair."""
    kept = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(float(np.float32(x)) * 256)) for x in e)) for i, lab, e in rows
            if i is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for i, lab, w in kept:
        if i % 100:
            continue
        others = [(-sum(x * y for x, y in zip(w, v)), j, own) for j, own, v in kept if j != i and len(v) == len(w)]
        best = sorted({(s, j) for s, j, own in others if own == lab})[:5]
        for p, j in best:
            fit = sorted({(s, k) for s, k, own in others if own != lab and 30 * -p <= 100 * -s <= 90 * -p})[:10]
            out += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(fit)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 140), st.integers(1, 7), st.sampled_from([1, 40, 1 << 20]))
def test_intervals_hold_every_score(seed, dim, levels, most):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-most, most + 1, (40, dim)), rng.integers(-most, most + 1, (9, dim))
    x[:3] = 0
    x[3], q[0] = q[1], 0
    low, high = H.Questions(np.arange(9), np.zeros(9, int), q, levels).intervals(slice(0, 9), *H.encode(x, levels))
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()


def test_levels_narrow_the_intervals():
    rng = np.random.default_rng(2)
    x = rng.integers(-90, 90, (3000, 64))
    share = []
    for levels in (1, 3, 6):
        low, high = H.Questions(np.arange(20), np.zeros(20, int), x[:20], levels).intervals(slice(0, 20), *H.encode(x, levels))
        share.append((high >= np.partition(low, -5, axis=1)[:, [-5]]).mean())
    assert share[0] > share[1] > share[2] and share[2] < 0.1


def mined(df, **given):
    return sorted(tuple(r) for r in H.mine_negatives(df, **given).collect())


@pytest.mark.parametrize("given", [{}, {"anchors": 2}, {"levels": 1}])
def test_odd_vectors(spark, given):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS anchor", "2 AS list", "3 AS dim", "'x' AS score", "4 AS hash")
    assert mined(df, **given) == plain_negatives(rows)


def test_ties_repeats_and_a_hot_vector(spark):
    rng = np.random.default_rng(8)
    hot = [0.25, 0.5, -0.25, 0.125]
    rows = [(i, int(i % 3), hot if i % 3 == 0 or i % 100 == 0 else [float(x) for x in rng.integers(-4, 5, 4) / 4]) for i in range(900)]
    rows += rows[:40] * 3                               # repeated rows
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(6), anchors=4) == plain_negatives(rows)


def test_ranges_of_scores():
    for p in list(range(-50, 51)) + [10**12 + 7]:
        low, high = H.score_range(np.array([p]))
        fits = [s for s in range(-60, 61) if 30 * p <= 100 * s <= 90 * p]
        if abs(p) <= 50:
            assert fits == list(range(int(low[0]), int(high[0]) + 1))


def test_empty_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, None, [1.0]), (200, 1, None), (300, 1, [])], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0, 2.0])], SCHEMA)) == []
