"""Evaluation metrics and score-table reports against direct Python statements of the semantics."""
import pytest

from corpusfold.operators import evaluate as EV


def test_pair_metrics_and_syntax(spark):
    rows = [(0, "x = 1", " x = 1 "), (1, "def f(:", "def f(): pass"), (2, "", ""), (3, "a b", "b c d")]
    df = spark.createDataFrame(rows, "i int, generated_code string, reference_code string")
    got = {r.i: r for r in EV.pair_metrics(df, keep=["i"], with_syntax=True).collect()}
    assert got[0].exact_match == 1.0 and got[0].exec_pass is True
    assert got[1].exec_pass is False and got[2].exec_pass is True and got[2].similarity == 0.0
    assert got[3].similarity == pytest.approx(1 / 4)
    agg = EV.batch_evaluate(EV.pair_metrics(df, with_syntax=True)).collect()[0]
    assert agg.n == 4 and agg.exec_pass == pytest.approx(0.5)   # 'a b' does not compile
    empty = EV.batch_evaluate(EV.pair_metrics(df.limit(0), with_syntax=True)).collect()[0]
    assert (empty.n, empty.exact_match, empty.exec_pass, empty.similarity) == (0, 0.0, 0.0, 0.0)


def test_head_eval_first_k_and_suffix(spark):
    ref = "print(1)" + " " * 60
    rows = [("py", i, ref if i < 3 else "zzz") for i in range(6)] + [("sq", 10, "")]
    df = spark.createDataFrame(rows, "domain string, item_id long, reference_code string")
    got = {r.domain: r for r in EV.head_eval(df, k=3, length=50).collect()}
    assert got["py"].n == 3 and got["py"].exact_match == 1.0 and got["sq"].exact_match == 1.0
    every = {r.domain: r for r in EV.head_eval(df).collect()}        # no cap: all rows, whole texts
    assert every["py"].n == 6 and every["py"].exact_match == 1.0
    rnd = {r.domain: r for r in EV.head_eval(df, k=5, length=50, suffix="...", with_syntax=True).collect()}
    assert rnd["py"].exact_match == 0.0 and rnd["sq"].exec_pass == 1.0   # '...' compiles


def _scores(spark):
    rows = [("f", 1, "x", 0.5), ("f", 2, "x", 0.2), ("f", 2, "y", 0.9), ("i", 1, "x", 0.4), ("i", 2, "x", 0.6),
            ("i", 2, "y", 0.1)]
    return spark.createDataFrame(rows, "run string, step long, domain string, score double")


def test_compare_rank_forgetting(spark):
    s = _scores(spark)
    c = EV.run_compare(s, "f", "i").collect()[0]
    fa, ia = (0.5 + (0.2 + 0.9) / 2) / 2, (0.4 + (0.6 + 0.1) / 2) / 2
    assert c.a_avg_quality == pytest.approx(fa) and c.b_avg_quality == pytest.approx(ia)
    assert c.improvement_percent == pytest.approx((fa - ia) / (ia + 1e-6) * 100)
    assert c.a_final_quality == pytest.approx(0.55)
    assert EV.run_compare(s, "f", "missing").count() == 0
    rank = [r.setting for r in EV.setting_rank(s).orderBy("rank").collect()]
    assert rank == ["f", "i"]
    fg = {r.run: r for r in EV.forgetting(s).collect()}
    assert fg["f"].avg_forgetting == pytest.approx((0.3 + 0.0) / 2)
    assert fg["f"].final_overall == pytest.approx(0.55)
    curve = {(r.run, r.step, r.domain): r.forgetting for r in EV.forgetting_curve(s).collect()}
    assert curve[("f", 2, "x")] == pytest.approx(0.3)
