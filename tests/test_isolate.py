"""A stage that raises on a row is skipped for that row only."""
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusfold.operators import classify as C
from corpusfold.operators import isolate as I


def _double(rows, domains):
    if (rows["x"] < 0).any():
        raise ValueError("negative")
    return pd.DataFrame({"domain": domains[0], "score": rows["x"] / 100, "reason": "r" + rows["x"].astype(str)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-3, 60), max_size=40))
def test_only_failing_rows_fail(xs):
    calls = []

    def counted(rows, domains):
        calls.append(len(rows))
        return _double(rows, domains)
    got = I.run_isolated(counted, pd.DataFrame({"x": pd.Series(xs, dtype="int64")}), ["d"])
    assert len(got) == len(xs)
    for x, r in zip(xs, got.itertuples()):
        assert (r.error == "ValueError: negative") if x < 0 else (r.error is None and r.score == x / 100 and r.reason == f"r{x}")
    bad = sum(x < 0 for x in xs)
    assert sum(calls) <= len(xs) * 8 and len(calls) <= 1 + 2 * bad * 7


@pytest.mark.parametrize("answer,error", [
    (lambda rows: "text", "TypeError"), (lambda rows: pd.DataFrame({"domain": []}), "ValueError"),
    (lambda rows: pd.DataFrame({"domain": ["a"] * len(rows)}), "KeyError"),
    (lambda rows: pd.DataFrame({"domain": ["a"] * len(rows), "score": "high", "reason": "x"}), "ValueError")])
def test_wrong_answers_are_errors(answer, error):
    got = I.run_isolated(lambda rows, domains: answer(rows), pd.DataFrame({"x": [1, 2, 3]}), [])
    assert got["error"].str.startswith(error).all() and got["score"].isna().all()


def test_no_domain_no_score_and_nan_are_no_result():
    rows = pd.DataFrame({"x": [1, 2, 3, 4]})
    out = pd.DataFrame({"domain": ["a", None, "c", "d"], "score": [0.5, 0.5, None, float("nan")], "reason": [None, "r", "r", "r"]})
    got = I.run_isolated(lambda rows, domains: out, rows, [])
    assert got["domain"].isna().tolist() == [False, True, True, True] and got["error"].isna().all()


def _items(spark, n=60):
    rows = [(i, f"text {i}", None if i % 7 == 0 else f"code {i}", "pandas" if i % 5 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, prompt string, code string, library string").repartition(3)


def test_chain_skips_the_stage_and_counts_it(spark):
    def fussy(rows, domains):
        if rows["code"].isna().any():
            raise LookupError("no code")
        return pd.DataFrame({"domain": "docs", "score": 0.95, "reason": "fussy"}, index=range(len(rows)))

    def lazy(item, domains):
        assert item["code"] is None                     # rows that the first stage has settled are not shown
        return None if item["library"] is None else ("python", 1 / (item["item_id"] % 2), "lazy")
    stages = [C.stage_from_batch_fn("fussy", fussy, inputs=["code"]),
              C.stage_from_item_fn("lazy", lazy, inputs=["item_id", "library", "code"])]
    routed = C.classify_chain(_items(spark), ["docs", "python"], "python", stages=stages, with_errors=True).cache()
    for r in routed.collect():
        want = []
        if r.item_id % 7 == 0:
            want.append(("fussy", "LookupError: no code"))
            if r.item_id % 35 == 0 and r.item_id % 2 == 0:
                want.append(("lazy", "ZeroDivisionError: division by zero"))
        assert [tuple(e) for e in r.errors] == want
        by = "fussy" if r.item_id % 7 else "lazy" if r.item_id == 35 else "Default fallback"
        assert r.reason == by and r.domain == ("docs" if by == "fussy" else "python")
    assert {(r.stage, r.n) for r in I.stage_errors(routed).collect()} == {("fussy", 9), ("lazy", 1)}
    one = C.classify_stage(_items(spark), stages[0], ["docs"], with_errors=True)
    assert one.where(F.size("errors") > 0).count() == 9 and one.where("domain = 'docs'").count() == 51
    routed.unpersist()


def test_column_stage_names_its_failures(spark):
    rate = F.try_divide(F.lit(1), F.col("item_id") % 3)
    stage = C.stage_from_column_fn("rate", lambda d: F.when(rate.isNotNull(), C.make_result(F.lit("docs"), F.lit(0.5), F.lit("rate"))),
                                   failed=lambda d: F.when(rate.isNull(), F.lit("division by zero")))
    routed = C.classify_chain(_items(spark), ["docs"], "docs", stages=[stage, C.COMPLEXITY], with_errors=True)
    assert [(r.stage, r.error, r.n) for r in I.stage_errors(routed).collect()] == [("rate", "division by zero", 20)]
    assert routed.where("reason = 'rate'").count() == 40


def test_no_rows_and_no_failing_stage(spark):
    none = _items(spark).where("false")
    stage = C.stage_from_item_fn("any", lambda item, domains: 1 / 0, inputs=["prompt"])
    assert C.classify_chain(none, ["docs"], "docs", stages=[stage], with_errors=True).collect() == []
    plain = C.classify_chain(_items(spark), ["docs", "python"], "docs", with_errors=True)
    assert plain.where(F.size("errors") > 0).count() == 0


def test_an_item_function_is_called_once_an_item():
    calls = []

    def picky(item, domains):
        calls.append(item["x"])
        return {0: ("d", 0.5, "r"), 1: None, 2: ("d", "high", "r"), 3: ("d", 0.5)}[item["x"] % 5]      # 4: KeyError
    got = I.run_isolated(I.by_item(picky), pd.DataFrame({"x": range(1000)}), [])
    assert calls == list(range(1000))
    assert got["error"].isna().sum() == 400 and got["domain"].notna().sum() == 200
    assert got["error"][4] == "KeyError: 4" and got["error"][2].startswith("ValueError: ") and got["error"][3].startswith("ValueError: 3 columns")


def test_a_half_that_must_fail_is_not_called():
    calls = []

    def counted(rows, domains):
        calls.append(len(rows))
        return _double(rows, domains)
    got = I.run_isolated(counted, pd.DataFrame({"x": [*range(1023), -1]}), ["d"])
    assert got["error"].notna().tolist() == [False] * 1023 + [True]
    assert calls == [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1, 1]


def test_counting_errors_runs_each_stage_once(spark):
    def fussy(rows, domains):
        raise LookupError("no code")
    stages = [C.stage_from_batch_fn("fussy", fussy, inputs=["code"]), C.stage_from_item_fn("lazy", lambda item, domains: 1 / 0, inputs=["code"])]
    errors = I.stage_errors(C.classify_chain(_items(spark), ["docs"], "docs", stages=stages, with_errors=True))
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == len(stages)
    assert {(r.stage, r.n) for r in errors.collect()} == {("fussy", 60), ("lazy", 60)}
