"""Row-level error isolation for a caller's stages (C6, C9): a stage that fails on a row has no result there.

The reference's chain skips a classifier that raises and goes on with the next one.
A caller's Python stage therefore runs batch-wise on the rows no earlier stage has
settled; a batch that fails is cut in two, and so on, until the failing rows stand
alone. Those rows get no result *from that stage*, and the error is kept beside the
result, so that it can be counted (:func:`stage_errors`). A batch with k failing
rows costs at most about ``2 k log2(rows)`` more calls, one that fails whole 2 per
row; a half is not called if the other half's success already tells that it fails.
A function of one item is called once an item, however many fail.

A batch function must treat its rows one by one: it may be called again on any part
of a batch. A result of another length, a score that is not a number and a missing
column are errors like any other. No domain, no score or a NaN score is no result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME_TYPE = "domain string, score double, reason string, error string"
_COLUMNS = ["domain", "score", "reason"]
ERROR_CHARS = 200

BatchFn = Callable[[pd.DataFrame, Sequence[str]], pd.DataFrame]
ItemFn = Callable[[dict, Sequence[str]], "tuple[str, float, str] | None"]


def _message(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"[:ERROR_CHARS]


def _text(values: pd.Series) -> list:
    return [None if v is None or v is pd.NA or v != v else str(v) for v in values.astype(object).tolist()]


def _scores(values: pd.Series) -> np.ndarray:
    kind = values.dtype
    plain = isinstance(kind, np.dtype) and kind.kind in "iuf"
    return (values if plain else pd.to_numeric(values).astype("float64")).to_numpy(dtype="float64")


def _checked(got: object, n: int) -> tuple:
    """The stage's answer as three columns of n values, or an error."""
    if not isinstance(got, pd.DataFrame):
        raise TypeError(f"a stage returns a DataFrame, not {type(got).__name__}")
    if len(got) != n:
        raise ValueError(f"{len(got)} results for {n} rows")
    return _text(got["domain"]), _scores(got["score"]), _text(got["reason"])


class _Results:
    """Columns of all rows, filled part by part."""

    def __init__(self, n: int):
        self.domain, self.reason, self.error = (np.full(n, None, object) for _ in range(3))
        self.score = np.full(n, np.nan)

    def put(self, lo: int, hi: int, answer: tuple) -> None:
        self.domain[lo:hi], self.score[lo:hi], self.reason[lo:hi] = answer

    def frame(self) -> pd.DataFrame:
        none = pd.isna(self.domain) | np.isnan(self.score)
        self.domain[none], self.score[none], self.reason[none] = None, np.nan, None
        return pd.DataFrame({c: pd.Series(getattr(self, c), dtype="float64" if c == "score" else object) for c in [*_COLUMNS, "error"]})


def run_isolated(fn: BatchFn, rows: pd.DataFrame, domains: Sequence[str]) -> pd.DataFrame:
    """Results of all rows; ``error`` holds the error of each row that fails by itself."""
    out = _Results(len(rows))
    if isinstance(fn, ByItem):
        rows, fn = fn.answers(rows, domains, out.error), _frame_of_answers
    # (first row, end row, whether it is a left half, whether one of its rows must fail)
    pending = [(0, len(rows), False, False)] if len(rows) else []
    while pending:
        lo, hi, left, fails = pending.pop()
        if not fails or hi - lo == 1:
            try:
                part = rows.iloc[lo:hi]
                part.index = pd.RangeIndex(hi - lo)
                out.put(lo, hi, _checked(fn(part, domains), hi - lo))
                if left:                # then the right half fails, and is cut without a call
                    pending[-1] = (*pending[-1][:3], True)
                continue
            except Exception as e:  # noqa: BLE001 - any error of the caller's code is that row's
                if hi - lo == 1:
                    out.error[lo] = _message(e)
                    continue
        mid = (lo + hi) // 2
        pending += [(mid, hi, False, False), (lo, mid, True, False)]
    return out.frame()


def isolated(fn: BatchFn, domains: Sequence[str]) -> Callable[[Column, Column], Column]:
    """(struct of the inputs, open rows) -> struct of :data:`OUTCOME_TYPE`; closed rows are not shown to ``fn``."""
    wanted = list(domains)

    @F.pandas_udf(OUTCOME_TYPE)
    def run(rows: pd.DataFrame, is_open: pd.Series) -> pd.DataFrame:
        live = is_open.fillna(False).astype(bool).to_numpy()
        out = pd.DataFrame({"domain": None, "score": float("nan"), "reason": None, "error": None}, index=range(len(rows)), dtype=object)
        if live.any():
            got = run_isolated(fn, rows[live].reset_index(drop=True), wanted)
            out.loc[live, :] = got[[*_COLUMNS, "error"]].to_numpy(dtype=object)
        return out.astype({"score": "float64"})
    return run


class ByItem:
    """A batch function of a function of one item, which is called once an item, whatever fails."""

    def __init__(self, fn: ItemFn):
        self.fn = fn

    def __call__(self, rows: pd.DataFrame, domains: Sequence[str]) -> pd.DataFrame:
        return _frame_of_answers(pd.DataFrame({"answer": pd.Series([self._answer(x, domains) for x in _items(rows)], dtype=object)}), domains)

    def _answer(self, item: dict, domains: Sequence[str]) -> tuple | None:
        got = self.fn(item, domains)
        if got is not None and len(got := tuple(got)) != len(_COLUMNS):
            raise ValueError(f"{len(_COLUMNS)} columns passed, passed data had {len(got)} columns")
        return got

    def answers(self, rows: pd.DataFrame, domains: Sequence[str], errors: np.ndarray) -> pd.DataFrame:
        """A column of answers, None where the function raises; ``errors`` takes what it raises."""
        got: list = [None] * len(rows)
        for i, item in enumerate(_items(rows)):
            try:
                got[i] = self._answer(item, domains)
            except Exception as e:  # noqa: BLE001 - any error of the caller's code is that row's
                errors[i] = _message(e)
        return pd.DataFrame({"answer": pd.Series(got, dtype=object)})


def _items(rows: pd.DataFrame) -> list[dict]:
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


def _frame_of_answers(rows: pd.DataFrame, domains: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if g is None else g for g in rows["answer"]], columns=_COLUMNS)


def by_item(fn: ItemFn) -> BatchFn:
    """A batch function of a function of one item (a dict of the inputs) -> (domain, score, reason) or None."""
    return ByItem(fn)


def stage_errors(routed: DataFrame) -> DataFrame:
    """(stage, error, n) over the ``errors`` of a routed table: the side output, two narrow partial aggregations."""
    # outer: for a plain explode Spark adds a filter on ``errors`` below it, for which every Python stage runs a second time
    each = routed.select(F.explode_outer("errors").alias("e")).where("e is not null").select("e.stage", "e.error")
    return each.groupBy("stage", "error").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
