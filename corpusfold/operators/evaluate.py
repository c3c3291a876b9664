"""Code-quality evaluation and run comparison.

Per-pair metrics are JVM expressions, except syntax validity (F12), which
needs Python's own ``compile``: an Arrow-batched ``pandas_udf`` that compiles
and never executes. Aggregations are plain ``groupBy``; windows run over
already-aggregated score tables (run x step x domain), never over items.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from corpusfold.functions.text import exact_match, prefix, token_overlap
from corpusfold.session import ship_package

_COMPILE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError)


def _compiles(src: object) -> bool:
    s = "" if src is None else str(src)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(s, "<string>", "exec")
        return True
    except _COMPILE_ERRORS:
        return False


@pandas_udf(BooleanType())
def syntax_valid(code: pd.Series) -> pd.Series:
    """does the text compile as a Python module (nothing is executed)."""
    return code.map(_compiles).astype(bool)


def pair_metrics(df: DataFrame, generated: str = "generated_code", reference: str = "reference_code",
                 keep: Sequence[str] = (), with_syntax: bool = False) -> DataFrame:
    """Per-pair exact match (F10) and token overlap (F11, also the similarity);
    ``with_syntax`` adds syntax validity / execution pass (F12)."""
    cols: list[Column | str] = [*keep,
                                exact_match(generated, reference).alias("exact_match"),
                                token_overlap(generated, reference).alias("similarity")]
    if with_syntax:
        ship_package(df.sparkSession)
        cols.append(syntax_valid(F.coalesce(F.col(generated), F.lit(""))).alias("exec_pass"))
    return df.select(*cols)


def batch_evaluate(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean exact match, execution pass and similarity; zeros for an empty batch."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n"),
            F.coalesce(F.avg("exact_match"), F.lit(0.0)).alias("exact_match")]
    if "exec_pass" in scored.columns:
        aggs.append(F.coalesce(F.avg(F.col("exec_pass").cast("double")), F.lit(0.0)).alias("exec_pass"))
    if "similarity" in scored.columns:
        aggs.append(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity"))
    return scored.groupBy(*group_cols).agg(*aggs) if group_cols else scored.agg(*aggs)


def first_k(df: DataFrame, group_col: str, order_col: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order_col``.

    ``row_number() <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so each map task forwards at most ``k`` rows per group
    and a hot group does not travel whole.
    """
    w = Window.partitionBy(group_col).orderBy(order_col)
    return df.withColumn("_cf_rn", F.row_number().over(w)).filter(F.col("_cf_rn") <= k).drop("_cf_rn")


def domain_eval(df: DataFrame, domain_col: str = "domain", generated: str = "generated_code",
                reference: str = "reference_code", with_syntax: bool = False) -> DataFrame:
    """A9 over every row: candidates against references per domain, then the unweighted macro mean over domains."""
    scored = pair_metrics(df, generated, reference, keep=[domain_col], with_syntax=with_syntax)
    per_domain = batch_evaluate(scored, [domain_col])
    w = Window.partitionBy()   # over one row per domain
    out = per_domain.withColumn("macro_exact_match", F.avg("exact_match").over(w))
    if with_syntax:
        out = (out.withColumn("macro_exec_pass", F.avg("exec_pass").over(w))
               .withColumn("quality", (F.col("macro_exact_match") + F.col("macro_exec_pass")) / 2))
    return out.withColumnRenamed(domain_col, "domain") if domain_col != "domain" else out


def head_eval(df: DataFrame, domain_col: str = "domain", order_col: str = "item_id", reference: str = "reference_code",
              k: int | None = None, length: int | None = None, suffix: str = "", with_syntax: bool = False) -> DataFrame:
    """A9's self-test form: the candidate is the reference's own text (its first ``length`` characters if
    given, plus ``suffix``); all rows of each domain, or the first ``k`` if given."""
    head = df.select(domain_col, order_col, reference)
    if k is not None:
        head = first_k(head, domain_col, order_col, k)
    own = F.concat(F.col(reference), F.lit(suffix)) if length is None else prefix(reference, length, suffix)
    return domain_eval(head.withColumn("_cf_gen", own), domain_col, "_cf_gen", reference, with_syntax)


# --------------------------------------------------------- score-table reports

def step_quality(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Macro mean over domains per (run, step)."""
    return scores.groupBy("run", "step").agg(F.avg(score_col).alias("quality"))


def run_compare(scores: DataFrame, run_a: str, run_b: str, score_col: str = "score") -> DataFrame:
    """Mean and final quality of two runs and ``100*(a-b)/(b+1e-6)``; empty if a run is missing."""
    q = step_quality(scores.filter(F.col("run").isin(run_a, run_b)), score_col)
    per_run = q.groupBy("run").agg(F.avg("quality").alias("avg_q"), F.max_by("quality", "step").alias("final_q"))
    row = per_run.agg(
        F.max(F.when(F.col("run") == run_a, F.col("avg_q"))).alias("a_avg_quality"),
        F.max(F.when(F.col("run") == run_b, F.col("avg_q"))).alias("b_avg_quality"),
        F.max(F.when(F.col("run") == run_a, F.col("final_q"))).alias("a_final_quality"),
        F.max(F.when(F.col("run") == run_b, F.col("final_q"))).alias("b_final_quality"))
    return (row.filter(F.col("a_avg_quality").isNotNull() & F.col("b_avg_quality").isNotNull())
            .select(F.lit(run_a).alias("run_a"), F.lit(run_b).alias("run_b"),
                    "a_avg_quality", "b_avg_quality",
                    ((F.col("a_avg_quality") - F.col("b_avg_quality")) /
                     (F.col("b_avg_quality") + F.lit(1e-6)) * F.lit(100.0)).alias("improvement_percent"),
                    "a_final_quality", "b_final_quality"))


def setting_rank(scores: DataFrame, score_col: str = "score", settings: Sequence[str] | None = None) -> DataFrame:
    """Settings (runs) by overall quality = macro mean over domains at the run's last step;
    descending, ties kept in setting order (``settings`` list, else by name)."""
    last = scores.groupBy("run").agg(F.max("step").alias("_last"))
    at_last = scores.join(last, "run").filter(F.col("step") == F.col("_last"))
    overall = at_last.groupBy("run").agg(F.avg(score_col).alias("overall_quality"),
                                         F.count(F.lit(1)).cast("bigint").alias("num_domains"))
    if settings:
        pos = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in settings]), F.col("run")), F.lit(10**9))
    else:
        pos = F.lit(0)
    w = Window.orderBy(F.desc("overall_quality"), pos, F.col("run"))
    return overall.select(F.row_number().over(w).cast("bigint").alias("rank"),
                          F.col("run").alias("setting"), "overall_quality", "num_domains")


def forgetting(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Per run, mean over domains of max(0, best-so-far (floor 0) - score at the last phase
    (missing = 0)), and the final overall (mean over domains seen in the last phase)."""
    last = scores.groupBy("run").agg(F.max("step").alias("_last"))
    j = scores.join(last, "run")
    per_dom = j.groupBy("run", "domain").agg(
        F.greatest(F.max(score_col), F.lit(0.0)).alias("best"),
        F.coalesce(F.max(F.when(F.col("step") == F.col("_last"), F.col(score_col))), F.lit(0.0)).alias("last_score"),
        F.max((F.col("step") == F.col("_last")).cast("int")).alias("_in_last"))
    per_dom = per_dom.withColumn("forgetting", F.greatest(F.col("best") - F.col("last_score"), F.lit(0.0)))
    return per_dom.groupBy("run").agg(
        F.avg("forgetting").alias("avg_forgetting"),
        F.avg(F.when(F.col("_in_last") == 1, F.col("last_score"))).alias("final_overall"),
        F.count(F.lit(1)).cast("bigint").alias("num_domains"))


def forgetting_curve(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """A14 running form: best score so far per (run, domain) and the drop from it at each phase."""
    w = Window.partitionBy("run", "domain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(F.max(score_col).over(w), F.lit(0.0))
    return scores.select("run", "step", "domain", F.col(score_col).alias("score"),
                         best.alias("best_so_far"),
                         F.greatest(best - F.col(score_col), F.lit(0.0)).alias("forgetting"))
