"""Evaluation queries (F10-F14, A8-A14) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from corpusfold.plans import fixtures as X
from corpusfold.plans import oracle_classify as OC
from corpusfold.plans.catalog import items_input, register, rounded
from corpusfold.functions.text import sql_exact_match, sql_token_overlap
from corpusfold.operators import evaluate as EV
from corpusfold.session import ship_package


# ----------------------------------------------------------------- evaluation



def _pairs_sql(body: str) -> str:
    return X.with_views(body, pairs=X.PAIRS_SQL)


def _eval_sql(body: str) -> str:
    return X.with_views(body, eval_score=X.EVAL_SCORE_SQL)


def pairs_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir)


@register("pair_metrics", _pairs_sql(
    f"SELECT conv_id, turn, {sql_exact_match('generated_code', 'reference_code')} AS exact_match, "
    f"{sql_token_overlap('generated_code', 'reference_code')} AS similarity FROM pairs"))
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + F11 per (prompt, reference) pair: exact match after strip, token-set Jaccard."""
    return EV.pair_metrics(pairs_input(spark, sf_dir), keep=["conv_id", "turn"])


_COMPILES = f"doc_id % 10 IN ({', '.join(map(str, X.SNIPPET_COMPILES))})"


@register("pair_syntax", f"SELECT doc_id AS item_id, {_COMPILES} OR doc_id % 10 = 0 AS syntax_valid FROM documents")
def pair_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """does each item's code compile as Python (Arrow pandas_udf, compile only). The snippets'
    verdicts are known; a missing code is empty and compiles; document texts get a broken tail."""
    it = X.items(spark, sf_dir)
    ship_package(spark)
    code = F.when(F.col("item_id") % 10 == 7, F.concat("code", F.lit(X.BROKEN_TAIL))).otherwise(F.coalesce("code", F.lit("")))
    return it.select("item_id", EV.syntax_valid(code).alias("syntax_valid"))


@register("batch_eval", _pairs_sql(
    f"SELECT CAST(count(*) AS BIGINT) AS n, round(coalesce(avg({sql_exact_match('generated_code', 'reference_code')}), 0.0), 9) AS exact_match, "
    "round(coalesce(avg(CASE WHEN conv_id % 4 IN (1, 2) THEN 1.0e0 ELSE 0.0e0 END), 0.0), 9) AS exec_pass, "
    f"round(coalesce(avg({sql_token_overlap('generated_code', 'reference_code')}), 0.0), 9) AS similarity FROM pairs"))
def batch_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean exact match, execution pass (syntax) and similarity over all pairs, whole texts."""
    return rounded(EV.batch_evaluate(EV.pair_metrics(pairs_input(spark, sf_dir), with_syntax=True)), "exact_match", "exec_pass", "similarity")


_SPECIALTY_PAIRS = f"""
sp AS ({OC.specialty_sql(R.CANONICAL_SPECIALTIES, src='pitems')}),
  j AS (SELECT sp.domain, p.* FROM sp JOIN pitems p USING (item_id))"""


def _pitems_sql(body: str) -> str:
    return X.with_views(_SPECIALTY_PAIRS + body, pairs=X.PAIRS_SQL, pitems="SELECT *, conv_id * 1000 + turn AS item_id FROM pairs")


def specialty_pairs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Pairs split by prompt keywords."""
    p = pairs_input(spark, sf_dir).withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn"))
    return C.split_by_specialty(p, R.CANONICAL_SPECIALTIES, keep=["item_id", "reference_code", *keep])


@register("domain_eval", _pitems_sql(f""",
  d AS (SELECT domain, CAST(count(*) AS BIGINT) AS n, avg({sql_exact_match('generated_code', 'reference_code')}) AS exact_match,
        avg(CASE WHEN conv_id % 4 IN (1, 2) THEN 1.0e0 ELSE 0.0e0 END) AS exec_pass,
        avg({sql_token_overlap('generated_code', 'reference_code')}) AS similarity FROM j GROUP BY domain),
  m AS (SELECT *, avg(exact_match) OVER () AS macro_exact_match, avg(exec_pass) OVER () AS macro_exec_pass FROM d)
SELECT domain, n, round(exact_match, 9) AS exact_match, round(exec_pass, 9) AS exec_pass, round(similarity, 9) AS similarity,
       round(macro_exact_match, 9) AS macro_exact_match, round(macro_exec_pass, 9) AS macro_exec_pass,
       round((macro_exact_match + macro_exec_pass) / 2, 9) AS quality FROM m"""))
def domain_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair per specialty, whole texts, exact match, syntax pass and similarity, macro means and quality."""
    return rounded(EV.domain_eval(specialty_pairs(spark, sf_dir, "generated_code"), with_syntax=True), "exact_match", "exec_pass",
                   "similarity", "macro_exact_match", "macro_exec_pass", "quality")


HEAD_K = 3


@register("head_eval", f"""
WITH h AS (SELECT lang AS domain, doc_id, text FROM
           (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) x
           WHERE rn <= {HEAD_K}),
     s AS (SELECT domain, {sql_exact_match('substring(text, 1, 50)', 'text')} AS exact_match,
                  {sql_token_overlap('substring(text, 1, 50)', 'text')} AS similarity FROM h),
     p AS (SELECT domain, CAST(count(*) AS BIGINT) AS n, coalesce(avg(exact_match), 0.0) AS exact_match,
                  coalesce(avg(similarity), 0.0) AS similarity FROM s GROUP BY domain)
SELECT domain, n, round(exact_match, 9) AS exact_match, round(similarity, 9) AS similarity,
       round(avg(exact_match) OVER (), 9) AS macro_exact_match FROM p""")
def head_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + F13: first 3 documents per language scored with their own 50-character prefix; macro mean."""
    docs = X.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("domain"), F.col("doc_id").alias("item_id"), F.col("text").alias("reference_code"))
    return rounded(EV.head_eval(docs, k=HEAD_K, length=50), "exact_match", "similarity", "macro_exact_match")


ROUND_K = 5


@register("round_eval", _pitems_sql(f""",
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS rn FROM j) x WHERE rn <= {ROUND_K}),
  d AS (SELECT domain, CAST(count(*) AS BIGINT) AS n, avg({sql_exact_match("(substring(reference_code, 1, 50) || '...')", 'reference_code')}) AS exact_match,
        avg({sql_token_overlap("(substring(reference_code, 1, 50) || '...')", 'reference_code')}) AS similarity FROM h GROUP BY domain),
  m AS (SELECT *, avg(exact_match) OVER () AS macro_exact_match FROM d)
SELECT domain, n, round(exact_match, 9) AS exact_match, 0.0e0 AS exec_pass, round(similarity, 9) AS similarity,
       round(macro_exact_match, 9) AS macro_exact_match, 0.0e0 AS macro_exec_pass, round(macro_exact_match / 2, 9) AS quality FROM m"""))
def round_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 round form, as defined: the first 5 pairs per specialty, candidate = 50-character prefix + '...'
    (prose cut so never compiles), exact match and syntax pass, quality = their mean."""
    return rounded(EV.head_eval(specialty_pairs(spark, sf_dir), k=ROUND_K, length=50, suffix="...", with_syntax=True), "exact_match",
                   "exec_pass", "similarity", "macro_exact_match", "macro_exec_pass", "quality")


RUN_A, RUN_B = "rehearsal", "naive"


@register("run_compare", _eval_sql(f"""
q AS (SELECT run, step, avg(score) AS quality FROM eval_score WHERE run IN ('{RUN_A}', '{RUN_B}') GROUP BY run, step),
  r AS (SELECT run, avg(quality) AS avg_q, arg_max(quality, step) AS final_q FROM q GROUP BY run),
  w AS (SELECT max(CASE WHEN run = '{RUN_A}' THEN avg_q END) AS a_avg_quality,
               max(CASE WHEN run = '{RUN_B}' THEN avg_q END) AS b_avg_quality,
               max(CASE WHEN run = '{RUN_A}' THEN final_q END) AS a_final_quality,
               max(CASE WHEN run = '{RUN_B}' THEN final_q END) AS b_final_quality FROM r)
SELECT '{RUN_A}' AS run_a, '{RUN_B}' AS run_b, round(a_avg_quality, 9) AS a_avg_quality,
       round(b_avg_quality, 9) AS b_avg_quality,
       round((a_avg_quality - b_avg_quality) / (b_avg_quality + 1e-6) * 100.0, 9) AS improvement_percent,
       round(a_final_quality, 9) AS a_final_quality, round(b_final_quality, 9) AS b_final_quality
FROM w WHERE a_avg_quality IS NOT NULL AND b_avg_quality IS NOT NULL"""))
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and final quality of two runs and the relative improvement."""
    return rounded(EV.run_compare(X.eval_score(spark, sf_dir), RUN_A, RUN_B), "a_avg_quality", "b_avg_quality",
                   "improvement_percent", "a_final_quality", "b_final_quality")


@register("setting_rank", _eval_sql("""
l AS (SELECT run, max(step) AS last FROM eval_score GROUP BY run),
  o AS (SELECT e.run, avg(score) AS overall_quality, CAST(count(*) AS BIGINT) AS num_domains
        FROM eval_score e JOIN l ON e.run = l.run AND e.step = l.last GROUP BY e.run)
SELECT CAST(row_number() OVER (ORDER BY overall_quality DESC, run) AS BIGINT) AS rank, run AS setting,
       round(overall_quality, 9) AS overall_quality, num_domains FROM o"""))
def setting_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 (+ D2 grid form): settings ranked by overall quality at their last step, stable."""
    return rounded(EV.setting_rank(X.eval_score(spark, sf_dir)), "overall_quality")


@register("forgetting", _eval_sql("""
l AS (SELECT run, max(step) AS last FROM eval_score GROUP BY run),
  d AS (SELECT e.run, e.domain, greatest(max(score), 0.0) AS best,
               coalesce(max(CASE WHEN step = last THEN score END), 0.0) AS last_score,
               max(CASE WHEN step = last THEN 1 ELSE 0 END) AS in_last
        FROM eval_score e JOIN l USING (run) GROUP BY e.run, e.domain)
SELECT run, round(avg(greatest(best - last_score, 0.0)), 9) AS avg_forgetting,
       round(avg(CASE WHEN in_last = 1 THEN last_score END), 9) AS final_overall, CAST(count(*) AS BIGINT) AS num_domains
FROM d GROUP BY run"""))
def forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average forgetting per run and final overall quality."""
    return rounded(EV.forgetting(X.eval_score(spark, sf_dir)), "avg_forgetting", "final_overall")


@register("forgetting_curve", _eval_sql("""
SELECT run, step, domain, score,
       greatest(max(score) OVER w, 0.0) AS best_so_far,
       greatest(greatest(max(score) OVER w, 0.0) - score, 0.0) AS forgetting
FROM eval_score
WINDOW w AS (PARTITION BY run, domain ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def forgetting_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 running form: best-so-far and drop per (run, phase, domain)."""
    return EV.forgetting_curve(X.eval_score(spark, sf_dir))


