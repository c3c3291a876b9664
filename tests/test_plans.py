"""Plan-shape checks: the physical plans the design relies on."""
import pytest

import __spark_entry__ as E
from given_tables import SF001


def _plan(spark, df, executed=False):
    if executed:
        df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_routing_reads_two_columns_and_fuses_into_one_codegen_stage(spark):
    df = E.queries()["chain_route"](spark, SF001)
    plan = _plan(spark, df, executed=True)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Join" not in plan and "HashAggregate" not in plan
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("* Project") >= 5          # the stage projections, all under whole-stage codegen


def test_registry_is_pushed_into_the_scan(spark):
    from corpusfold.operators import updates as U
    from corpusfold.plans.queries_updates import REGISTERED
    log = spark.read.parquet(f"{SF001}/events.parquet").selectExpr("event_type AS expert", "event_id AS seq", "value AS delta")
    plan = _plan(spark, U.accepted(log, REGISTERED))
    pushed = [l for l in plan.splitlines() if l.startswith("PushedFilters:")]
    assert any("In(event_type, [click,purchase,refund,signup,view])" in l for l in pushed), pushed


@pytest.mark.parametrize("name", ["head_eval", "domain_top_libraries"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    plan = _plan(spark, E.queries()[name](spark, SF001), executed=True)
    assert "WindowGroupLimit" in plan and "Partial" in plan


NON_IO = ["library_route", "pattern_route", "chain_route", "import_route", "prompt_split", "domain_distribution",
          "reason_top", "domain_text_stats", "domain_top_libraries", "balance_summary", "balance_suggestions",
          "pair_metrics", "head_eval", "run_compare", "setting_rank", "forgetting", "forgetting_curve",
          "expert_fold", "global_fold", "vector_fold", "global_vector_fold", "batch_combine",
          "combine_contributions", "keyed_fold", "state_diff", "state_apply", "version_curve",
          "staleness_profile", "federated_vs_isolated", "round_metrics", "batch_sample", "supervised_text",
          "expert_sets", "rehearsal_mix"]


@pytest.mark.parametrize("name", NON_IO)
def test_no_cartesian_products(spark, name):
    plan = _plan(spark, E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ("rehearsal_mix",)   # D3's phase < phase
