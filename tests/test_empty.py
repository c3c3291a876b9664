"""Empty inputs: every operator returns its defined empty / zero result instead of failing."""
from corpusfold.operators import classify as C
from corpusfold.operators import evaluate as EV
from corpusfold.operators import report as A
from corpusfold.operators import updates as U


def test_empty_routing_and_reports(spark):
    items = spark.createDataFrame([], "item_id long, prompt string, code string, library string")
    routed = C.classify_chain(items, ["python", "sql"], "python", keep=None)
    assert routed.count() == 0
    dist = {r.domain: (r.cnt, r.pct, r.total) for r in A.domain_distribution(routed, ["python", "sql"]).collect()}
    assert dist == {"python": (0, 0.0, 0), "sql": (0, 0.0, 0)}
    assert A.balance_summary(routed).count() == 0 and A.balance_suggestions(routed).count() == 0
    assert A.reason_top(routed).count() == 0 and A.domain_top_libraries(routed).count() == 0
    assert C.classify_imports(items, ["sql"], "sql").count() == 0
    assert C.split_by_specialty(items, ["sql"]).count() == 0


def test_empty_evaluation_and_folds(spark):
    pairs = spark.createDataFrame([], "generated_code string, reference_code string")
    agg = EV.batch_evaluate(EV.pair_metrics(pairs, with_syntax=True)).collect()[0]
    assert (agg.n, agg.exact_match, agg.exec_pass, agg.similarity) == (0, 0.0, 0.0, 0.0)
    log = spark.createDataFrame([], "expert string, seq long, worker_version long, delta double")
    states = {r.expert: (r.version, r.state) for r in U.expert_states(["a"], log).collect()}
    assert states == {"a": (0, 0.0)}
    g = U.global_scalar(log).collect()[0]
    assert (g.global_version, g.global_state) == (0, 0.0)
    vlog = spark.createDataFrame([], "expert string, seq long, worker_version long, delta array<double>")
    assert U.fold_vectors(vlog).count() == 0 and U.global_vectors(vlog).count() == 0
    batches = spark.createDataFrame([], "batch long, expert string, delta array<double>")
    st, contrib = U.batch_combine(batches, 4)
    assert st.count() == 0 and contrib.count() == 0
    scores = spark.createDataFrame([], "run string, step long, domain string, score double")
    assert EV.run_compare(scores, "a", "b").count() == 0 and EV.forgetting(scores).count() == 0
