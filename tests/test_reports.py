"""A1-A7 on a small routed table, against values worked out by hand."""
import pytest

from corpusfold.operators import report as A

# domain, reason, prompt, code, library
ROUTED = [
    ("shell", "r2", "aa", "x\ny\nz", " Bash"), ("docs", "r1", "", None, None), ("shell", "r1", "aaaa", "", "bash "),
    ("cpp", "r3", "a", "one line", "Boost"), ("shell", "r1", "", "x\n", "zsh"), ("docs", "r3", "aaa", "q", ""),
    ("shell", "r4", "aa", None, None),
]


@pytest.fixture()
def classified(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROUTED)],
                                 "item_id long, domain string, reason string, prompt string, code string, library string")


def test_counts(classified):
    assert {r.domain: r.cnt for r in A.domain_counts(classified).collect()} == {"shell": 4, "docs": 2, "cpp": 1}


def test_distribution_keeps_configured_zeros(classified):
    rows = {r.domain: r for r in A.domain_distribution(classified, ["cpp", "docs", "go", "shell"]).collect()}
    assert (rows["go"].cnt, rows["go"].pct, rows["go"].total) == (0, 0.0, 7)
    assert rows["shell"].pct == pytest.approx(400 / 7)


def test_top_reasons_break_ties_by_first_place(classified):
    top = [(r.reason, r.cnt) for r in A.reason_top(classified, k=3).orderBy("rank").collect()]
    assert top == [("r1", 3), ("r3", 2), ("r2", 1)]


def test_text_stats(classified):
    st = {r.domain: r for r in A.domain_text_stats(classified).collect()}
    assert st["shell"].avg_prompt_len == pytest.approx(8 / 4) and st["shell"].avg_code_len == pytest.approx(7 / 4)
    assert st["shell"].avg_lines == pytest.approx((3 + 0 + 2 + 0) / 4)      # an empty or missing code has no line
    assert st["cpp"].avg_lines == 1.0


def test_top_libraries_are_normalised(classified):
    libs = {(r.domain, r.rank): (r.lib, r.cnt) for r in A.domain_top_libraries(classified).collect()}
    assert libs == {("shell", 1): ("bash", 2), ("shell", 2): ("zsh", 1), ("cpp", 1): ("boost", 1)}


def test_balance(classified):
    b = A.balance_summary(classified).collect()[0]
    assert (b.total_items, b.num_domains, b.min_count, b.max_count, b.is_balanced) == (7, 3, 1, 4, False)
    assert b.imbalance_ratio == 4.0 and b.avg_per_domain == pytest.approx(7 / 3)
    # mean 7/3: 1 < 1.17 and 4 > 3.5
    assert {r.domain: r.status for r in A.balance_suggestions(classified).collect()} == {"cpp": "underrepresented", "shell": "overrepresented"}


def test_balance_suggestion_thresholds_are_strict(spark):
    df = spark.createDataFrame([(i, d, "r") for i, d in enumerate(["a"] * 6 + ["b"] * 2 + ["c"] * 1)],
                               "item_id long, domain string, reason string")
    sug = {r.domain: r.status for r in A.balance_suggestions(df).collect()}
    assert sug == {"a": "overrepresented", "c": "underrepresented"}   # mean 3: 6 > 4.5, 1 < 1.5, 2 not < 1.5
