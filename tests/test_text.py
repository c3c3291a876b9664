"""F1, F9-F11, F13, F14 and the regex dialect against Python str / re semantics."""
import re

import pytest
from pyspark.sql import functions as F

from given_tables import SF001
from corpusfold.functions import text as T
from corpusfold.functions.regex import java_regex, required_literals

PROBES = ["  abc  ", " x　", "\x1cy\x1f", " z ", "\x85w\x85", "\t\n\x0b\x0c\r", "", "a b c",
          "ſelect", "import été", "fromé", "İmport x", "​q"]


def _pairs(spark, rows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, g string, r string")


def test_strip_and_tokens_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(PROBES)], "i int, s string")
    got = {r.i: (r.st, list(r.tk)) for r in df.select("i", T.py_strip("s").alias("st"), T.tokens("s").alias("tk")).collect()}
    for i, s in enumerate(PROBES):
        assert got[i] == (s.strip(), s.split()), repr(s)


def test_norm_null_is_empty(spark):
    df = spark.createDataFrame([(None,), ("  MiXed ",)], "s string")
    assert [r[0] for r in df.select(T.norm("s")).collect()] == ["", "mixed"]


def _py_overlap(g, r):
    gs, rs = set(g.split()), set(r.split())
    return len(gs & rs) / len(gs | rs) if rs else 0.0


def test_exact_and_overlap_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    sub = docs.withColumn("g", F.substring("text", 1, 50))
    rows = sub.select("doc_id", "text", "g", T.exact_match("g", "text").alias("em"),
                      T.token_overlap("g", "text").alias("ov")).collect()
    assert len(rows) > 100
    for r in rows:
        assert r.em == (1.0 if r.g.strip() == r.text.strip() else 0.0)
        assert r.ov == pytest.approx(_py_overlap(r.g, r.text), abs=1e-12)


def test_line_count_prefix_supervised(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("x" * 60,)], "s string")
    out = df.select(T.line_count("s").alias("n"), T.prefix("s", 50, "...").alias("p"),
                    T.supervised_text(F.lit("  q "), "s").alias("t")).collect()
    assert [r.n for r in out] == [3, 1, 1]
    assert out[2].p == "x" * 50 + "..."
    assert out[0].t == "Problem:\nq\n\nAnswer:\na\nb\n"


REGEX_CASES = [
    (r"import\s+\w+", True, False), (r"\.py\b", True, False), (r"^\s*SELECT\s+", True, True),
    (r"\bDataFrame\b", True, False), (r"from\s+\w+\s+import", True, True), (r"\$\{?\w+\}?", True, True),
    (r"\b(import|from)\s+pandas\b", True, False), (r"SELECT\s+.*\s+FROM", True, True),
]
TEXTS = ["import été", "x.py", "x.pyc", "a\n  select 1", "\u0085select 2", "fromé pandas", "df = DataFrame()",
         "from os import path", "echo ${HOME}", "import pandas", "ſelect a from b", "Select x FROM y",
         "\x1cimport x", "DataFrames"]


def _py_flags(i, m):
    return (re.IGNORECASE if i else 0) | (re.MULTILINE if m else 0)


@pytest.mark.parametrize("pattern,icase,ml", REGEX_CASES)
def test_java_regex_matches_python_re(spark, pattern, icase, ml):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", F.col("t").rlike(java_regex(pattern, icase, ml)).alias("m")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == bool(re.search(pattern, t, _py_flags(icase, ml))), (pattern, t)


@pytest.mark.parametrize("pattern,icase,ml", REGEX_CASES)
def test_literal_guard_is_necessary(pattern, icase, ml):
    alts = required_literals(pattern)
    for t in TEXTS:
        if re.search(pattern, t, _py_flags(icase, ml)) and alts:
            folded = t.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")
            assert any(all(lit in folded for lit in runs) for runs in alts), (pattern, t)


@pytest.mark.parametrize("pattern,icase,ml", [c for c in REGEX_CASES if c[1]])
def test_folded_pattern_equals_case_insensitive(spark, pattern, icase, ml):
    from corpusfold.operators.classify import fold
    from corpusfold.functions.regex import java_regex_folded
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = df.select("i", F.col("t").rlike(java_regex(pattern, True, ml)).alias("a"),
                    fold(F.col("t")).rlike(java_regex_folded(pattern, ml)).alias("b")).collect()
    assert all(r.a == r.b for r in got), pattern
