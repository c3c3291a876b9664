"""Randomised parity: generated items full of rule tokens, odd whitespace and case variants,
routed by Spark and by the plain-Python scoring of tests/test_parity.py."""
import random
from types import SimpleNamespace

from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from test_parity import evidence, import_result, of_chain, of_stage

TOKENS = ["import", "pandas", "numpy", "from", "select", "SELECT", "FROM", "where", "join", "group", "by",
          "order", "def", "f(x):", "class", "Foo:", "{", "}", "=>", "const", "let", "var", "=", "function",
          "print(", "std::vector", "#include", "<", "#!/bin/bash", "echo", "$HOME", "${x}", "for", "in", "do",
          "public", "static", "void", "main", "private", "String", "new", "Foo(", ".py", ".js", ".java", ".h",
          "@decorator", "lambda", "[x", "__name__", "==", "'__main__'", "readme", "markdown", "np.", "pd.",
          "sklearn", "torch.", "tf.", "DataFrame", "Series", "read_csv(", "groupby", "ſelect", "İmport", "K",
          "été", "naïve", "déf", "\"\"\"doc\"\"\"", "sql", "query", "database", "table", "sh", "json", "used"]
SPACES = [" ", " ", " ", "\n", "\t", " ", " ", "\x1c", "\u0085", "\n  "]


def _text(rnd: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rnd.choice(TOKENS))
        out.append(rnd.choice(SPACES))
    return "".join(out)


def test_random_items_match_python(spark):
    rnd = random.Random(1234)
    libs = [None, "", " Pandas ", "np", "mysql", "torch", "cobol", "sql", "bash", "React"]
    rows = [(i, _text(rnd, rnd.randint(0, 12)), _text(rnd, rnd.randint(0, 25)) if rnd.random() < 0.8 else None,
             rnd.choice(libs)) for i in range(600)]
    df = spark.createDataFrame(rows, "item_id long, prompt string, code string, library string")
    doms = list(R.TEST_DOMAINS)
    got = {r.item_id: (r.domain, r.reason) for r in C.classify_chain(df, doms, "python").collect()}
    pat = {r.item_id: r for r in C.classify_stage(df, C.PATTERNS, doms).collect()}
    kw = {r.item_id: r for r in C.classify_stage(df, C.KEYWORDS, doms).collect()}
    imp_doms = R.SPLIT_DOMAINS + ["misc", "python", "docs"]
    imp = {r.item_id: (r.domain, r.reason) for r in C.classify_imports(df, imp_doms, "py_core").collect()}
    for i, p, c, lib in rows:
        row = SimpleNamespace(prompt=p, code=c, library=lib)
        found = evidence(row, doms)
        assert got[i] == of_chain(found, "python"), row
        for stage, result in ((2, pat[i]), (4, kw[i])):
            want = of_stage(found, stage)
            assert (result.domain, result.reason) == (want[3:] if want else (None, None)), row
        assert imp[i] == import_result(row, imp_doms, "py_core"), row
