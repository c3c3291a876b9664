"""Routing on real documents against a direct Python statement of the rules (``re`` / ``str``).

The DuckDB oracle shares the regex translation with the Spark side; this test does not: it
evaluates the rule tables with Python's own ``re`` on whole texts, which is the specification.
"""
import re

import pytest

from given_tables import SF001
from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from corpusfold.plans import fixtures as X

DOMAINS = list(R.TEST_DOMAINS)
ANY_CASE, LINES = re.IGNORECASE, re.MULTILINE


def weight(text, flags, weighted):
    """Sum of the weights of the patterns found in ``text``."""
    return sum(w for w, p in weighted if re.search(p, text, flags))


def evidence(row, domains):
    """Every result a stage could give: (stage, position that breaks ties, score, domain, reason)."""
    prompt, code, lib = (getattr(row, f) or "" for f in ("prompt", "code", "library"))
    fold = lambda x: x.strip().lower()
    found = []
    for d, names in R.LIBRARY_MAPPING.items():
        if fold(lib) in names:
            found.append((1, len(found), 1.0, d, f"Library: {fold(lib)}"))
    for at, d in enumerate(domains):
        rules = [(R.PATTERN_WEIGHTS[tier], p) for tier, ps in R.DOMAIN_PATTERNS.get(d, {}).items() for p in ps]
        score = min(weight(f"{prompt}\n{code}", ANY_CASE | LINES, rules) / R.PATTERN_CAP, 1.0)
        if score > R.PATTERN_EMIT_ABOVE:
            found.append((2, at, score, d, f"Advanced patterns (confidence: {score:.2f})"))
        words = R.KEYWORDS.get(d, {"keywords": [], "patterns": []})
        text = f"{fold(prompt)} {fold(code)}"
        raw = sum(k in text for k in words["keywords"]) + weight(text, ANY_CASE, [(2.0, p) for p in words["patterns"]])
        if raw:
            found.append((4, at, min(raw / R.KEYWORD_CAP, 1.0), d, f"Keywords (score: {raw:.1f})"))
    structures = {"sql": (R.SQL_STRUCTURE, ANY_CASE | LINES), "python": (R.PYTHON_STRUCTURE, LINES), "javascript": (R.JAVASCRIPT_STRUCTURE, LINES)}
    for at, (d, score, reason) in enumerate(R.STRUCTURE_RESULTS):
        patterns, flags = structures[d]
        if weight(fold(code), flags, [(1, p) for p in patterns]):
            found.append((3, at, score, d, reason))
    if len(code) > R.COMPLEXITY_MIN_CHARS and code.count("\n") >= R.COMPLEXITY_MIN_LINES:
        found.append((5, 0, R.COMPLEXITY_RESULT[1], R.COMPLEXITY_RESULT[0], R.COMPLEXITY_RESULT[2]))
    return [f for f in found if f[3] in domains]


def of_stage(found, stage):
    """A stage's result: structure and library go by order alone, the others by score first."""
    own = [f for f in found if f[0] == stage]
    by_order = stage in (1, 3)
    return min(own, key=lambda f: (0 if by_order else -f[2], f[1]), default=None)


def of_chain(found, default):
    """The highest score of the stages up to the first sure one; the earliest stage of equals."""
    results = [r for r in (of_stage(found, k) for k in range(1, 6)) if r]
    sure = min((r[0] for r in results if r[2] >= R.CHAIN_STOP_AT), default=5)
    best = min((r for r in results if r[0] <= sure), key=lambda r: (-r[2], r[0]), default=None)
    return best[3:] if best and best[2] >= R.CHAIN_ACCEPT_AT else (default, R.CHAIN_FALLBACK_REASON)


@pytest.fixture(scope="module")
def items(spark):
    import os
    return X.items(spark, os.environ.get("CORPUSFOLD_PARITY_SF", SF001))


@pytest.fixture(scope="module")
def rows(items):
    return {r.item_id: r for r in items.collect()}


@pytest.mark.parametrize("number,stage", [(2, C.PATTERNS), (3, C.STRUCTURE), (4, C.KEYWORDS)])
def test_stage_parity(items, rows, number, stage):
    got = {r.item_id: r for r in C.classify_stage(items, stage, DOMAINS).collect()}
    assert len(got) == len(rows) > 50
    for i, r in rows.items():
        want = of_stage(evidence(r, DOMAINS), number)
        g = got[i]
        assert (g.domain, g.reason) == (want[3:] if want else (None, None)), (i, g, want)
        assert want is None or g.score == pytest.approx(want[2])


def test_chain_parity(items, rows):
    got = {r.item_id: (r.domain, r.reason) for r in C.classify_chain(items, DOMAINS, "python").collect()}
    for i, r in rows.items():
        assert got[i] == of_chain(evidence(r, DOMAINS), "python"), i


def import_result(row, allowed, default):
    """The library's buckets decide if one is allowed; else the allowed bucket that most patterns name, the first named of equals."""
    name = (row.library or "").strip().lower()
    name = R.LIBRARY_SYNONYMS.get(name, name)
    known = [b for b in R.LIBRARY_BUCKETS.get(name, []) if b in allowed]
    if known:
        return known[0], f"metadata.library:{name}->{known[0]}"
    text = f"{row.code or ''}\n{row.prompt or ''}"
    named = [b for bucket, p, lines in R.IMPORT_PATTERNS if re.search(p, text, ANY_CASE | (LINES if lines else 0))
             for b in R.LIBRARY_BUCKETS.get(bucket, [bucket])]
    votes = {b: named.count(b) for b in named if b in allowed}
    if votes:
        first = max(votes, key=lambda b: (votes[b], -named.index(b)))
        return first, f"pattern:{first}"
    return (default if default in allowed else allowed[0]), R.IMPORT_FALLBACK_REASON


def test_import_chain_parity(items, rows):
    doms = [*R.SPLIT_DOMAINS, "misc", "python"]
    got = {r.item_id: (r.domain, r.reason) for r in C.classify_imports(items, doms, "py_core").collect()}
    for i, r in rows.items():
        assert got[i] == import_result(r, doms, "py_core"), i
