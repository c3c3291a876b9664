"""Per-row text expressions (F1-F4, F9-F11, F13, F14) as JVM-side Column builders.

All of these compile into whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfold.functions.regex import WS

# Characters Python's ``str.strip()`` / ``str.split()`` treat as whitespace,
# derived from Python's own definition (``str.isspace``).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def col_or_empty(c: Column | str) -> Column:
    """Absent and null fields both read as ``""``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(col_or_empty(c), F.lit(PY_WHITESPACE))


def norm(c: Column | str) -> Column:
    """F1 ``norm``: null -> '', strip, lower-case."""
    return F.lower(py_strip(c))


def line_count(c: Column | str) -> Column:
    """pieces of ``split('\\n')`` (one more than the number of newlines)."""
    s = col_or_empty(c)
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + F.lit(1)


def tokens(c: Column | str) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empty strings."""
    return F.filter(F.split(col_or_empty(c), WS + "+"), lambda t: t != F.lit(""))


def exact_match(generated: Column | str, reference: Column | str) -> Column:
    """1.0 when both sides are equal after strip, else 0.0."""
    return F.when(py_strip(generated) == py_strip(reference), F.lit(1.0)).otherwise(F.lit(0.0))


def token_overlap(generated: Column | str, reference: Column | str) -> Column:
    """Jaccard similarity of whitespace-token sets; 0.0 if the reference has no tokens."""
    g = tokens(generated)
    r = tokens(reference)
    inter = F.size(F.array_intersect(g, r)).cast("double")
    union = F.size(F.array_union(g, r)).cast("double")
    return F.when(F.size(r) > 0, inter / union).otherwise(F.lit(0.0))


def prefix(c: Column | str, n: int = 50, suffix: str = "") -> Column:
    """the first ``n`` code points, optionally followed by ``suffix``."""
    head = F.substring(col_or_empty(c), 1, n)
    return F.concat(head, F.lit(suffix)) if suffix else head


def supervised_text(prompt: Column | str, reference: Column | str) -> Column:
    """``Problem:\\n{prompt}\\n\\nAnswer:\\n{reference}\\n`` with both sides stripped."""
    return F.concat(
        F.lit("Problem:\n"), py_strip(prompt),
        F.lit("\n\nAnswer:\n"), py_strip(reference), F.lit("\n"),
    )


# ---------------------------------------------------------------- SQL mirrors
# DuckDB spellings of the same expressions, for the oracle queries.

def sql_ws_chars() -> str:
    return "concat(" + ", ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE) + ")"


def sql_strip(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {sql_ws_chars()})"


def sql_norm(expr: str) -> str:
    return f"lower({sql_strip(expr)})"


def sql_tokens(expr: str) -> str:
    from corpusfold.functions.regex import WS as _ws
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{_ws}+'), lambda x: x <> '')"


def sql_token_overlap(gen: str, ref: str) -> str:
    g, r = sql_tokens(gen), sql_tokens(ref)
    inter = f"len(list_distinct(list_intersect({g}, {r})))"
    union = f"len(list_distinct(list_concat({g}, {r})))"
    return f"CASE WHEN len({r}) > 0 THEN CAST({inter} AS DOUBLE) / {union} ELSE 0.0 END"


def sql_exact_match(gen: str, ref: str) -> str:
    return f"CASE WHEN {sql_strip(gen)} = {sql_strip(ref)} THEN 1.0 ELSE 0.0 END"


def sql_line_count(expr: str) -> str:
    e = f"coalesce({expr}, '')"
    return f"(length({e}) - length(replace({e}, chr(10), '')) + 1)"
