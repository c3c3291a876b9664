"""Stand-in inputs built from the driver's test tables (FIXTURES.md section 3).

Each view only reshapes test rows into the schema an operator expects
(``items``, ``pairs``, ``pushes``, ``vector_pushes``, ``eval_score``); none
does any of the operators' work. Every builder has a DuckDB SQL twin used by
the oracle queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators.sequence import running_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- items (3.1)

# Own snippets with known Python verdicts (see SNIPPET_COMPILES); branch 7 is the document's text.
_CODE_BRANCHES = {
    1: "import numpy as np\nvalues = np.arange(12)\nprint(values.sum())",
    2: "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_name;",
    3: "const total = parts.map((part) => part.size).length;\nconsole.log(total);",
    4: "public class Tally {\n  private int hits = 0;\n  public void hit() { hits++; System.out.println(hits); }\n}",
    5: "#include <iostream>\nint main() { std::cout << 1 << std::endl; return 0; }",
    6: "#!/bin/sh\nif [ -f notes.txt ]; then\n  grep -c done notes.txt\nfi",
    8: "total = total + step\n" * 40,
    9: "def g(b):\n    if b >",
}
SNIPPET_COMPILES = (1, 8)           # of the snippets, as Python
BROKEN_TAIL = "\n) ("               # no text that ends so compiles as Python
_LIBRARY_BRANCHES = {0: "pandas", 1: " NumPy ", 2: "mysql", 3: "cobol"}


def _sql_text(text: str) -> str:
    """A DuckDB string expression for ``text``."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k10 = F.col("doc_id") % 10
    k7 = F.col("doc_id") % 7
    code = None
    for k in range(10):
        val = F.col("text") if k == 7 else (F.lit(_CODE_BRANCHES[k]) if k in _CODE_BRANCHES else None)
        if val is None:
            continue
        code = F.when(k10 == k, val) if code is None else code.when(k10 == k, val)
    lib = None
    for k, v in _LIBRARY_BRANCHES.items():
        lib = F.when(k7 == k, F.lit(v)) if lib is None else lib.when(k7 == k, F.lit(v))
    return d.select(F.col("doc_id").alias("item_id"), F.col("text").alias("prompt"), "lang", "source",
                    code.alias("code"), lib.alias("library"))


ITEMS_SQL = (
    "SELECT doc_id AS item_id, text AS prompt, lang, source, CASE doc_id % 10 "
    + " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in _CODE_BRANCHES.items())
    + " WHEN 7 THEN text ELSE NULL END AS code, CASE doc_id % 7 "
    + " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in _LIBRARY_BRANCHES.items())
    + " ELSE NULL END AS library FROM documents")


# ---------------------------------------------------------------- pairs (3.2)

# Candidates by conv_id % 4: the reference with a broken tail, two snippets that compile, and the
# reference itself (whose text then has the broken tail too). All texts are whole.

def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    k = F.col("conv_id") % 4
    broken = F.concat("answer", F.lit(BROKEN_TAIL))
    # Equi-join on both keys: a long conversation goes to many tasks.
    return (u.join(a, on=["conv_id", "turn"], how="inner")
            .select("conv_id", "turn", "prompt", F.when(k == 3, broken).otherwise(F.col("answer")).alias("reference_code"),
                    F.when(k == 1, _CODE_BRANCHES[1]).when(k == 2, _CODE_BRANCHES[8]).otherwise(broken).alias("generated_code")))


PAIRS_SQL = f"""
SELECT u.conv_id, u.turn, u.text AS prompt,
       CASE u.conv_id % 4 WHEN 3 THEN a.text || {_sql_text(BROKEN_TAIL)} ELSE a.text END AS reference_code,
       CASE u.conv_id % 4 WHEN 1 THEN {_sql_text(_CODE_BRANCHES[1])} WHEN 2 THEN {_sql_text(_CODE_BRANCHES[8])}
            ELSE a.text || {_sql_text(BROKEN_TAIL)} END AS generated_code
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""


# ------------------------------------------------------- pushes (3.3, scalar)

def pushes(spark: SparkSession, sf_dir: str, run_by_worker: bool = False) -> DataFrame:
    """Scalar update log from ``events``; ``cur`` is the version the push will meet."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("expert"), F.col("event_id").alias("seq"),
        F.col("user_id").alias("worker"), F.col("value").alias("delta"), "ts")
    keys = ["expert"]
    if run_by_worker:
        e = e.withColumn("run", F.when(F.col("worker") % 2 == 0, F.lit("federated")).otherwise(F.lit("isolated")))
        keys = ["run", "expert"]
    e = running_rank(e, keys, "seq", out="_pos").withColumn("cur", F.col("_pos") - 1).drop("_pos")
    return e.withColumn("worker_version", F.col("cur") - F.least(F.col("cur"), F.col("seq") % 4))


def pushes_sql(run_by_worker: bool = False) -> str:
    if run_by_worker:
        inner = ("SELECT *, CAST(row_number() OVER (PARTITION BY run, event_type ORDER BY event_id) - 1 AS BIGINT) AS cur "
                 "FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'federated' ELSE 'isolated' END AS run FROM events) x")
        run_col = "run, "
    else:
        inner = ("SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS cur "
                 "FROM events")
        run_col = ""
    return (f"SELECT {run_col}event_type AS expert, event_id AS seq, user_id AS worker, value AS delta, ts, cur, "
            f"cur - least(cur, event_id % 4) AS worker_version FROM ({inner}) e")


# ----------------------------------------------- vector_pushes (3.3, vectors)

def vector_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("expert"), F.col("vec_id").alias("seq"),
        F.transform("embedding", lambda x: x.cast("double")).alias("delta"))
    # Rank the narrow (expert, seq) pairs only; vectors join back afterwards.
    pos = running_rank(v.select("expert", "seq"), ["expert"], "seq", out="_pos")
    v = v.join(pos, ["expert", "seq"]).withColumn("cur", F.col("_pos") - 1).drop("_pos")
    return v.withColumn("worker_version", F.col("cur") - F.least(F.col("cur"), F.col("seq") % 4))


VECTOR_PUSHES_SQL = """
SELECT CAST(label AS VARCHAR) AS expert, vec_id AS seq,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS delta, cur,
       cur - least(cur, vec_id % 4) AS worker_version
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS cur FROM embeddings) v
"""


# -------------------------------------------------------------- eval_score (3.4)

def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (run, step, domain) scores that vary by step and domain.

    ``score`` (exact-match stand-in) is the mean quality label, ``exec_pass`` the
    mean of ``1 - toxic``.
    """
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    j = l.join(d, "doc_id")
    return (j.groupBy(F.when(F.col("doc_id") % 2 == 0, F.lit("naive")).otherwise(F.lit("rehearsal")).alias("run"),
                      (F.col("doc_id") % 5 + 1).cast("bigint").alias("step"),
                      F.col("lang").alias("domain"))
            .agg(F.avg(F.col("quality").cast("double")).alias("score"),
                 F.avg((F.lit(1) - F.col("toxic")).cast("double")).alias("exec_pass")))


EVAL_SCORE_SQL = """
SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'naive' ELSE 'rehearsal' END AS run,
       CAST(d.doc_id % 5 + 1 AS BIGINT) AS step, d.lang AS domain,
       avg(CAST(l.quality AS DOUBLE)) AS score,
       avg(CAST(1 - l.toxic AS DOUBLE)) AS exec_pass
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
GROUP BY 1, 2, 3
"""


def with_views(sql: str, **views: str) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each fixture view (merging a leading WITH)."""
    if not views:
        return sql
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in views.items())
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    if re.match(r"^\w+ AS \(", body):      # body continues the CTE list
        return f"WITH {ctes},\n{body}"
    return f"WITH {ctes}\n{body}"
