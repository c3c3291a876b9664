"""Query catalogue: every operator of the survey as a named Spark query over the
driver's test tables, each with a DuckDB twin where SQL can express it.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Column names and types line up between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from corpusfold.operators import report as A
from corpusfold.plans import fixtures as X
from corpusfold.plans import oracle_classify as OC

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Routing configuration of the named queries.
ROUTE_DOMAINS = list(R.TEST_DOMAINS)          # python, sql, javascript, java, cpp, shell, docs
ROUTE_DEFAULT = "python"
REPORT_DOMAINS = ROUTE_DOMAINS + [R.MISC_DOMAIN]   # S7: catch-all appended
IMPORT_DOMAINS = R.SPLIT_DOMAINS + [R.MISC_DOMAIN]
IMPORT_DEFAULT = R.SPLIT_DEFAULT_DOMAIN


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


DECIMALS = 9   # averages over several doubles: summation order differs between engines


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to ``DECIMALS`` places (the oracle SQL does the same)."""
    return df.withColumns({c: F.round(c, DECIMALS) for c in cols})


def _items_sql(body: str) -> str:
    return X.with_views(body, items=X.ITEMS_SQL)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items routed by the flagship chain, with the fields the reports read.

    A consumer that filters or joins on ``domain`` should write the result first
    (see ``plans/split.py``): a filter that is pushed into the projection would
    run the rules again.
    """
    return C.classify_chain(items_input(spark, sf_dir), ROUTE_DOMAINS, ROUTE_DEFAULT, keep=["item_id", "prompt", "code", "library"])


def items_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in items; the scan's own splits are the tasks."""
    return X.items(spark, sf_dir)


def _routed_sql() -> str:
    return (f"classified AS (SELECT i.*, c.domain, c.reason FROM items i JOIN "
            f"({OC.chain_sql(ROUTE_DOMAINS, ROUTE_DEFAULT)}) c USING (item_id))")


def _report_sql(body: str) -> str:
    return f"WITH items AS ({X.ITEMS_SQL.strip()}), {_routed_sql()}\n{body}"


# ------------------------------------------------------------- classification

for _name, _stage, _idx in [("library_route", C.LIBRARY, 1), ("pattern_route", C.PATTERNS, 2),
                            ("structure_route", C.STRUCTURE, 3), ("keyword_route", C.KEYWORDS, 4),
                            ("complexity_route", C.COMPLEXITY, 5)]:
    def _make(stage=_stage):
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return C.classify_stage(items_input(spark, sf_dir), stage, ROUTE_DOMAINS)
        q.__doc__ = f"C-stage '{stage.name}' alone over items (domain/score/reason, null = no result)."
        return q
    register(_name, _items_sql(OC.single_stage_sql(ROUTE_DOMAINS, _idx)))(_make())


@register("chain_route", _items_sql(OC.chain_sql(ROUTE_DOMAINS, ROUTE_DEFAULT)))
def chain_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 flagship: library > patterns > structure > keywords > complexity, stop at 0.9, accept at 0.3."""
    return C.classify_chain(items_input(spark, sf_dir), ROUTE_DOMAINS, ROUTE_DEFAULT)


@register("custom_chain_route", _items_sql(OC.chain_sql(ROUTE_DOMAINS, ROUTE_DEFAULT, stage_ids=(1, 3))))
def custom_chain_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller-chosen stage list (library, structure) through the same chain logic."""
    return C.classify_chain(items_input(spark, sf_dir), ROUTE_DOMAINS, ROUTE_DEFAULT,
                            stages=[C.LIBRARY, C.STRUCTURE])


@register("import_route", _items_sql(OC.imports_sql(IMPORT_DOMAINS, IMPORT_DEFAULT)))
def import_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 with the splitter's default domains plus misc: library buckets, import patterns, fallback."""
    return C.classify_imports(items_input(spark, sf_dir), IMPORT_DOMAINS, IMPORT_DEFAULT)


@register("prompt_split", _items_sql(OC.specialty_sql(R.CANONICAL_SPECIALTIES)))
def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt keyword split over python/sql/docs, hash fallback."""
    return C.split_by_specialty(items_input(spark, sf_dir), R.CANONICAL_SPECIALTIES)


# -------------------------------------------------------------------- reports

_DOMAIN_LIST_SQL = "(VALUES " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(REPORT_DOMAINS)) + ") AS conf(position, domain)"


@register("domain_distribution", _report_sql(f"""
, counts AS (SELECT domain, count(*) AS cnt FROM classified GROUP BY domain),
  tot AS (SELECT coalesce(sum(cnt), 0) AS total FROM counts)
SELECT CAST(conf.position AS INTEGER) AS position, conf.domain, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt,
       CASE WHEN tot.total > 0 THEN 100.0 * coalesce(c.cnt, 0) / tot.total ELSE 0.0 END AS pct,
       CAST(tot.total AS BIGINT) AS total
FROM {_DOMAIN_LIST_SQL} LEFT JOIN counts c ON c.domain = conf.domain CROSS JOIN tot"""))
def domain_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A3 + S7: counts over the configured domains plus misc, zeros kept, with percentages."""
    return A.domain_distribution(routed(spark, sf_dir), REPORT_DOMAINS)


@register("reason_top", _report_sql("""
, agg AS (SELECT reason, count(*) AS cnt, min(item_id) AS first_seen FROM classified GROUP BY reason)
SELECT CAST(row_number() OVER (ORDER BY cnt DESC, first_seen) AS BIGINT) AS rank, reason, CAST(cnt AS BIGINT) AS cnt
FROM agg ORDER BY cnt DESC, first_seen LIMIT 10"""))
def reason_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: ten most frequent routing reasons, ties in first-seen order."""
    return A.reason_top(routed(spark, sf_dir), k=10)


@register("domain_text_stats", _report_sql("""
SELECT domain, CAST(count(*) AS BIGINT) AS cnt,
       avg(length(coalesce(prompt, ''))) AS avg_prompt_len,
       avg(length(coalesce(code, ''))) AS avg_code_len,
       avg(CASE WHEN coalesce(code, '') = '' THEN 0
                ELSE length(code) - length(replace(code, chr(10), '')) + 1 END) AS avg_lines
FROM classified GROUP BY domain"""))
def domain_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: per-domain mean prompt length, code length and line count."""
    return A.domain_text_stats(routed(spark, sf_dir))


def _top_lib_sql() -> str:
    from corpusfold.functions.text import sql_strip
    return _report_sql(f"""
, libs AS (SELECT domain, lower({sql_strip('library')}) AS lib, item_id FROM classified),
  agg AS (SELECT domain, lib, count(*) AS cnt, min(item_id) AS first_seen FROM libs WHERE lib <> '' GROUP BY domain, lib),
  rk AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cnt DESC, first_seen) AS rank FROM agg)
SELECT domain, CAST(rank AS BIGINT) AS rank, lib, CAST(cnt AS BIGINT) AS cnt FROM rk WHERE rank <= 10""")


@register("domain_top_libraries", _top_lib_sql())
def domain_top_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: per-domain top-10 libraries (normalised, blanks skipped), ties first-seen."""
    return A.domain_top_libraries(routed(spark, sf_dir))


@register("balance_summary", _report_sql("""
, c AS (SELECT domain, count(*) AS cnt FROM classified GROUP BY domain)
SELECT CAST(sum(cnt) AS BIGINT) AS total_items, CAST(count(*) AS BIGINT) AS num_domains,
       sum(cnt) / count(*) AS avg_per_domain, CAST(min(cnt) AS BIGINT) AS min_count,
       CAST(max(cnt) AS BIGINT) AS max_count, max(cnt) / min(cnt) AS imbalance_ratio,
       max(cnt) / min(cnt) < 2.0 AS is_balanced
FROM c HAVING count(*) > 0"""))
def balance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance ratio over observed domains."""
    return A.balance_summary(routed(spark, sf_dir))


@register("balance_suggestions", _report_sql("""
, c AS (SELECT domain, count(*) AS cnt FROM classified GROUP BY domain),
  s AS (SELECT domain, cnt, avg(cnt) OVER () AS mean, sum(cnt) OVER () AS total FROM c),
  t AS (SELECT domain, CAST(cnt AS BIGINT) AS cnt,
               CASE WHEN total > 0 THEN 100.0 * cnt / total ELSE 0.0 END AS pct,
               CASE WHEN cnt < mean * 0.5 THEN 'underrepresented'
                    WHEN cnt > mean * 1.5 THEN 'overrepresented' END AS status FROM s)
SELECT * FROM t WHERE status IS NOT NULL"""))
def balance_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """under/over-represented domains against the mean count."""
    return A.balance_suggestions(routed(spark, sf_dir))


# The other query groups register themselves on import.
from corpusfold.plans import queries_eval, queries_updates, queries_io  # noqa: E402,F401
