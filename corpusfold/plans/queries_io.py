"""Source, sink, preparation and streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from corpusfold.operators import report as A
from corpusfold.plans import fixtures as X
from corpusfold.plans import oracle_classify as OC
from corpusfold.plans.catalog import DECIMALS, REPORT_DOMAINS, ROUTE_DEFAULT, items_input, register
from corpusfold.functions.text import sql_exact_match, sql_strip
from corpusfold.operators import evaluate as EV
from corpusfold.operators.isolate import stage_errors
from corpusfold.operators import prepare as D
from corpusfold.plans.queries_eval import HEAD_K, _pairs_sql, pairs_input
from corpusfold.plans.queries_updates import _IN_REG, REGISTERED, _fold_cte
from corpusfold.session import scratch_path
from corpusfold.sources import jsonl as S
from corpusfold.sources import sinks as SK
from corpusfold.streaming import fold as ST


# ------------------------------------------------------------ sources, sinks


FIRST_N = 100
EXPERT_LANGS = ["en", "fr", "de", "es", "it"]     # 'it' has no dataset: counts 0
MIN_ITEMS = 50


def _item_json() -> F.Column:
    """One item as a JSON object; absent (null) fields are left out."""
    return F.to_json(F.struct(F.col("item_id").alias("problem_id"), "prompt", "code",
                              F.struct(F.col("library").alias("library")).alias("metadata")))


# Planted lines after an item's own line: (modulus, line, kind). kind 'empty_obj' is a valid
# object the splitter keeps, and so are the 'meta' kinds; the others are skipped by the reader.
_PLANTED = [(13, "", "blank"), (17, "{bad", "bad"), (19, "[1,2]", "array"), (23, "{}", "empty_obj"),
            (29, "{'a':1}", "single_quotes"), (31, '{"a":1} junk', "junk"),
            (37, '{"metadata":"x"}', "meta_text"), (41, '{"metadata":[1]}', "meta_array"), (43, '{"metadata":7}', "meta_number")]
_KEPT = "('item', 'empty_obj', 'meta_text', 'meta_array', 'meta_number')"


def _jsonl_lines(it: DataFrame) -> DataFrame:
    """(item_id, sub, line) rows: the item's JSON line, then its planted lines."""
    entries = [F.struct(F.lit(0).alias("sub"), _item_json().alias("line"))]
    for i, (m, line, _k) in enumerate(_PLANTED, start=1):
        entries.append(F.when(F.col("item_id") % m == 0, F.struct(F.lit(i).alias("sub"), F.lit(line).alias("line"))))
    return (it.select("item_id", *[c for c in ("lang",) if c in it.columns],
                      F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            .select("item_id", *[c for c in ("lang",) if c in it.columns], "e.sub", "e.line"))


def _in_files(lines: DataFrame) -> DataFrame:
    """Lines in item order; all of an item in one file, so that none begins with a planted line (``[1,2]`` would make it an array)."""
    return lines.repartitionByRange("item_id").sortWithinPartitions("item_id", "sub")


def write_items_jsonl(spark: SparkSession, sf_dir: str, by_lang: bool = False) -> str:
    """Stand-in corpus file(s) written from ``items`` in item order (range-partitioned, so part
    files and lines inside them follow item order)."""
    out = scratch_path(spark, "items-jsonl")
    lines = _jsonl_lines(X.items(spark, sf_dir))
    if by_lang:
        _in_files(lines).select("lang", "line").write.partitionBy("lang").text(out)
    else:
        _in_files(lines).select("line").write.text(out)
    return out


def _lines_sql() -> str:
    parts = ["SELECT item_id, lang, 0 AS sub, 'item' AS kind FROM items"]
    for i, (m, _line, kind) in enumerate(_PLANTED, start=1):
        parts.append(f"SELECT item_id, lang, {i} AS sub, '{kind}' AS kind FROM items WHERE item_id % {m} = 0")
    return " UNION ALL ".join(parts)


_READ_OUT = ("SELECT CASE WHEN kind = 'item' THEN i.item_id END AS problem_id, "
             "CASE WHEN kind = 'item' THEN i.prompt END AS prompt, CASE WHEN kind = 'item' THEN i.code END AS code, "
             "CASE WHEN kind = 'item' THEN i.library END AS library")


def _read_cols(df: DataFrame) -> DataFrame:
    return df.select(F.get_json_object("raw", "$.problem_id").cast("bigint").alias("problem_id"),
                     "prompt", "code", "library")


@register("jsonl_read", X.with_views(
    f"{_READ_OUT} FROM lines l JOIN items i USING (item_id) WHERE kind IN {_KEPT}",
    items=X.ITEMS_SQL, lines=_lines_sql()))
def jsonl_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S3: lenient JSONL read of a corpus with planted blank, malformed, non-object,
    single-quoted and trailing-junk lines (format detected from the head)."""
    path = write_items_jsonl(spark, sf_dir)
    return _read_cols(S.read_items(spark, path))


@register("first_n", X.with_views(
    f"{_READ_OUT} FROM (SELECT *, row_number() OVER (ORDER BY item_id, sub) AS line_no FROM lines) l "
    f"JOIN items i USING (item_id) WHERE line_no <= {FIRST_N} AND kind IN {_KEPT}",
    items=X.ITEMS_SQL, lines=_lines_sql()))
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items among the first 100 physical lines (bad lines use up the quota)."""
    path = write_items_jsonl(spark, sf_dir)
    return _read_cols(S.read_jsonl(spark, path, sample_size=FIRST_N))


@register("experiment_load", X.with_views(
    f"{_READ_OUT}, kind IN ('item', 'empty_obj', 'meta_text', 'meta_array', 'meta_number') AS is_object FROM lines l "
    f"JOIN items i USING (item_id) WHERE kind IN {_KEPT} OR kind = 'array'",
    items=X.ITEMS_SQL, lines=_lines_sql()))
def experiment_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment loader over all lines: valid lines that are no objects are kept, with null fields."""
    df = S.load_items(spark, write_items_jsonl(spark, sf_dir))
    return df.select(F.get_json_object("raw", "$.problem_id").cast("bigint").alias("problem_id"), "prompt", "code", "library",
                     F.col("raw").startswith("{").alias("is_object"))


# Planted array elements: (modulus, JSON element) - none is an object.
_ARRAY_PLANTED = [(11, "5"), (13, '"{\\"a\\":1}"'), (17, "[1]"), (19, "null")]
ARRAY_CHUNK = 100


def write_items_json_arrays(spark: SparkSession, sf_dir: str) -> str:
    """Stand-in JSON-array files: items in chunks of 100 ids, one array file per chunk, with
    planted non-object elements."""
    out = scratch_path(spark, "items-array")
    item_arrays(X.items(spark, sf_dir)).write.partitionBy("chunk").text(out)
    return out


def item_arrays(it: DataFrame) -> DataFrame:
    """(chunk, value): one JSON array per 100 item ids, with the planted elements."""
    els = [F.struct(F.lit(0).alias("sub"), _item_json().alias("el"))]
    for i, (m, el) in enumerate(_ARRAY_PLANTED, start=1):
        els.append(F.when(F.col("item_id") % m == 0, F.struct(F.lit(i).alias("sub"), F.lit(el).alias("el"))))
    rows = it.select((F.col("item_id") / ARRAY_CHUNK).cast("bigint").alias("chunk"), "item_id",
                     F.explode(F.filter(F.array(*els), lambda e: e.isNotNull())).alias("e"))
    return (rows.groupBy("chunk")   # one chunk = at most 100 items' elements
              .agg(F.array_sort(F.collect_list(F.struct("item_id", F.col("e.sub").alias("sub"),
                                                        F.col("e.el").alias("el")))).alias("els"))
              .select("chunk", F.concat(F.lit("["), F.array_join(F.transform("els", lambda x: x["el"]), ","),
                                        F.lit("]")).alias("value")))


@register("json_array_read", X.with_views("SELECT item_id AS problem_id, prompt, code, library FROM items",
                                          items=X.ITEMS_SQL))
def json_array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + S3: JSON-array files (detected by the leading '['); non-object elements skipped."""
    path = write_items_json_arrays(spark, sf_dir)
    return _read_cols(S.read_items(spark, path))


@register("mixed_read", X.with_views(
    f"{_READ_OUT} FROM lines l JOIN items i USING (item_id) WHERE kind IN {_KEPT} "
    "UNION ALL SELECT item_id, prompt, code, library FROM items", items=X.ITEMS_SQL, lines=_lines_sql()))
def mixed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a folder of JSON-lines and JSON-array files (one of them behind 300 empty lines), each read by its own format."""
    out = scratch_path(spark, "items-mixed")
    _in_files(_jsonl_lines(X.items(spark, sf_dir))).select("line").write.text(out)
    arrays = item_arrays(X.items(spark, sf_dir)).select(F.concat(F.repeat(F.lit("\n"), 300 * (F.col("chunk") % 2)), "value").alias("value"))
    arrays.repartition(F.col("value")).write.mode("append").option("maxRecordsPerFile", 1).text(out)
    return _read_cols(S.read_items(spark, out))


@register("dataset_union", X.with_views(
    "SELECT lang AS expert, item_id AS problem_id, prompt FROM items WHERE lang IN ('en', 'fr', 'de', 'es')",
    items=X.ITEMS_SQL))
def dataset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-expert datasets (one JSONL per language) read, tagged and unioned."""
    out = write_items_jsonl(spark, sf_dir, by_lang=True)
    paths = {lang: f"{out}/lang={lang}" for lang in EXPERT_LANGS}
    u = S.union_datasets(spark, paths)
    return u.filter(F.get_json_object("raw", "$.problem_id").isNotNull()).select(
        "expert", F.get_json_object("raw", "$.problem_id").cast("bigint").alias("problem_id"), "prompt")


@register("eligible_experts", X.with_views(
    "SELECT CAST(e.position AS INTEGER) AS position, e.expert AS source, CAST(coalesce(c.n, 0) AS BIGINT) AS valid_items, "
    f"coalesce(c.n, 0) >= {MIN_ITEMS} AS eligible FROM (VALUES "
    + ", ".join(f"({i}, '{l}')" for i, l in enumerate(EXPERT_LANGS))
    + f") AS e(position, expert) LEFT JOIN (SELECT lang, count(*) AS n FROM lines WHERE kind IN {_KEPT} AND kind <> 'empty_obj' GROUP BY lang) c ON c.lang = e.expert",
    items=X.ITEMS_SQL, lines=_lines_sql()))
def eligible_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 + D1: valid non-empty objects per expert dataset (missing file = 0), eligible if >= 50."""
    out = write_items_jsonl(spark, sf_dir, by_lang=True)
    counts = S.count_valid_objects(spark, {lang: f"{out}/lang={lang}" for lang in EXPERT_LANGS})
    return D.eligible_experts(counts, MIN_ITEMS)


@register("domain_roundtrip", X.with_views(
    f"SELECT domain, CAST(count(*) AS BIGINT) AS cnt FROM ({OC.chain_sql(REPORT_DOMAINS, ROUTE_DEFAULT)}) c GROUP BY domain",
    items=X.ITEMS_SQL))
def domain_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7: route items (domains + misc), write one directory per domain, read back, count."""
    it = items_input(spark, sf_dir).withColumn("raw", _item_json())
    routed_df = C.classify_chain(it, REPORT_DOMAINS, ROUTE_DEFAULT, keep=["item_id", "raw"])   # one consumer
    out = scratch_path(spark, "domains")
    SK.write_domains(routed_df, out)
    back = SK.read_domains(spark, out)
    return back.groupBy("domain").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


@register("split_report", X.with_views(f"""
c AS ({OC.chain_sql(REPORT_DOMAINS, ROUTE_DEFAULT)}),
  r AS (SELECT c.domain, i.item_id, lower({sql_strip('i.library')}) AS lib FROM c JOIN items i USING (item_id)),
  t AS (SELECT CAST(count(*) AS BIGINT) AS total FROM r),
  n AS (SELECT domain, count(*) AS cnt FROM r GROUP BY domain),
  d AS (SELECT conf.domain, coalesce(n.cnt, 0) AS cnt, total FROM (VALUES """
    + ", ".join(f"('{d}')" for d in REPORT_DOMAINS) + """) AS conf(domain) LEFT JOIN n USING (domain) CROSS JOIN t),
  a AS (SELECT domain, lib, count(*) AS cnt, min(item_id) AS f FROM r WHERE lib <> '' GROUP BY domain, lib),
  k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cnt DESC, f) AS rank FROM a)
SELECT domain AS key, 0 AS nth, printf('  %-15s %6d items (%5.1f%%)', domain, cnt, CASE WHEN total > 0 THEN 100.0 * cnt / total ELSE 0.0 END) AS line FROM d
UNION ALL SELECT domain, 4, '    - Top libraries: ' || string_agg(lib || '(' || cnt || ')', ', ' ORDER BY rank) FROM k WHERE rank <= 5 GROUP BY domain""",
    items=X.ITEMS_SQL))
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain and library lines of the text report, over a routed table that is written once."""
    out = scratch_path(spark, "routed")
    C.classify_chain(items_input(spark, sf_dir), REPORT_DOMAINS, ROUTE_DEFAULT, keep=["item_id", "library"]).write.parquet(out)
    routed = spark.read.parquet(out)
    lines = SK.report_lines(A.domain_distribution(routed, REPORT_DOMAINS), libraries=A.domain_top_libraries(routed))
    return lines.where("section = 1 AND nth <> 9").select("key", "nth", "line")


@register("run_results", X.with_views("""
q AS (SELECT run, step, avg(score) AS quality FROM eval_score GROUP BY run, step)
SELECT 'round' AS kind, run, step, round(quality, 9) AS quality FROM q
UNION ALL SELECT 'comparison', 'rehearsal', 0, round((max(CASE WHEN run = 'rehearsal' THEN m END) - max(CASE WHEN run = 'naive' THEN m END))
       / (max(CASE WHEN run = 'naive' THEN m END) + 1e-6) * 100.0, 9) FROM (SELECT run, avg(quality) AS m FROM q GROUP BY run)""",
    eval_score=X.EVAL_SCORE_SQL))
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds and the comparison of two runs, written as result files and read back."""
    scores = X.eval_score(spark, sf_dir)
    out = scratch_path(spark, "run-results")
    SK.write_run_results(EV.step_quality(scores), EV.run_compare(scores, "rehearsal", "naive"), out)
    rounds, comparison = SK.read_run_results(spark, out, "run string, step long, quality double", "run_a string, improvement_percent double")
    both = rounds.select(F.lit("round").alias("kind"), "run", "step", "quality").unionByName(
        comparison.select(F.lit("comparison").alias("kind"), F.col("run_a").alias("run"), F.lit(0).cast("long").alias("step"),
                          F.col("improvement_percent").alias("quality")))
    return both.withColumn("quality", F.round("quality", DECIMALS))


CALLER_DOMAINS = ["python", "docs", "sql", "javascript"]


@register("caller_stage_route", X.with_views(f"""
c AS ({OC.chain_sql(CALLER_DOMAINS, ROUTE_DEFAULT, stage_ids=(3,))})
SELECT i.item_id, CASE WHEN t THEN 'docs' ELSE c.domain END AS domain, CASE WHEN t THEN 'Table row' ELSE c.reason END AS reason
FROM (SELECT *, contains(coalesce(prompt, ''), '|') OR contains(coalesce(code, ''), '|') AS t FROM items) i JOIN c USING (item_id)""", items=X.ITEMS_SQL))
def caller_stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own stage (a column function: a '|' anywhere means docs, 0.95) before a built-in one."""
    def table_rows(domains):
        return F.when(F.col(C.T_PROMPT_CODE).contains("|"), C.make_result(F.lit("docs"), F.lit(0.95), F.lit("Table row")))
    stage = C.stage_from_column_fn("table_rows", table_rows)
    return C.classify_chain(items_input(spark, sf_dir), CALLER_DOMAINS, ROUTE_DEFAULT, stages=[stage, C.STRUCTURE])


# Caller's stages that fail on some rows: a batch function, an item function and a column function.

def _shebang(rows, domains):
    if rows["code"].isna().any():
        raise ValueError("no code")
    hit = rows["code"].str.startswith("#!")
    return pd.DataFrame({"domain": hit.map({True: "docs", False: None}), "score": hit.map({True: 0.95, False: None}), "reason": "Shebang"})


_DIALECTS = {"mysql": ("sql", 0.6, "Dialect"), "pandas": ("python", 0.5, "Frames")}


def _dialect(item, domains):
    return _DIALECTS[item["library"]]


def _statement_rate() -> tuple[F.Column, F.Column]:
    """(lines per semicolon - null without one, semicolons) of the code."""
    code = F.col(C.T_CODE)
    count = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c)))
    return F.try_divide(count("\n"), count(";")), count(";")


def _faulty_stages() -> list[C.Stage]:
    rate, semicolons = _statement_rate()
    statements = C.stage_from_column_fn(
        "statements", lambda domains: F.when(rate <= 1, C.make_result(F.lit("javascript"), F.lit(0.4), F.lit("Statements"))),
        failed=lambda domains: F.when(semicolons == 0, F.lit("division by zero")))
    return [C.stage_from_batch_fn("shebang", _shebang, inputs=["code"]),
            C.stage_from_item_fn("dialect", _dialect, inputs=["library"]), statements, C.STRUCTURE]


_FAULTY_SQL = OC.stages_sql(CALLER_DOMAINS) + """,
x AS (SELECT i.item_id, i.library, code IS NULL AS f1, coalesce(starts_with(code, '#!'), false) AS h1,
        CASE library WHEN 'mysql' THEN 0.6 WHEN 'pandas' THEN 0.5 END AS s2, CASE library WHEN 'mysql' THEN 'sql' ELSE 'python' END AS d2,
        CASE library WHEN 'mysql' THEN 'Dialect' ELSE 'Frames' END AS r2,
        length(coalesce(code, '')) - length(replace(coalesce(code, ''), ';', '')) AS semis,
        length(coalesce(code, '')) - length(replace(coalesce(code, ''), chr(10), '')) AS lines, s3_d AS d4, s3_s AS s4, s3_r AS r4
      FROM items i JOIN st USING (item_id)),
y AS (SELECT *, CASE WHEN semis > 0 AND lines <= semis THEN 0.4 END AS s3 FROM x),
z AS (SELECT *, CASE WHEN h1 THEN 1 WHEN s4 >= 0.9 THEN 4 WHEN s2 = greatest(s2, s3, s4) THEN 2
        WHEN s3 = greatest(s2, s3, s4) THEN 3 WHEN s4 IS NOT NULL THEN 4 END AS n FROM y)"""


@register("faulty_stage_route", X.with_views(_FAULTY_SQL + """
SELECT item_id, CASE n WHEN 1 THEN 'docs' WHEN 2 THEN d2 WHEN 3 THEN 'javascript' WHEN 4 THEN d4 ELSE 'python' END AS domain,
       CASE n WHEN 1 THEN 'Shebang' WHEN 2 THEN r2 WHEN 3 THEN 'Statements' WHEN 4 THEN r4 ELSE 'Default fallback' END AS reason,
       CAST(CASE WHEN h1 THEN 0 ELSE CAST(f1 AS INTEGER) + CAST(s2 IS NULL AS INTEGER) + CAST(semis = 0 AS INTEGER) END AS INTEGER) AS n_errors
FROM z""", items=X.ITEMS_SQL))
def faulty_stage_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that raise on some rows are skipped for those rows only."""
    routed = C.classify_chain(items_input(spark, sf_dir), CALLER_DOMAINS, ROUTE_DEFAULT, stages=_faulty_stages(), with_errors=True)
    return routed.select("item_id", "domain", "reason", F.size("errors").alias("n_errors"))


@register("faulty_stage_errors", X.with_views(_FAULTY_SQL + """
SELECT 'shebang' AS stage, 'ValueError: no code' AS error, count(*) AS n FROM z WHERE f1 GROUP BY ALL
UNION ALL SELECT 'dialect', 'KeyError: ' || coalesce(chr(39) || library || chr(39), 'None'), count(*) FROM z WHERE NOT h1 AND s2 IS NULL GROUP BY ALL
UNION ALL SELECT 'statements', 'division by zero', count(*) FROM z WHERE NOT h1 AND semis = 0 GROUP BY ALL""", items=X.ITEMS_SQL))
def faulty_stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of the caller's stages, counted by stage and error."""
    routed = C.classify_chain(items_input(spark, sf_dir), CALLER_DOMAINS, ROUTE_DEFAULT, stages=_faulty_stages(), with_errors=True)
    return stage_errors(routed)


@register("supervised_domains", X.with_views(f"""
sp AS ({OC.specialty_sql(R.CANONICAL_SPECIALTIES, src='pitems')})
SELECT sp.domain, p.item_id, 'Problem:' || chr(10) || {sql_strip("prompt")} || chr(10) || chr(10) || 'Answer:' || chr(10) || {sql_strip("reference_code")} || chr(10) AS text
FROM sp JOIN pitems p USING (item_id)""", pairs=X.PAIRS_SQL, pitems="SELECT *, conv_id * 1000 + turn AS item_id FROM pairs"))
def supervised_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised texts written per domain, one directory each, and read back."""
    out = scratch_path(spark, "supervised")
    p = pairs_input(spark, sf_dir).withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn"))
    split = C.split_by_specialty(p, R.CANONICAL_SPECIALTIES, keep=["item_id", "prompt", "reference_code"])
    D.write_supervised(split, out)
    return D.read_supervised(spark, out)


# --------------------------------------------------------------- preparation

REHEARSAL_RATIO = 0.1


def lang_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases over languages in order of first appearance (by doc_id)."""
    firsts = X.table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("_first"))
    w = Window.orderBy("_first")   # one row per language
    return firsts.select(F.row_number().over(w).cast("int").alias("phase"), F.col("lang").alias("domain"))


_PHASES_SQL = ("SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS phase, lang AS domain "
               "FROM (SELECT lang, min(doc_id) AS f FROM documents GROUP BY lang) x")
_WEIGHTS_SQL = (f"SELECT 'naive' AS strategy, phase, domain, 1.0e0 AS weight FROM phases UNION ALL "
                f"SELECT 'rehearsal', phase, domain, 1.0e0 FROM phases UNION ALL "
                f"SELECT 'rehearsal', c.phase, p.domain, {REHEARSAL_RATIO}e0 / greatest(c.phase - 1, 1) "
                f"FROM phases c JOIN phases p ON p.phase < c.phase")


def rehearsal_weights_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ph = lang_phases(spark, sf_dir)
    return D.phase_schedule(ph, "naive", REHEARSAL_RATIO).unionByName(
        D.phase_schedule(ph, "rehearsal", REHEARSAL_RATIO))


@register("rehearsal_weights", X.with_views("SELECT * FROM weights", phases=_PHASES_SQL, weights=_WEIGHTS_SQL))
def rehearsal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: per-phase domain weights for the naive and rehearsal strategies (phases = languages)."""
    return rehearsal_weights_df(spark, sf_dir)


@register("rehearsal_mix", X.with_views(
    "SELECT w.strategy, w.phase, w.domain, d.doc_id AS item_id FROM documents d JOIN weights w ON w.domain = d.lang "
    "WHERE w.weight >= 1.0 OR CAST(CAST('0x' || substr(md5(CAST(w.phase AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) "
    "/ 4294967296.0e0 < w.weight", phases=_PHASES_SQL, weights=_WEIGHTS_SQL))
def rehearsal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per phase, all current-domain documents plus a hashed fraction of earlier domains."""
    corpus = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("domain"))
    return D.rehearsal_mix(corpus, rehearsal_weights_df(spark, sf_dir))


SAMPLE_STEPS, SAMPLE_BATCH = 3, 4


def _draw_sql(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8) AS BIGINT)"


# swap-or-not rounds over (group, step, place) rows, one projection each
_SWAPS_SQL = "s0 AS (SELECT domain, n, step, unnest(range(least(n, {b}))) AS x FROM sizes, steps)".format(b=SAMPLE_BATCH) + "".join(
    f""", m{r} AS (SELECT *, (({_draw_sql('step', str(r))} - x) % n + n) % n AS y FROM s{r - 1}),
  s{r} AS (SELECT domain, n, step, CASE WHEN {_draw_sql('step', str(r), 'greatest(x, y)')} % 2 = 1 THEN y ELSE x END AS x FROM m{r})"""
    for r in range(1, D.SHUFFLE_ROUNDS + 1))


@register("batch_sample", X.with_views(
    f"numbered AS (SELECT domain, item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) - 1 AS x FROM split), "
    f"sizes AS (SELECT domain, count(*) AS n FROM split GROUP BY domain), "
    f"steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(1, {SAMPLE_STEPS + 1})), {_SWAPS_SQL} "
    f"SELECT domain, step, item_id FROM numbered JOIN s{D.SHUFFLE_ROUNDS} USING (domain, x)",
    items=X.ITEMS_SQL, split=OC.specialty_sql(R.CANONICAL_SPECIALTIES)))
def batch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per specialty (C8 split) and step, a 4-item batch drawn without replacement."""
    split = C.split_by_specialty(items_input(spark, sf_dir), R.CANONICAL_SPECIALTIES)
    return D.batch_sample(split, SAMPLE_STEPS, SAMPLE_BATCH)


@register("supervised_text", _pairs_sql(
    "SELECT conv_id, turn, 'Problem:' || chr(10) || " + sql_strip("prompt")
    + " || chr(10) || chr(10) || 'Answer:' || chr(10) || "
    + sql_strip("reference_code") + " || chr(10) AS text FROM pairs"))
def supervised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 + F14: supervised training text per (prompt, reference) pair."""
    return D.supervised_dataset(pairs_input(spark, sf_dir), keep=["conv_id", "turn"])


def _pair_items_sql() -> str:
    return "SELECT conv_id * 1000 + turn AS item_id, prompt, reference_code FROM pairs"


@register("expert_sets", X.with_views(f"""
sp AS ({OC.specialty_sql(R.CANONICAL_SPECIALTIES, src='pitems')}),
  j AS (SELECT sp.domain, p.item_id, p.reference_code FROM sp JOIN pitems p USING (item_id)),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS rn FROM j) x WHERE rn <= {HEAD_K}),
  pd AS (SELECT domain, avg({sql_exact_match('substring(reference_code, 1, 50)', 'reference_code')}) AS em FROM h GROUP BY domain),
  ov AS (SELECT avg(em) AS overall_quality FROM pd),
  st AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{'+'.join(s)}', {len(s)})" for i, s in enumerate(D.parse_expert_sets(R.DEFAULT_EXPERT_SETS))) + f""") AS t(setting_index, setting, num_experts))
SELECT CAST(row_number() OVER (ORDER BY overall_quality DESC, setting_index) AS BIGINT) AS rank,
       CAST(setting_index AS INTEGER) AS setting_index, setting, CAST(num_experts AS INTEGER) AS num_experts,
       round(overall_quality, 9) AS overall_quality
FROM st, ov""", pairs=X.PAIRS_SQL, pitems=_pair_items_sql()))
def expert_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 + D2 + A13: expert-set grid (default 'generalist|python,sql|python,sql,docs'),
    each scored by the canonical-domain head evaluation (exact match of the 50-char prefix,
    first 3 per domain), ranked by overall quality, ties in set order."""
    p = pairs_input(spark, sf_dir).withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn"))
    split = C.split_by_specialty(p, R.CANONICAL_SPECIALTIES, keep=["item_id", "reference_code"])
    per_dom = EV.head_eval(split, k=HEAD_K, length=50)
    overall = per_dom.agg(F.avg("exact_match")).scalar()   # scalar subquery
    sets = D.expert_sets_frame(spark, R.DEFAULT_EXPERT_SETS)
    grid = sets.withColumn("overall_quality", overall)
    w = Window.orderBy(F.desc("overall_quality"), "setting_index")
    return grid.select(F.row_number().over(w).cast("bigint").alias("rank"), "setting_index", "setting",
                       F.size("experts").cast("int").alias("num_experts"),
                       F.round("overall_quality", DECIMALS).alias("overall_quality"))


# ----------------------------------------------------------------- streaming

STREAM_STEPS, FILES_A_STEP = 4, 2


@register("stream_fold", X.with_views(f"""
{_fold_cte('pushes', where=_IN_REG)}
SELECT expert, CAST(count(*) AS BIGINT) AS version, round(coalesce(sum(1.0e0 * decay * delta), 0.0), 6) AS state
FROM d GROUP BY expert""", pushes=X.pushes_sql()))
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar log replayed in 4 micro-batches of 2 files through a Structured Streaming fold
    (foreachBatch with the batch operator), with the registry; final state per expert."""
    src = scratch_path(spark, "push-stream")
    ST.write_push_files(X.pushes(spark, sf_dir), src, STREAM_STEPS, FILES_A_STEP)
    sink, ckpt = scratch_path(spark, "fold-out"), scratch_path(spark, "fold-ckpt")
    ST.stream_fold(spark, src, sink, ckpt, files_per_trigger=FILES_A_STEP, registry=REGISTERED)
    return ST.latest_states(spark, sink).select("expert", "version", F.round("state", 6).alias("state"))


@register("stream_vector_fold", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT expert, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  s AS (SELECT expert, pos, coalesce(sum(1.0e0 * decay * x), 0.0) AS value FROM e GROUP BY expert, pos),
  c AS (SELECT expert, CAST(count(*) AS BIGINT) AS version FROM d GROUP BY expert)
SELECT s.expert, c.version, CAST(s.pos AS INTEGER) AS pos, round(s.value, 6) AS value
FROM s JOIN c USING (expert)""", vector_pushes=X.VECTOR_PUSHES_SQL))
def stream_vector_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9 on vector deltas: the embedding log replayed in 4 micro-batches through the streaming fold;
    final per-expert state in long form."""
    src = scratch_path(spark, "vec-stream")
    ST.write_push_files(X.vector_pushes(spark, sf_dir), src, STREAM_STEPS, FILES_A_STEP)
    sink, ckpt = scratch_path(spark, "vfold-out"), scratch_path(spark, "vfold-ckpt")
    ST.stream_fold(spark, src, sink, ckpt, files_per_trigger=FILES_A_STEP, vector=True)
    st = ST.latest_states(spark, sink)
    return st.select("expert", "version", F.posexplode("state").alias("pos", "value")).select(
        "expert", "version", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


@register("stream_state", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT expert, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  s AS (SELECT expert, pos, sum(1.0e0 * decay * x) AS value FROM e GROUP BY expert, pos UNION ALL
        SELECT '*', pos, sum(1.0e0 * decay * x) FROM e GROUP BY pos),
  c AS (SELECT expert, CAST(count(*) AS BIGINT) AS version FROM d GROUP BY expert UNION ALL SELECT '*', CAST(count(*) AS BIGINT) FROM d)
SELECT s.expert, c.version, CAST(s.pos AS INTEGER) AS pos, round(s.value, 6) AS value
FROM s JOIN c USING (expert)""", vector_pushes=X.VECTOR_PUSHES_SQL))
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9 + U3: the embedding log as a stream whose files all come a second time under other names, with a
    compaction every other micro-batch; experts' states and the global one ('*')."""
    src = scratch_path(spark, "twice-stream")
    ST.write_push_files(X.vector_pushes(spark, sf_dir), src, STREAM_STEPS, FILES_A_STEP)
    spark.read.schema(ST.VECTOR_PUSH_SCHEMA).parquet(src).coalesce(2).write.mode("append").parquet(src)
    sink, ckpt = scratch_path(spark, "twice-out"), scratch_path(spark, "twice-ckpt")
    ST.stream_fold(spark, src, sink, ckpt, files_per_trigger=FILES_A_STEP, vector=True, compact_every=2)
    whole = ST.latest_global(spark, sink).select(F.lit("*").alias("expert"), F.col("global_version").alias("version"), F.col("global_state").alias("state"))
    return ST.latest_states(spark, sink).unionByName(whole).select(
        "expert", "version", F.posexplode("state").alias("pos", "value")).select(
        "expert", "version", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))
