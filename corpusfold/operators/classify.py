"""Routing classifiers C1-C9 as generated Column expressions.

Every classifier is one narrow projection over the item rows: no shuffle, no
join, no Python in the hot path. A stage result is a struct
``<domain:string, score:double, reason:string>``, null meaning "no result".

Rule rows live in :mod:`corpusfold.functions.rules`; each pattern becomes one
``rlike`` on a text column that is materialised once (H8 in the survey).

The chain (C6) evaluates stages lazily: stage *k* sits inside
``CASE WHEN <no earlier stage settled> THEN ...``, so the expensive keyword
stage only runs for rows the cheaper stages left open.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.functions.regex import java_regex, java_regex_folded, required_literals
from corpusfold.functions.text import PY_WHITESPACE as _PY_WS
from corpusfold.functions.text import col_or_empty, line_count, norm
from corpusfold.operators.isolate import BatchFn, ItemFn, by_item, isolated
from corpusfold.session import ship_package

RESULT_TYPE = "struct<domain:string,score:double,reason:string>"

# Internal column names of the prepared text (dropped at the end).
T_PROMPT_CODE = "_cf_prompt_code"   # prompt \n code, case kept (C2)
T_KEYWORD = "_cf_kw_text"           # norm(prompt) + " " + norm(code) (C4)
T_CODE_NORM = "_cf_code_norm"       # norm(code) (C3)
T_CODE = "_cf_code"                 # code, '' for absent (C5)
T_LIB = "_cf_lib"                   # norm(metadata.library) (C1)
T_FOLD_PC = "_cf_fold_pc"           # fold(prompt \n code): guard text for C2
T_FOLD_KW = "_cf_fold_kw"           # fold(keyword text): guard text for C4
T_FOLD_CODE = "_cf_fold_code"       # fold(norm(code)): guard text for C3


def fold(c: Column) -> Column:
    """Case-fold for literal guards: every ASCII letter a case-insensitive Unicode match can
    stand on becomes that lower-case letter (dotted/dotless i and long s need mapping besides
    ``lower``; the Kelvin sign lowers to k)."""
    return F.translate(F.lower(F.translate(c, "\u0130", "i")), "\u017f\u0131", "si")


def guarded_rlike(text: Column, folded: Column, pattern: str, ignorecase: bool, multiline: bool) -> Column:
    """``text RLIKE pattern`` preceded by a byte-level ``contains`` of a literal every match holds.

    ``And`` short-circuits in generated code, so rows without the literal never reach
    the regex engine.
    """
    rx = (folded.rlike(java_regex_folded(pattern, multiline)) if ignorecase
          else text.rlike(java_regex(pattern, ignorecase, multiline)))
    alts = required_literals(pattern)
    if not alts:
        return rx
    guard = None
    for runs in alts:
        g = None
        for lit in runs:
            c = folded.contains(F.lit(lit))
            g = c if g is None else (g & c)
        guard = g if guard is None else (guard | g)
    return guard & rx


def null_result() -> Column:
    return F.lit(None).cast(RESULT_TYPE)


def make_result(domain: Column, score: Column, reason: Column) -> Column:
    return F.struct(domain.cast("string").alias("domain"),
                    score.cast("double").alias("score"),
                    reason.cast("string").alias("reason"))


def _ordered_unique(domains: Sequence[str]) -> list[str]:
    seen: list[str] = []
    for d in domains:
        if d not in seen:
            seen.append(d)
    return seen


def _argmax(candidates: list[Column]) -> Column:
    """Greatest struct; struct order is field by field, so put the score first and -rank second."""
    if not candidates:
        return F.lit(None)
    if len(candidates) == 1:
        return candidates[0]
    return F.greatest(*candidates)


def _sql_str(s: str) -> str:
    """Spark SQL string literal (default parser: backslash escapes are processed)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_ok() -> bool:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark is not None and \
        str(spark.conf.get("spark.sql.parser.escapedStringLiterals", "false")).lower() != "true"


def _guarded_sql(text: str, folded: str, pattern: str, ignorecase: bool, multiline: bool) -> str:
    """SQL text of :func:`guarded_rlike` over named columns."""
    rx = (f"{folded} RLIKE {_sql_str(java_regex_folded(pattern, multiline))}" if ignorecase
          else f"{text} RLIKE {_sql_str(java_regex(pattern, ignorecase, multiline))}")
    alts = required_literals(pattern)
    if not alts:
        return f"({rx})"
    guard = " OR ".join("(" + " AND ".join(f"contains({folded}, {_sql_str(lit)})" for lit in runs) + ")"
                        for runs in alts)
    return f"(({guard}) AND {rx})"


def _weighted_sum(terms: list[tuple[str, float]]) -> Column:
    """``sum(CASE WHEN cond THEN w ELSE 0 END)`` built as one SQL expression (one py4j call
    instead of several per term)."""
    return F.expr(" + ".join(f"(CASE WHEN {c} THEN {w!r}D ELSE 0.0D END)" for c, w in terms))


def _any_rlike(text: Column, folded: Column, patterns: Sequence[str], ignorecase: bool,
               multiline: bool) -> Column:
    cond = None
    for p in patterns:
        c = guarded_rlike(text, folded, p, ignorecase, multiline)
        cond = c if cond is None else (cond | c)
    return cond if cond is not None else F.lit(False)


# ----------------------------------------------------------------- text prep

def prepare_text(df: DataFrame, prompt: str = "prompt", code: str = "code",
                 library: str | None = "library", needed: Sequence[str] | None = None) -> DataFrame:
    """Materialise the texts the stages read, each once."""
    cols = df.columns
    p = F.col(prompt) if prompt in cols else F.lit(None).cast("string")
    c = F.col(code) if code in cols else F.lit(None).cast("string")
    lib = F.col(library) if library and library in cols else F.lit(None).cast("string")
    want = set(needed) if needed is not None else set(ALL_TEXTS)
    exprs = {
        T_PROMPT_CODE: F.concat(col_or_empty(p), F.lit("\n"), col_or_empty(c)),
        T_KEYWORD: F.concat(norm(p), F.lit(" "), norm(c)),
        T_CODE_NORM: norm(c),
        T_CODE: col_or_empty(c),
        T_LIB: norm(lib),
    }
    out = df.withColumns({k: v for k, v in exprs.items() if k in want})
    # Guard texts derive from the materialised texts (second projection, no re-computation).
    folds = {T_FOLD_PC: (T_PROMPT_CODE, True), T_FOLD_KW: (T_KEYWORD, False), T_FOLD_CODE: (T_CODE_NORM, False)}
    extra = {}
    for k, (src, needs_lower) in folds.items():
        if k in want:
            extra[k] = fold(F.col(src)) if needs_lower else F.translate(F.col(src), "\u017f\u0131", "si")
    return out.withColumns(extra) if extra else out


# --------------------------------------------------------------------- stages

@dataclass(frozen=True)
class Stage:
    """One classifier of a chain.

    ``build(domains)`` returns either a result Column, or a pair
    ``(pre, finish)``: ``pre`` is materialised first and ``finish(col(pre))``
    gives the result. Splitting lets a result reuse an expensive value
    without evaluating it twice.

    A stage of Python code has ``rows`` instead (a batch function, see
    :mod:`corpusfold.operators.isolate`); it reads the prepared texts ``needs`` and
    the item columns ``inputs``. ``failed(domains)`` of a column stage is an error
    text, null where the stage is fine.
    """
    name: str
    build: Callable[[Sequence[str]], Column | tuple[Column, Callable[[Column], Column]]] | None
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    rows: BatchFn | None = None
    failed: Callable[[Sequence[str]], Column] | None = None


def _library_build(domains: Sequence[str]) -> Column:
    avail = set(domains)
    pairs: list[Column] = []
    for dom, names in R.LIBRARY_MAPPING.items():
        if dom in avail:
            for n in names:
                pairs += [F.lit(n), F.lit(dom)]
    if not pairs:
        return null_result()
    dom_col = F.try_element_at(F.create_map(*pairs), F.col(T_LIB))
    return F.when(dom_col.isNotNull(),
                  make_result(dom_col, F.lit(1.0), F.concat(F.lit("Library: "), F.col(T_LIB))))


def _pattern_build(domains: Sequence[str]):
    text, folded = F.col(T_PROMPT_CODE), F.col(T_FOLD_PC)
    cands = []
    for idx, dom in enumerate(_ordered_unique(domains)):
        tiers = R.DOMAIN_PATTERNS.get(dom)
        if tiers is None:
            continue
        score = None
        if _sql_ok():
            score = _weighted_sum([(_guarded_sql(T_PROMPT_CODE, T_FOLD_PC, p, True, True), R.PATTERN_WEIGHTS[t])
                                   for t, pats in tiers.items() for p in pats])
        else:
            for tier, pats in tiers.items():
                w = R.PATTERN_WEIGHTS[tier]
                for p in pats:
                    term = F.when(guarded_rlike(text, folded, p, True, True), F.lit(w)).otherwise(F.lit(0.0))
                    score = term if score is None else score + term
        cands.append(F.struct(F.least(score / F.lit(R.PATTERN_CAP), F.lit(1.0)).alias("s"),
                              F.lit(-idx).alias("r"), F.lit(dom).alias("d")))
    if not cands:
        return null_result()

    def finish(best: Column) -> Column:
        return F.when(best["s"] > F.lit(R.PATTERN_EMIT_ABOVE),
                      make_result(best["d"], best["s"],
                                  F.format_string("Advanced patterns (confidence: %.2f)", best["s"])))
    return _argmax(cands), finish


def _structure_build(domains: Sequence[str]) -> Column:
    code, folded = F.col(T_CODE_NORM), F.col(T_FOLD_CODE)
    avail = set(domains)
    tests = {
        "sql": (R.SQL_STRUCTURE, True),
        "python": (R.PYTHON_STRUCTURE, False),
        "javascript": (R.JAVASCRIPT_STRUCTURE, False),
    }
    expr = None
    for dom, score, reason in R.STRUCTURE_RESULTS:
        if dom not in avail:
            continue
        pats, icase = tests[dom]
        cond = _any_rlike(code, folded, pats, icase, True)
        res = make_result(F.lit(dom), F.lit(score), F.lit(reason))
        expr = F.when(cond, res) if expr is None else expr.when(cond, res)
    if expr is None:
        return null_result()
    return F.when(code == F.lit(""), null_result()).otherwise(expr)


def _keyword_build(domains: Sequence[str]):
    text, folded = F.col(T_KEYWORD), F.col(T_FOLD_KW)
    raws = []   # (field name, rank, domain, raw score expression)
    for idx, dom in enumerate(_ordered_unique(domains)):
        cfg = R.KEYWORDS.get(dom)
        if cfg is None:
            continue
        score = None
        if _sql_ok():
            score = _weighted_sum([(f"contains({T_KEYWORD}, {_sql_str(kw)})", R.KEYWORD_HIT) for kw in cfg["keywords"]]
                                  + [(_guarded_sql(T_KEYWORD, T_FOLD_KW, p, True, False), R.KEYWORD_PATTERN_HIT)
                                     for p in cfg["patterns"]])
        else:
            for kw in cfg["keywords"]:
                term = F.when(text.contains(F.lit(kw)), F.lit(R.KEYWORD_HIT)).otherwise(F.lit(0.0))
                score = term if score is None else score + term
            for p in cfg["patterns"]:
                term = F.when(guarded_rlike(text, folded, p, True, False),
                              F.lit(R.KEYWORD_PATTERN_HIT)).otherwise(F.lit(0.0))
                score = term if score is None else score + term
        raws.append((f"k{idx}", idx, dom, score))
    if not raws:
        return null_result()
    # Raw scores are materialised once; ranking reads them as cheap field references.
    pre = F.struct(*[expr.alias(name) for name, _i, _d, expr in raws])

    def finish(scores: Column) -> Column:
        cands = [F.struct(F.least(scores[name] / F.lit(R.KEYWORD_CAP), F.lit(1.0)).alias("s"),
                          F.lit(-idx).alias("r"), scores[name].alias("raw"), F.lit(dom).alias("d"))
                 for name, idx, dom, _e in raws]
        best = _argmax(cands)
        return F.when(best["s"] > F.lit(0.0),
                      make_result(best["d"], best["s"],
                                  F.format_string("Keywords (score: %.1f)", best["raw"])))
    return pre, finish


def _complexity_build(domains: Sequence[str]) -> Column:
    dom, score, reason = R.COMPLEXITY_RESULT
    if dom not in set(domains):
        return null_result()
    code = F.col(T_CODE)
    cond = ((F.length(code) > F.lit(R.COMPLEXITY_MIN_CHARS))
            & (line_count(code) > F.lit(R.COMPLEXITY_MIN_LINES)))
    return F.when(cond, make_result(F.lit(dom), F.lit(score), F.lit(reason)))


ALL_TEXTS = (T_PROMPT_CODE, T_KEYWORD, T_CODE_NORM, T_CODE, T_LIB, T_FOLD_PC, T_FOLD_KW, T_FOLD_CODE)

LIBRARY = Stage("library", _library_build, (T_LIB,))
PATTERNS = Stage("patterns", _pattern_build, (T_PROMPT_CODE, T_FOLD_PC))
STRUCTURE = Stage("structure", _structure_build, (T_CODE_NORM, T_FOLD_CODE))
KEYWORDS = Stage("keywords", _keyword_build, (T_KEYWORD, T_FOLD_KW))
COMPLEXITY = Stage("complexity", _complexity_build, (T_CODE,))
DEFAULT_STAGES: tuple[Stage, ...] = (LIBRARY, PATTERNS, STRUCTURE, KEYWORDS, COMPLEXITY)


def stage_from_column_fn(name: str, fn: Callable[[Sequence[str]], Column],
                         needs: Sequence[str] | None = None, inputs: Sequence[str] = (),
                         failed: Callable[[Sequence[str]], Column] | None = None) -> Stage:
    """Wrap a user function ``domains -> Column of RESULT_TYPE`` as a chain stage.

    The function may read the prepared text columns (``T_*`` names) or the item
    columns named in ``inputs``; a ``pandas_udf`` returning the struct is accepted as
    well. An expression is evaluated inside generated code, where nothing can be
    caught: write what may fail with Spark's ``try_`` forms (``try_cast``,
    ``try_divide``, ``try_element_at``), so that the row has no result, and let
    ``failed`` name the error of such rows if they are to be counted.
    """
    return Stage(name, fn, tuple(needs if needs is not None else ALL_TEXTS), tuple(inputs), failed=failed)


def stage_from_batch_fn(name: str, fn: BatchFn, needs: Sequence[str] = (), inputs: Sequence[str] = ()) -> Stage:
    """Wrap ``(rows, domains) -> DataFrame(domain, score, reason)`` over pandas batches as a chain stage.

    ``rows`` has the prepared texts ``needs`` and the item columns ``inputs``; where
    neither is named, prompt and code (``T_PROMPT_CODE``).

    Rows on which it raises have no result from this stage (C6), and only rows no
    earlier stage has settled are shown to it.
    """
    return Stage(name, None, tuple(needs or (() if inputs else (T_PROMPT_CODE,))), tuple(inputs), rows=fn)


def stage_from_item_fn(name: str, fn: ItemFn, needs: Sequence[str] = (), inputs: Sequence[str] = ()) -> Stage:
    """Wrap ``(item, domains) -> (domain, score, reason) or None`` over single items, isolated as above."""
    return stage_from_batch_fn(name, by_item(fn), needs, inputs)


# ----------------------------------------------------------------- operators

_BUILT: dict[tuple, object] = {}


def _build_cached(stage: Stage, domains: Sequence[str]):
    """Stage expressions are unresolved Column trees that do not depend on a session or a
    DataFrame; building one takes thousands of py4j calls, so each is built once per process."""
    key = (stage.name, stage.build, tuple(domains))
    if key not in _BUILT:
        _BUILT[key] = stage.build(domains)
    return _BUILT[key]


def _add_stage(df: DataFrame, stage: Stage, domains: Sequence[str], out: str,
               gate: Column | None) -> DataFrame:
    """Adds ``out`` (the result) and, for stages that can fail, ``out + "_err"`` (an error text)."""
    if stage.rows is not None:
        ship_package(df.sparkSession)
        fields = [F.col(c) for c in dict.fromkeys([*stage.needs, *stage.inputs])]
        ran = isolated(stage.rows, domains)(F.struct(*fields), F.lit(True) if gate is None else gate)
        df = df.withColumn(out + "_ran", ran)
        got = F.col(out + "_ran")
        result = F.when(got["score"].isNotNull(), make_result(got["domain"], got["score"], got["reason"]))
        return df.withColumns({out: result.cast(RESULT_TYPE), out + "_err": got["error"]}).drop(out + "_ran")
    built = _build_cached(stage, domains)
    if isinstance(built, tuple):
        pre, finish = built
        pre_name = out + "_pre"
        pre = pre if gate is None else F.when(gate, pre)
        df = df.withColumn(pre_name, pre)
        return df.withColumn(out, finish(F.col(pre_name)).cast(RESULT_TYPE)).drop(pre_name)
    res = built if gate is None else F.when(gate, built)
    added = {out: res.cast(RESULT_TYPE)}
    if stage.failed is not None:
        error = stage.failed(domains)
        added[out + "_err"] = (error if gate is None else F.when(gate, error)).cast("string")
    return df.withColumns(added)


def _errors(df: DataFrame, stages: Sequence[Stage], names: Sequence[str]) -> Column:
    """array<struct<stage, error>> of the stages that failed on the row."""
    each = [F.when(F.col(f"{n}_err").isNotNull(), F.struct(F.lit(st.name).alias("stage"), F.col(f"{n}_err").alias("error")))
            for st, n in zip(stages, names) if f"{n}_err" in df.columns]
    none = F.array().cast("array<struct<stage:string,error:string>>")
    return F.array_compact(F.array(*each)) if each else none


def classify_stage(df: DataFrame, stage: Stage, domains: Sequence[str], *,
                   prompt: str = "prompt", code: str = "code", library: str | None = "library",
                   keep: Sequence[str] = ("item_id",), with_errors: bool = False) -> DataFrame:
    """Run one classifier (C1-C5, C9) and return ``keep`` + domain, score, reason (null = no result)."""
    prepared = prepare_text(df.select(*_needed_inputs(df, [*keep, *stage.inputs], prompt, code, library)),
                            prompt, code, library, stage.needs)
    out = _add_stage(prepared, stage, domains, "_cf_res", None)
    return out.select(*keep, F.col("_cf_res.domain").alias("domain"),
                      F.col("_cf_res.score").alias("score"),
                      F.col("_cf_res.reason").alias("reason"),
                      *([_errors(out, [stage], ["_cf_res"]).alias("errors")] if with_errors else []))


_OUTPUTS = ("domain", "score", "reason", "errors")


def _kept(df: DataFrame, keep: Sequence[str] | None) -> list[str]:
    """Columns carried to the output; with ``keep=None`` all input columns except earlier
    routing results, which the new result replaces."""
    return [c for c in df.columns if c not in _OUTPUTS] if keep is None else list(keep)


def _needed_inputs(df: DataFrame, keep: Sequence[str], *names: str | None) -> list[str]:
    cols: list[str] = []
    for c in list(keep) + [n for n in names if n]:
        if c in df.columns and c not in cols:
            cols.append(c)
    return cols


def classify_chain(df: DataFrame, domains: Sequence[str], default_domain: str, *,
                   stages: Sequence[Stage] = DEFAULT_STAGES,
                   prompt: str = "prompt", code: str = "code", library: str | None = "library",
                   keep: Sequence[str] | None = ("item_id",), with_score: bool = False,
                   with_errors: bool = False) -> DataFrame:
    """Ordered chain with early stop at 0.9 and acceptance at 0.3.

    Result = the first stage scoring >= 0.9 if any, else the highest score
    (earliest stage on ties); below 0.3 the row goes to ``default_domain`` with
    reason ``Default fallback``. ``keep=None`` keeps every input column. A stage that
    fails on a row is skipped there; ``with_errors`` adds ``errors``, the failures of
    the row, for :func:`corpusfold.operators.isolate.stage_errors`.

    The result is a lazy projection. Before joining or filtering on ``domain``,
    checkpoint it (``corpusfold.session.cut_lineage``) or write it out: Catalyst
    would otherwise push the predicate into the rule projections (re-running the
    rules) and derive constraints through every stage alias.
    """
    if not domains:
        raise ValueError("domain list is empty")
    keep_cols = _kept(df, keep)
    needs: list[str] = []
    for st in stages:
        for n in st.needs:
            if n not in needs:
                needs.append(n)
    inputs = [c for st in stages for c in st.inputs]
    base = df if keep is None else df.select(*_needed_inputs(df, [*keep_cols, *inputs], prompt, code, library))
    out = prepare_text(base, prompt, code, library, needs)

    names: list[str] = []
    settled: Column | None = None
    for i, st in enumerate(stages):
        name = f"_cf_s{i}"
        gate = None if settled is None else ~settled
        out = _add_stage(out, st, domains, name, gate)
        hit = F.coalesce(F.col(name)["score"] >= F.lit(R.CHAIN_STOP_AT), F.lit(False))
        settled = hit if settled is None else (settled | hit)
        names.append(name)

    first_high = F.coalesce(*[F.when(F.col(n)["score"] >= F.lit(R.CHAIN_STOP_AT), F.col(n)) for n in names]) \
        if len(names) > 1 else F.when(F.col(names[0])["score"] >= F.lit(R.CHAIN_STOP_AT), F.col(names[0]))
    ranked = [F.when(F.col(n).isNotNull(),
                     F.struct(F.col(n)["score"].alias("s"), F.lit(-i).alias("r"),
                              F.col(n)["domain"].alias("d"), F.col(n)["reason"].alias("why")))
              for i, n in enumerate(names)]
    best = _argmax(ranked)
    out = out.withColumn("_cf_best", best).withColumn("_cf_first", first_high)
    chosen_domain = F.coalesce(F.col("_cf_first")["domain"], F.col("_cf_best")["d"])
    chosen_score = F.coalesce(F.col("_cf_first")["score"], F.col("_cf_best")["s"])
    chosen_reason = F.coalesce(F.col("_cf_first")["reason"], F.col("_cf_best")["why"])
    accepted = F.coalesce(chosen_score >= F.lit(R.CHAIN_ACCEPT_AT), F.lit(False))
    # coalesce(..., literal) makes both columns non-nullable: a join on ``domain`` then infers no
    # ``isnotnull`` filter that Catalyst would push into the rule projections.
    cols = [*keep_cols,
            F.coalesce(F.when(accepted, chosen_domain), F.lit(default_domain)).alias("domain"),
            F.coalesce(F.when(accepted, chosen_reason), F.lit(R.CHAIN_FALLBACK_REASON)).alias("reason")]
    if with_score:
        cols.append(F.when(accepted, chosen_score).alias("score"))
    if with_errors:
        cols.append(_errors(out, stages, names).alias("errors"))
    return out.select(*cols)


# ------------------------------------------------------------------------ C7

def classify_imports(df: DataFrame, domains: Sequence[str], default_domain: str, *,
                     library: str | None = "library", keep: Sequence[str] | None = ("item_id",)) -> DataFrame:
    """Import-based chain over library-level buckets.

    1. ``metadata.library`` (synonym-normalised) -> first allowed bucket of its list;
    2. each of 14 patterns over all code and text fields adds 1 to each of its
       buckets; the highest allowed bucket wins, ties by first insertion (the
       earliest (pattern, position) that touched the bucket);
    3. ``default_domain`` if allowed, else the first domain.
    Code fields are read in the order of ``rules.CODE_KEYS`` then ``rules.TEXT_KEYS``
    wherever the input has such a column.
    """
    if not domains:
        raise ValueError("domain list is empty")
    allowed = _ordered_unique(domains)
    keep_cols = _kept(df, keep)
    code_cols = [c for c in R.CODE_KEYS if c in df.columns]
    text_cols = [c for c in R.TEXT_KEYS if c in df.columns]

    def joined(cols: list[str]) -> Column:
        if not cols:
            return F.lit("")
        return F.concat_ws("\n", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols])

    lib_raw = F.col(library).cast("string") if library and library in df.columns else F.lit(None).cast("string")
    lib_low = F.lower(F.btrim(lib_raw, F.lit(_PY_WS)))
    syn = F.create_map(*[x for k, v in R.LIBRARY_SYNONYMS.items() for x in (F.lit(k), F.lit(v))])
    lib_norm = F.coalesce(F.try_element_at(syn, lib_low), lib_low)

    base = df.select(*dict.fromkeys(keep_cols + code_cols + text_cols +
                                    ([library] if library and library in df.columns else [])))
    base = base.withColumns({
        "_cf_all": F.concat(joined(code_cols), F.lit("\n"), joined(text_cols)),
        "_cf_libn": F.when(lib_raw.isNotNull() & (lib_raw != F.lit("")), lib_norm),
    })
    base = base.withColumn("_cf_fold", fold(F.col("_cf_all")))

    # Step 1: hint -> first allowed bucket of the library's list.
    hint_expr = None
    for lib, buckets in R.LIBRARY_BUCKETS.items():
        chosen = next((b for b in buckets if b in allowed), None)
        if chosen is None:
            continue
        res = make_result(F.lit(chosen), F.lit(1.0), F.lit(f"metadata.library:{lib}->{chosen}"))
        cond = F.col("_cf_libn") == F.lit(lib)
        hint_expr = F.when(cond, res) if hint_expr is None else hint_expr.when(cond, res)
    hint_expr = hint_expr if hint_expr is not None else null_result()
    base = base.withColumn("_cf_hint", hint_expr.cast(RESULT_TYPE))

    # Step 2: one boolean per pattern, evaluated only for rows without a hint.
    flags = {}
    for i, (lib, pat, ml) in enumerate(R.IMPORT_PATTERNS):
        flags[f"_cf_p{i}"] = F.when(F.col("_cf_hint").isNull(),
                                    guarded_rlike(F.col("_cf_all"), F.col("_cf_fold"), pat, True, ml))
    base = base.withColumns(flags)

    cands = []
    for b in allowed:
        touching = []   # (pattern index, position of b in the pattern's bucket list)
        for i, (lib, _p, _m) in enumerate(R.IMPORT_PATTERNS):
            blist = R.LIBRARY_BUCKETS.get(lib, [lib])
            if b in blist:
                touching.append((i, blist.index(b)))
        if not touching:
            continue
        count = None
        first = None
        for i, pos in touching:
            hit = F.coalesce(F.col(f"_cf_p{i}"), F.lit(False))
            term = F.when(hit, F.lit(1)).otherwise(F.lit(0))
            count = term if count is None else count + term
            key = F.when(hit, F.lit(i * 100 + pos))
            first = key if first is None else F.least(first, key)
        cands.append(F.when(count > 0, F.struct(count.alias("n"), (-first).alias("r"), F.lit(b).alias("d"))))
    best = _argmax(cands) if cands else F.lit(None)
    base = base.withColumn("_cf_pat", best)

    fallback = default_domain if default_domain in allowed else allowed[0]
    domain = F.coalesce(F.col("_cf_hint")["domain"], F.col("_cf_pat")["d"], F.lit(fallback))
    reason = F.coalesce(F.col("_cf_hint")["reason"],
                        F.concat(F.lit("pattern:"), F.col("_cf_pat")["d"]),
                        F.lit(R.IMPORT_FALLBACK_REASON))
    return base.select(*keep_cols, domain.alias("domain"), reason.alias("reason"))


# ------------------------------------------------------------------------ C8

def split_by_specialty(df: DataFrame, specialties: Sequence[str], *, prompt: str = "prompt",
                       key: str = "item_id", keep: Sequence[str] | None = ("item_id",)) -> DataFrame:
    """First of python / sql / docs (fixed order, only if requested) whose keywords occur in
    the lower-cased prompt; other rows go to a requested specialty chosen by a reproducible hash
    of ``key`` (the experiments pick at random)."""
    if not specialties:
        raise ValueError("specialty list is empty")
    specs = list(specialties)
    keep_cols = _kept(df, keep)
    low = F.lower(col_or_empty(F.col(prompt) if prompt in df.columns else F.lit(None)))
    expr = None
    for spec, kws in R.SPECIALTY_KEYWORDS.items():
        if spec not in specs:
            continue
        cond = None
        for kw in kws:
            c = low.contains(F.lit(kw))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(spec)) if expr is None else expr.when(cond, F.lit(spec))
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    pick = F.element_at(F.array(*[F.lit(s) for s in specs]), (h % F.lit(len(specs))).cast("int") + F.lit(1))
    domain = pick if expr is None else F.coalesce(expr, pick)
    return df.select(*keep_cols, domain.alias("domain"))

