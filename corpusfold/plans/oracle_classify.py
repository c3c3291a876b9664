"""DuckDB SQL for the routing classifiers (oracle side of C1-C8).

Written independently of the Spark expressions: per-domain scores as
columns, the winner picked with ``CASE WHEN score_i = greatest(...)`` in
domain order (first domain wins ties), patterns in RE2 form.
"""

from __future__ import annotations

from collections.abc import Sequence

from corpusfold.functions import rules as R
from corpusfold.functions.regex import re2_regex, sql_literal
from corpusfold.functions.text import sql_line_count, sql_norm, sql_strip


def _uniq(domains: Sequence[str]) -> list[str]:
    out: list[str] = []
    for d in domains:
        if d not in out:
            out.append(d)
    return out


def _rx(text: str, pattern: str, icase: bool, ml: bool) -> str:
    return f"regexp_matches({text}, {sql_literal(re2_regex(pattern, icase, ml))})"


def prep_cte(src: str = "items") -> str:
    """Prepared texts: pc = prompt\\ncode, kw = norm(prompt) || ' ' || norm(code), cn, cr, lib."""
    return (f"SELECT item_id, coalesce(prompt, '') || chr(10) || coalesce(code, '') AS pc, "
            f"{sql_norm('prompt')} || ' ' || {sql_norm('code')} AS kw, "
            f"{sql_norm('code')} AS cn, coalesce(code, '') AS cr, {sql_norm('library')} AS lib FROM {src}")


def _pick_first_max(names: list[tuple[str, str]]) -> str:
    """CASE returning the label of the first column equal to the maximum. names = [(col, label)]."""
    m = "greatest(" + ", ".join(c for c, _ in names) + ")" if len(names) > 1 else names[0][0]
    whens = " ".join(f"WHEN {c} = {m} THEN {sql_literal(lbl)}" for c, lbl in names)
    return f"CASE {whens} END"


def stage_columns(domains: Sequence[str]) -> dict[str, list[str]]:
    """SQL select items per stage over the prep CTE.

    Returns ``{"scores": [...], "stages": [...]}``: the first list is evaluated
    over ``prep`` and yields raw per-domain scores; the second over that result
    and yields ``s{i}_d, s{i}_s, s{i}_r`` for stages 1..5.
    """
    avail = set(domains)
    doms = _uniq(domains)
    scores: list[str] = []
    stages: list[str] = []

    # C1 library
    whens = []
    for dom, names in R.LIBRARY_MAPPING.items():
        if dom in avail:
            whens.append(f"WHEN lib IN ({', '.join(sql_literal(n) for n in names)}) THEN {sql_literal(dom)}")
    scores.append(f"CASE {' '.join(whens)} END AS c1_dom" if whens else "CAST(NULL AS VARCHAR) AS c1_dom")
    scores.append("lib")
    stages += ["c1_dom AS s1_d", "CASE WHEN c1_dom IS NOT NULL THEN 1.0 END AS s1_s",
               "CASE WHEN c1_dom IS NOT NULL THEN 'Library: ' || lib END AS s1_r"]

    # C2 weighted patterns
    c2 = []
    for dom in doms:
        tiers = R.DOMAIN_PATTERNS.get(dom)
        if tiers is None:
            continue
        terms = [f"(CASE WHEN {_rx('pc', p, True, True)} THEN {R.PATTERN_WEIGHTS[t]} ELSE 0.0 END)"
                 for t, pats in tiers.items() for p in pats]
        col = f"c2_{len(c2)}"
        scores.append(f"least(({' + '.join(terms)}) / {R.PATTERN_CAP}, 1.0) AS {col}")
        c2.append((col, dom))
    if c2:
        m = "greatest(" + ", ".join(c for c, _ in c2) + ")" if len(c2) > 1 else c2[0][0]
        stages += [f"CASE WHEN {m} > {R.PATTERN_EMIT_ABOVE} THEN {_pick_first_max(c2)} END AS s2_d",
                   f"CASE WHEN {m} > {R.PATTERN_EMIT_ABOVE} THEN {m} END AS s2_s",
                   f"CASE WHEN {m} > {R.PATTERN_EMIT_ABOVE} THEN printf('Advanced patterns (confidence: %.2f)', {m}) END AS s2_r"]
    else:
        stages += ["CAST(NULL AS VARCHAR) AS s2_d", "CAST(NULL AS DOUBLE) AS s2_s", "CAST(NULL AS VARCHAR) AS s2_r"]

    # C3 structure
    tests = {"sql": (R.SQL_STRUCTURE, True), "python": (R.PYTHON_STRUCTURE, False),
             "javascript": (R.JAVASCRIPT_STRUCTURE, False)}
    c3_whens = []
    for dom, score, reason in R.STRUCTURE_RESULTS:
        if dom in avail:
            pats, icase = tests[dom]
            cond = " OR ".join(_rx("cn", p, icase, True) for p in pats)
            c3_whens.append((cond, dom, score, reason))
    if c3_whens:
        def case(idx: int) -> str:
            return "CASE WHEN cn = '' THEN NULL " + " ".join(
                f"WHEN {cond} THEN {sql_literal(str(v[idx - 1]))}" for cond, *v in c3_whens) + " END"
        scores.append(f"{case(1)} AS c3_dom")
        scores.append(f"CAST({case(2)} AS DOUBLE) AS c3_score")
        scores.append(f"{case(3)} AS c3_reason")
    else:
        scores += ["CAST(NULL AS VARCHAR) AS c3_dom", "CAST(NULL AS DOUBLE) AS c3_score",
                   "CAST(NULL AS VARCHAR) AS c3_reason"]
    stages += ["c3_dom AS s3_d", "c3_score AS s3_s", "c3_reason AS s3_r"]

    # C4 keywords
    c4 = []
    for dom in doms:
        cfg = R.KEYWORDS.get(dom)
        if cfg is None:
            continue
        terms = [f"(CASE WHEN contains(kw, {sql_literal(k)}) THEN 1.0 ELSE 0.0 END)" for k in cfg["keywords"]]
        terms += [f"(CASE WHEN {_rx('kw', p, True, False)} THEN 2.0 ELSE 0.0 END)" for p in cfg["patterns"]]
        col = f"c4_{len(c4)}"
        scores.append(f"({' + '.join(terms)}) AS {col}")
        c4.append((col, dom))
    if c4:
        normed = [(f"least({c} / {R.KEYWORD_CAP}, 1.0)", d) for c, d in c4]
        m = "greatest(" + ", ".join(c for c, _ in normed) + ")" if len(normed) > 1 else normed[0][0]
        raw_of_winner = "CASE " + " ".join(f"WHEN {n} = {m} THEN {c}" for (n, _), (c, _) in zip(normed, c4)) + " END"
        stages += [f"CASE WHEN {m} > 0 THEN {_pick_first_max(normed)} END AS s4_d",
                   f"CASE WHEN {m} > 0 THEN {m} END AS s4_s",
                   f"CASE WHEN {m} > 0 THEN printf('Keywords (score: %.1f)', {raw_of_winner}) END AS s4_r"]
    else:
        stages += ["CAST(NULL AS VARCHAR) AS s4_d", "CAST(NULL AS DOUBLE) AS s4_s", "CAST(NULL AS VARCHAR) AS s4_r"]

    # C5 complexity
    dom, score, reason = R.COMPLEXITY_RESULT
    if dom in avail:
        cond = f"length(cr) > {R.COMPLEXITY_MIN_CHARS} AND {sql_line_count('cr')} > {R.COMPLEXITY_MIN_LINES}"
        scores.append(f"({cond}) AS c5_hit")
        stages += [f"CASE WHEN c5_hit THEN {sql_literal(dom)} END AS s5_d",
                   f"CASE WHEN c5_hit THEN {score} END AS s5_s",
                   f"CASE WHEN c5_hit THEN {sql_literal(reason)} END AS s5_r"]
    else:
        stages += ["CAST(NULL AS VARCHAR) AS s5_d", "CAST(NULL AS DOUBLE) AS s5_s", "CAST(NULL AS VARCHAR) AS s5_r"]
    return {"scores": scores, "stages": stages}


def stages_sql(domains: Sequence[str], src: str = "items") -> str:
    cols = stage_columns(domains)
    return (f"WITH prep AS ({prep_cte(src)}), "
            f"sc AS (SELECT item_id, {', '.join(cols['scores'])} FROM prep), "
            f"st AS (SELECT item_id, {', '.join(cols['stages'])} FROM sc) ")


def single_stage_sql(domains: Sequence[str], stage: int, src: str = "items") -> str:
    return stages_sql(domains, src) + \
        f"SELECT item_id, s{stage}_d AS domain, CAST(s{stage}_s AS DOUBLE) AS score, s{stage}_r AS reason FROM st"


def chain_sql(domains: Sequence[str], default_domain: str, stage_ids: Sequence[int] = (1, 2, 3, 4, 5),
              src: str = "items") -> str:
    ids = list(stage_ids)
    hi = " ".join(f"WHEN s{i}_s >= {R.CHAIN_STOP_AT} THEN {i}" for i in ids)
    # argmax over non-null scores, earliest stage on ties.
    m = "greatest(" + ", ".join(f"s{i}_s" for i in ids) + ")" if len(ids) > 1 else f"s{ids[0]}_s"
    am = " ".join(f"WHEN s{i}_s = {m} THEN {i}" for i in ids)
    pick = f"coalesce(CASE {hi} END, CASE {am} END)"
    sel_d = " ".join(f"WHEN {i} THEN s{i}_d" for i in ids)
    sel_s = " ".join(f"WHEN {i} THEN s{i}_s" for i in ids)
    sel_r = " ".join(f"WHEN {i} THEN s{i}_r" for i in ids)
    return (stages_sql(domains, src) +
            f", ch AS (SELECT item_id, CASE {pick} {sel_d} END AS d, CASE {pick} {sel_s} END AS s, "
            f"CASE {pick} {sel_r} END AS r FROM st) "
            f"SELECT item_id, CASE WHEN s >= {R.CHAIN_ACCEPT_AT} THEN d ELSE {sql_literal(default_domain)} END AS domain, "
            f"CASE WHEN s >= {R.CHAIN_ACCEPT_AT} THEN r ELSE {sql_literal(R.CHAIN_FALLBACK_REASON)} END AS reason FROM ch")


def imports_sql(domains: Sequence[str], default_domain: str, src: str = "items",
                code_cols: Sequence[str] = ("code",), text_cols: Sequence[str] = ("prompt",)) -> str:
    allowed = _uniq(domains)
    def joined(cols: Sequence[str]) -> str:
        if not cols:
            return "''"
        return "concat_ws(chr(10), " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"
    low = f"lower({sql_strip('library')})"
    syn = "CASE " + " ".join(f"WHEN {low} = {sql_literal(k)} THEN {sql_literal(v)}"
                             for k, v in R.LIBRARY_SYNONYMS.items()) + f" ELSE {low} END"
    hint_whens = []
    for lib, buckets in R.LIBRARY_BUCKETS.items():
        chosen = next((b for b in buckets if b in allowed), None)
        if chosen:
            hint_whens.append((lib, chosen))
    hint_d = ("CASE " + " ".join(f"WHEN libn = {sql_literal(l)} THEN {sql_literal(c)}" for l, c in hint_whens) + " END") \
        if hint_whens else "CAST(NULL AS VARCHAR)"
    hint_r = ("CASE " + " ".join(f"WHEN libn = {sql_literal(l)} THEN {sql_literal(f'metadata.library:{l}->{c}')}"
                                 for l, c in hint_whens) + " END") if hint_whens else "CAST(NULL AS VARCHAR)"
    flags = [f"regexp_matches(alltext, {sql_literal(re2_regex(p, True, ml))}) AS p{i}"
             for i, (_lib, p, ml) in enumerate(R.IMPORT_PATTERNS)]
    keys = []
    for b in allowed:
        touching = [(i, R.LIBRARY_BUCKETS.get(lib, [lib]).index(b))
                    for i, (lib, _p, _m) in enumerate(R.IMPORT_PATTERNS) if b in R.LIBRARY_BUCKETS.get(lib, [lib])]
        if not touching:
            continue
        n = " + ".join(f"CAST(p{i} AS INTEGER)" for i, _ in touching)
        first = "least(" + ", ".join(f"CASE WHEN p{i} THEN {i * 100 + pos} END" for i, pos in touching) + ")"
        keys.append((f"CASE WHEN ({n}) > 0 THEN ({n}) * 1000000 - {first} END", b))
    if keys:
        mk = "greatest(" + ", ".join(k for k, _ in keys) + ")" if len(keys) > 1 else keys[0][0]
        pat = "CASE " + " ".join(f"WHEN {k} = {mk} THEN {sql_literal(b)}" for k, b in keys) + " END"
    else:
        pat = "CAST(NULL AS VARCHAR)"
    fallback = default_domain if default_domain in allowed else allowed[0]
    return (f"WITH prep AS (SELECT item_id, {joined(code_cols)} || chr(10) || {joined(text_cols)} AS alltext, "
            f"CASE WHEN library IS NOT NULL AND library <> '' THEN {syn} END AS libn FROM {src}), "
            f"fl AS (SELECT item_id, {hint_d} AS hd, {hint_r} AS hr, {', '.join(flags)} FROM prep), "
            f"pk AS (SELECT item_id, hd, hr, {pat} AS pd FROM fl) "
            f"SELECT item_id, coalesce(hd, pd, {sql_literal(fallback)}) AS domain, "
            f"coalesce(hr, 'pattern:' || pd, {sql_literal(R.IMPORT_FALLBACK_REASON)}) AS reason FROM pk")


def specialty_sql(specialties: Sequence[str], src: str = "items") -> str:
    specs = list(specialties)
    whens = []
    for spec, kws in R.SPECIALTY_KEYWORDS.items():
        if spec in specs:
            cond = " OR ".join(f"contains(low, {sql_literal(k)})" for k in kws)
            whens.append(f"WHEN {cond} THEN {sql_literal(spec)}")
    arr = "[" + ", ".join(sql_literal(s) for s in specs) + "]"
    pick = f"{arr}[CAST(CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % {len(specs)} AS INTEGER) + 1]"
    kw = f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS VARCHAR)"
    return (f"WITH p AS (SELECT item_id, lower(coalesce(prompt, '')) AS low FROM {src}) "
            f"SELECT item_id, coalesce({kw}, {pick}) AS domain FROM p")
