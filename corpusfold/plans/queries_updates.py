"""Update-log fold queries (U1-U8, U10-U12, A10, A11) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.plans import fixtures as X
from corpusfold.plans.catalog import register, rounded
from corpusfold.operators import history as H
from corpusfold.operators import updates as U
from corpusfold.session import cut_lineage, scratch_path


# ------------------------------------------------------------- update folds

REGISTERED = ["click", "purchase", "signup", "view", "refund"]   # 'error' is not registered
_REG_SQL = "(VALUES " + ", ".join(f"('{e}')" for e in REGISTERED) + ") AS reg(expert)"
_IN_REG = "expert IN (" + ", ".join(f"'{e}'" for e in REGISTERED) + ")"
_DECAY_SQL = ("CASE WHEN 1.0e0 + 0.1e0 * (version - worker_version) > 0 "
              "THEN 1.0e0 / (1.0e0 + 0.1e0 * (version - worker_version)) END")


def _fold_cte(src: str, part: str = "expert", where: str = "TRUE", prefix: str = "") -> str:
    """CTEs ``{prefix}v`` (version each push meets) and ``{prefix}d`` (staleness, decay)."""
    v, d = f"{prefix}v", f"{prefix}d"
    return (f"{v} AS (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY seq) - 1 AS BIGINT) AS version "
            f"FROM {src} WHERE {where}), {d} AS (SELECT *, version - worker_version AS staleness, "
            f"{_DECAY_SQL} AS decay FROM {v})")


def _step(col: str = "seq") -> F.Column:
    return (F.col(col) % 5 + 1).cast("bigint")


@register("expert_fold", X.with_views(f"""
{_fold_cte('pushes', where=_IN_REG)},
  f AS (SELECT expert, count(*) AS version, sum(1.0e0 * decay * delta) AS state FROM d GROUP BY expert)
SELECT reg.expert, CAST(coalesce(f.version, 0) AS BIGINT) AS version, round(coalesce(f.state, 0.0), 6) AS state
FROM {_REG_SQL} LEFT JOIN f ON f.expert = reg.expert""", pushes=X.pushes_sql()))
def expert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + U2: registered experts' states folded from the scalar update log."""
    st = U.expert_states(REGISTERED, X.pushes(spark, sf_dir))
    return st.select("expert", "version", F.round("state", 6).alias("state"))


@register("global_fold", X.with_views(f"""
{_fold_cte('pushes', where=_IN_REG)}
SELECT CAST(count(*) AS BIGINT) AS global_version, round(coalesce(sum(1.0e0 * decay * delta), 0.0), 6) AS global_state
FROM d""", pushes=X.pushes_sql()))
def global_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global (gateway) state and version over every accepted push."""
    g = U.global_scalar(U.accepted(X.pushes(spark, sf_dir), REGISTERED))
    return g.select("global_version", F.round("global_state", 6).alias("global_state"))


@register("vector_fold", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT expert, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  s AS (SELECT expert, pos, coalesce(sum(1.0e0 * decay * x), 0.0) AS value FROM e GROUP BY expert, pos),
  n AS (SELECT expert, sqrt(sum(value * value)) AS l2_norm FROM s GROUP BY expert),
  c AS (SELECT expert, CAST(count(*) AS BIGINT) AS version FROM d GROUP BY expert)
SELECT s.expert, c.version, CAST(s.pos AS INTEGER) AS pos, round(s.value, 6) AS value, round(n.l2_norm, 6) AS l2_norm
FROM s JOIN n USING (expert) JOIN c USING (expert)""", vector_pushes=X.VECTOR_PUSHES_SQL))
def vector_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 + F15 on vector deltas: per-expert long-form state, version and L2 norm."""
    f = U.fold_vectors(X.vector_pushes(spark, sf_dir))
    return f.select("expert", "version", "pos", F.round("value", 6).alias("value"),
                    F.round("l2_norm", 6).alias("l2_norm"))


@register("global_vector_fold", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d)
SELECT CAST(pos AS INTEGER) AS pos, round(coalesce(sum(1.0e0 * decay * x), 0.0), 6) AS value,
       (SELECT CAST(count(*) AS BIGINT) FROM d) AS global_version
FROM e GROUP BY pos""", vector_pushes=X.VECTOR_PUSHES_SQL))
def global_vector_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3 on vector deltas: position-wise global state."""
    g = U.global_vectors(X.vector_pushes(spark, sf_dir))
    return g.select("pos", F.round("value", 6).alias("value"), "global_version")


COMBINE_DIM = 64


def combine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 10 consecutive pushes; every 7th push (seq % 7 = 3) carries a cut (wrong-shape)
    delta; one update per (batch, expert), the latest."""
    v = X.vector_pushes(spark, sf_dir).select(
        (F.col("seq") / 10).cast("bigint").alias("batch"), "expert", "seq",
        F.when(F.col("seq") % 7 == 3, F.slice("delta", 1, 32)).otherwise(F.col("delta")).alias("delta"))
    # Partition by batch once: the per-(batch, expert) dedup and the per-batch weights reuse it.
    return U.latest_per_key(v.repartition("batch"), ["batch", "expert"], "seq", ["delta"])


_BATCHES_SQL = f"""
SELECT batch, expert, arg_max(delta, seq) AS delta FROM (
  SELECT CAST(seq // 10 AS BIGINT) AS batch, expert, seq,
         CASE WHEN seq % 7 = 3 THEN delta[1:32] ELSE delta END AS delta FROM vector_pushes) t
GROUP BY batch, expert"""


def _combine_sql(strategy: str) -> str:
    w = "1.0e0 / n" if strategy == "weighted_average" else "1.0e0"
    return (f"SELECT '{strategy}' AS strategy, CAST(pos AS INTEGER) AS pos, round(sum({w} * x), 6) AS value, "
            f"(SELECT CAST(count(DISTINCT batch) AS BIGINT) FROM batches) AS version FROM "
            f"(SELECT n, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM "
            f"(SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM batches) s WHERE len(delta) = {COMBINE_DIM}) e "
            f"GROUP BY pos")


@register("batch_combine", X.with_views(
    f"{_combine_sql('weighted_average')} UNION ALL {_combine_sql('sum')}",
    vector_pushes=X.VECTOR_PUSHES_SQL, batches=_BATCHES_SQL))
def batch_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: weighted-average and sum combination of expert deltas per batch (shape-mismatched skipped)."""
    b = combine_batches(spark, sf_dir)
    outs = []
    for strat in ("weighted_average", "sum"):
        st, _ = U.batch_combine(b, COMBINE_DIM, strat)
        outs.append(st.select(F.lit(strat).alias("strategy"), "pos", F.round("value", 6).alias("value"), "version"))
    return outs[0].unionByName(outs[1])


@register("combine_contributions", X.with_views(f"""
SELECT expert, round(arg_max(1.0e0 / n, batch), 6) AS weight FROM
  (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM batches) s
WHERE len(delta) = {COMBINE_DIM} GROUP BY expert""", vector_pushes=X.VECTOR_PUSHES_SQL, batches=_BATCHES_SQL))
def combine_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 contributions: last weighted-average weight recorded per accepted expert."""
    _, contrib = U.batch_combine(combine_batches(spark, sf_dir), COMBINE_DIM, "weighted_average")
    return contrib.select("expert", F.round("weight", 6).alias("weight"))


def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter-style pushes: each vector push carries three named tensors,
    ``layer{seq%4}.lora_A`` (first half), ``.lora_B`` (second half) and ``.base`` (all)."""
    v = X.vector_pushes(spark, sf_dir)
    layer = F.concat(F.lit("layer"), (F.col("seq") % 4).cast("string"))
    parts = F.array(
        F.struct(F.concat(layer, F.lit(".lora_A")).alias("key"), F.slice("delta", 1, 32).alias("delta")),
        F.struct(F.concat(layer, F.lit(".lora_B")).alias("key"), F.slice("delta", 33, 32).alias("delta")),
        F.struct(F.concat(layer, F.lit(".base")).alias("key"), F.col("delta").alias("delta")))
    return v.select("expert", "seq", "worker_version", F.explode(parts).alias("p")).select(
        "expert", "seq", "worker_version", "p.key", "p.delta")


_KEYED_SQL = """
SELECT expert, seq, worker_version, 'layer' || CAST(seq % 4 AS VARCHAR) || k AS key,
       CASE k WHEN '.lora_A' THEN delta[1:32] WHEN '.lora_B' THEN delta[33:64] ELSE delta END AS delta
FROM vector_pushes, (VALUES ('.lora_A'), ('.lora_B'), ('.base')) AS kk(k)"""


def _keyed_fold_sql(where: str = "TRUE", prefix: str = "") -> str:
    """CTEs of the keyed fold; ``{prefix}s`` holds the state, ``{prefix}c`` the versions."""
    p, d, e, c, s = (f"{prefix}{n}" for n in ("p", "d", "e", "c", "s"))
    return (f"{p} AS (SELECT expert, seq, any_value(worker_version) AS worker_version FROM keyed "
            f"WHERE contains(key, 'lora_') AND {where} GROUP BY expert, seq), "
            f"{_fold_cte(p, prefix=prefix)}, "
            f"{e} AS (SELECT k.expert, k.key, {d}.decay, unnest(k.delta) AS x, unnest(range(len(k.delta))) AS pos "
            f"FROM keyed k JOIN {d} USING (expert, seq) WHERE contains(k.key, 'lora_')), "
            f"{c} AS (SELECT expert, CAST(count(*) AS BIGINT) AS version FROM {d} GROUP BY expert), "
            f"{s} AS (SELECT expert, key, CAST(pos AS INTEGER) AS pos, coalesce(sum(1.0e0 * decay * x), 0.0) AS value "
            f"FROM {e} GROUP BY expert, key, pos)")


@register("keyed_fold", X.with_views(
    f"WITH {_keyed_fold_sql()} SELECT s.expert, c.version, s.key, s.pos, round(s.value, 6) AS value "
    f"FROM s JOIN c USING (expert)",
    vector_pushes=X.VECTOR_PUSHES_SQL, keyed=_KEYED_SQL))
def keyed_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5 + U10: per (expert, adapter key) decayed sums; base (non-adapter) keys filtered out."""
    f = U.fold_keyed(U.adapter_keys(keyed_log(spark, sf_dir)))
    return f.select("expert", "version", "key", "pos", F.round("value", 6).alias("value"))


def _keyed_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): the keyed state as of the log's midpoint seq, and at its end - of one fold, written once."""
    log = U.adapter_keys(keyed_log(spark, sf_dir))
    mid = log.agg(((F.min("seq") + F.max("seq")) / 2).cast("bigint")).scalar()   # scalar subquery
    both = cut_lineage(U.fold_keyed(log, before=mid))
    return both.where("value_before IS NOT NULL").drop("value").withColumnRenamed("value_before", "value"), both.drop("value_before")


_MID = "(SELECT CAST((min(seq) + max(seq)) // 2 AS BIGINT) FROM keyed)"


@register("state_diff", X.with_views(
    f"WITH {_keyed_fold_sql(f'seq <= {_MID}', 'b_')}, {_keyed_fold_sql('TRUE', 'a_')} "
    f"SELECT a.expert, a.key, a.pos, round(a.value - b.value, 6) AS value "
    f"FROM a_s a JOIN b_s b USING (expert, key, pos)",
    vector_pushes=X.VECTOR_PUSHES_SQL, keyed=_KEYED_SQL))
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter state at the end minus the state at the log's midpoint (common keys)."""
    before, after = _keyed_states(spark, sf_dir)
    keys = ["expert", "key", "pos"]
    d = U.state_diff(after, before, keys)
    return d.select(*keys, F.round("value", 6).alias("value"))


@register("state_apply", X.with_views(
    f"WITH {_keyed_fold_sql(f'seq <= {_MID}', 'b_')}, {_keyed_fold_sql('TRUE', 'a_')}, "
    f"df AS (SELECT a.expert, a.key, a.pos, a.value - b.value AS value FROM a_s a JOIN b_s b USING (expert, key, pos)) "
    f"SELECT coalesce(b.expert, df.expert) AS expert, coalesce(b.key, df.key) AS key, coalesce(b.pos, df.pos) AS pos, "
    f"round(coalesce(b.value, 0.0) + 1.0e0 * coalesce(df.value, 0.0), 6) AS value "
    f"FROM b_s b FULL OUTER JOIN df ON b.expert = df.expert AND b.key = df.key AND b.pos = df.pos",
    vector_pushes=X.VECTOR_PUSHES_SQL, keyed=_KEYED_SQL))
def state_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoint state + 1.0 x (end - midpoint) diff, full outer on keys (reproduces the end state)."""
    before, after = _keyed_states(spark, sf_dir)
    keys = ["expert", "key", "pos"]
    out = U.apply_delta(before, U.state_diff(after, before, keys), keys, alpha=1.0)
    return out.select(*keys, F.round("value", 6).alias("value"))


@register("version_curve", X.with_views("""
SELECT expert, step, CAST(sum(n) OVER (PARTITION BY expert ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS version,
       CAST(g AS BIGINT) AS global_version
FROM (SELECT expert, CAST(seq % 5 + 1 AS BIGINT) AS step, count(*) AS n FROM pushes GROUP BY 1, 2) a
JOIN (SELECT step, sum(gn) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
      FROM (SELECT CAST(seq % 5 + 1 AS BIGINT) AS step, count(*) AS gn FROM pushes GROUP BY 1) x) b USING (step)""",
    pushes=X.pushes_sql()))
def version_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: expert and global versions as of the end of each step (step = seq % 5 + 1)."""
    log = X.pushes(spark, sf_dir).withColumn("step", _step())
    return U.version_curve(log)


AS_OF = 120


@register("state_snapshot", X.with_views(f"""
{_fold_cte('pushes', where=_IN_REG)},
  f AS (SELECT expert, count(*) AS version, sum(1.0e0 * decay * delta) AS state FROM d GROUP BY expert)
SELECT reg.expert, CAST(coalesce(f.version, 0) AS BIGINT) AS version, round(coalesce(f.state, 0.0), 6) AS state
FROM {_REG_SQL} LEFT JOIN f ON f.expert = reg.expert
UNION ALL SELECT '*', CAST(count(*) AS BIGINT), round(coalesce(sum(1.0e0 * decay * delta), 0.0), 6) FROM d""", pushes=X.pushes_sql()))
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: weights and version of every registered expert and of the global state ('*'), now."""
    log = X.pushes(spark, sf_dir)
    every = U.snapshot(log, REGISTERED)
    whole = U.global_snapshot(log, REGISTERED).select(F.lit("*").alias("expert"), F.col("global_version").alias("version"),
                                                      F.col("global_state").alias("state"))
    return every.unionByName(whole).select("expert", "version", F.round("state", 6).alias("state"))


@register("state_as_of", X.with_views(f"""
{_fold_cte('vector_pushes', where=f"expert = '1' AND seq <= {AS_OF}")},
  e AS (SELECT decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  s AS (SELECT pos, coalesce(sum(1.0e0 * decay * x), 0.0) AS value FROM e GROUP BY pos)
SELECT '1' AS expert, (SELECT CAST(count(*) AS BIGINT) FROM d) AS version, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM s""",
    vector_pushes=X.VECTOR_PUSHES_SQL))
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: one expert's weights and version as they were after push 120."""
    st = U.snapshot(X.vector_pushes(spark, sf_dir), [str(i) for i in range(20)], expert="1", as_of=AS_OF)
    return st.select("expert", "version", "pos", F.round("value", 6).alias("value"))


def timed_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pushes, registrations): every 37th event of a type registers it (again and again), 'error' is never registered."""
    e = X.table(spark, sf_dir, "events")
    registers = F.col("event_id") % 37 == 5
    pushes = e.where(~registers).select(F.col("event_type").alias("expert"), F.col("event_id").alias("seq"), F.col("value").alias("delta"),
                                        (F.col("event_id") % 4).alias("worker_version"))
    return pushes, e.where(registers & (F.col("event_type") != "error")).select(F.col("event_type").alias("expert"), F.col("event_id").alias("seq"))


_TIMED_SQL = f"""
reg AS (SELECT event_type AS expert, min(event_id) AS first FROM events WHERE event_id % 37 = 5 AND event_type <> 'error' GROUP BY 1),
  late AS (SELECT event_type AS expert, event_id AS seq, value AS delta, event_id % 4 AS worker_version FROM events e JOIN reg ON reg.expert = e.event_type
           WHERE event_id % 37 <> 5 AND event_id > first),
  {_fold_cte('late')}"""


@register("timed_registration", "WITH " + _TIMED_SQL.strip() + """,
  f AS (SELECT expert, count(*) AS version, sum(1.0e0 * decay * delta) AS state FROM d GROUP BY expert)
SELECT reg.expert, CAST(coalesce(f.version, 0) AS BIGINT) AS version, round(coalesce(f.state, 0.0), 6) AS state
FROM reg LEFT JOIN f ON f.expert = reg.expert
UNION ALL SELECT '*', CAST(count(*) AS BIGINT), round(coalesce(sum(1.0e0 * decay * delta), 0.0), 6) FROM d""")
def timed_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 in time: pushes before their expert's first registration are dropped; versions count from 0 behind it."""
    log, registrations = timed_log(spark, sf_dir)
    every = U.expert_states_in_time(registrations, log)
    whole = U.global_scalar(log, registrations=registrations)
    rows = every.unionByName(whole.select(F.lit("*").alias("expert"), F.col("global_version").alias("version"), F.col("global_state").alias("state")))
    return rows.select("expert", "version", F.round("state", 6).alias("state"))


HISTORY_POINTS = [0, 57, 120, 199, 200, 333, 10**9]
HISTORY_CUT = 200               # the log is written up to here, then the rest is appended
_POINTS_SQL = "(VALUES " + ", ".join(f"({p})" for p in HISTORY_POINTS) + ") AS pt(as_of)"


def written_history(spark: SparkSession, sf_dir: str) -> str:
    log = X.vector_pushes(spark, sf_dir).select("expert", "seq", "worker_version", "delta")
    path = scratch_path(spark, "history")
    H.write_history(log.where(F.col("seq") < HISTORY_CUT), path, every=8)
    H.append_history(log.where(F.col("seq") >= HISTORY_CUT), path)
    return path


@register("state_history", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT expert, seq, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  m AS (SELECT DISTINCT expert, as_of FROM d CROSS JOIN {_POINTS_SQL} WHERE (as_of < {HISTORY_CUT} AND seq < {HISTORY_CUT}) OR as_of >= {HISTORY_CUT}),
  c AS (SELECT m.expert, as_of, count(d.seq) AS version FROM m LEFT JOIN d ON d.expert = m.expert AND d.seq <= as_of GROUP BY ALL),
  s AS (SELECT expert, as_of, pos, sum(1.0e0 * decay * x) AS value FROM e JOIN {_POINTS_SQL} ON seq <= as_of GROUP BY ALL)
SELECT CAST(c.as_of AS BIGINT) AS as_of, c.expert, CAST(version AS BIGINT) AS version, CAST(p.pos AS INTEGER) AS pos, round(coalesce(value, 0.0), 6) AS value
FROM c CROSS JOIN (SELECT unnest(range({COMBINE_DIM})) AS pos) p LEFT JOIN s ON s.expert = c.expert AND s.as_of = c.as_of AND s.pos = p.pos""",
    vector_pushes=X.VECTOR_PUSHES_SQL))
def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: all experts' weights and versions after each of several pushes, from a written history in one pass."""
    states = H.read_as_of(spark, written_history(spark, sf_dir), HISTORY_POINTS)
    return states.select("as_of", "expert", "version", F.posexplode("state").alias("pos", "value")).select(
        "as_of", "expert", "version", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


@register("global_history", X.with_views(f"""
{_fold_cte('vector_pushes')},
  e AS (SELECT seq, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d),
  s AS (SELECT as_of, pos, coalesce(sum(1.0e0 * decay * x), 0.0) AS value FROM e JOIN {_POINTS_SQL} ON seq <= as_of GROUP BY ALL)
SELECT CAST(as_of AS BIGINT) AS as_of, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value,
       (SELECT CAST(count(*) AS BIGINT) FROM d WHERE seq <= as_of) AS global_version FROM s""", vector_pushes=X.VECTOR_PUSHES_SQL))
def global_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8 + U3: the global weights and version after each of several pushes, from the same history."""
    states = H.global_as_of(spark, written_history(spark, sf_dir), HISTORY_POINTS)
    return states.select("as_of", "global_version", F.posexplode("global_state").alias("pos", "value")).select(
        "as_of", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"), "global_version")


def odd_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector log with cut deltas (seq % 7 = 3) and workers 20 versions ahead (seq % 11 = 5)."""
    return X.vector_pushes(spark, sf_dir).select(
        "expert", "seq", F.when(F.col("seq") % 7 == 3, F.slice("delta", 1, 32)).otherwise(F.col("delta")).alias("delta"),
        F.when(F.col("seq") % 11 == 5, F.col("cur") + 20).otherwise(F.col("worker_version")).alias("worker_version"))


_ODD_SQL = """
SELECT expert, seq, CASE WHEN seq % 7 = 3 THEN delta[1:32] ELSE delta END AS delta,
       CASE WHEN seq % 11 = 5 THEN cur + 20 ELSE worker_version END AS worker_version FROM vector_pushes"""
_REASON_SQL = f"CASE WHEN decay IS NULL THEN 'undefined decay' WHEN len(delta) <> {COMBINE_DIM} THEN 'wrong shape' END"


@register("push_rejects", X.with_views(f"""
{_fold_cte('odd')} SELECT expert, seq, {_REASON_SQL} AS reason FROM d WHERE {_REASON_SQL} IS NOT NULL""",
    vector_pushes=X.VECTOR_PUSHES_SQL, odd=_ODD_SQL))
def push_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes that count but add nothing - undefined decay, wrong shape - with the reason."""
    return U.rejected(odd_pushes(spark, sf_dir), dim=COMBINE_DIM)


@register("odd_fold", X.with_views(f"""
{_fold_cte('odd')},
  e AS (SELECT expert, decay, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM d WHERE {_REASON_SQL} IS NULL),
  s AS (SELECT expert, pos, sum(1.0e0 * decay * x) AS value FROM e GROUP BY expert, pos),
  c AS (SELECT expert, CAST(count(*) AS BIGINT) AS version FROM d GROUP BY expert)
SELECT c.expert, c.version, CAST(p.pos AS INTEGER) AS pos, round(coalesce(s.value, 0.0), 6) AS value
FROM c CROSS JOIN (SELECT unnest(range({COMBINE_DIM})) AS pos) p LEFT JOIN s ON s.expert = c.expert AND s.pos = p.pos""",
    vector_pushes=X.VECTOR_PUSHES_SQL, odd=_ODD_SQL))
def odd_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 over the log with odd pushes: they raise the version, add nothing and stop nobody else."""
    f = U.fold_vectors(odd_pushes(spark, sf_dir), dim=COMBINE_DIM)
    return f.select("expert", "version", "pos", F.round("value", 6).alias("value"))


@register("staleness_profile", X.with_views(f"""
{_fold_cte('pushes')}
SELECT expert, CAST(count(*) AS BIGINT) AS pushes, avg(staleness) AS avg_staleness,
       CAST(max(staleness) AS BIGINT) AS max_staleness, round(avg(decay), 9) AS avg_decay, min(decay) AS min_decay,
       CAST(sum(CASE WHEN staleness < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_staleness
FROM d GROUP BY expert""", pushes=X.pushes_sql()))
def staleness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staleness and decay statistics per expert."""
    return rounded(U.staleness_profile(X.pushes(spark, sf_dir)), "avg_decay")   # mean of ~N doubles


@register("federated_vs_isolated", X.with_views(f"""
{_fold_cte('pushes', part='run, expert')},
  ex AS (SELECT run, 'expert' AS scope, expert, CAST(count(*) AS BIGINT) AS version,
                round(sum(1.0e0 * decay * delta), 6) AS state FROM d GROUP BY run, expert),
  gl AS (SELECT run, 'global' AS scope, '*' AS expert, CAST(count(*) AS BIGINT) AS version,
                round(sum(1.0e0 * decay * delta), 6) AS state FROM d WHERE run = 'federated' GROUP BY run)
SELECT * FROM ex UNION ALL SELECT * FROM gl""", pushes=X.pushes_sql(run_by_worker=True)))
def federated_vs_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-run expert folds; only the federated run feeds a global state."""
    log = X.pushes(spark, sf_dir, run_by_worker=True)
    ex = U.fold_scalar(log, keys=["run", "expert"]).select(
        "run", F.lit("expert").alias("scope"), "expert", "version", F.round("state", 6).alias("state"))
    gl = U.global_scalar(log.filter(F.col("run") == "federated"), keys=["run", "expert"]).select(
        F.lit("federated").alias("run"), F.lit("global").alias("scope"), F.lit("*").alias("expert"),
        F.col("global_version").alias("version"), F.round("global_state", 6).alias("state"))
    return ex.unionByName(gl)


@register("round_metrics", X.with_views(f"""
q AS (SELECT run, step, avg(score) AS avg_exact_match, avg(exec_pass) AS avg_execution_pass_rate FROM eval_score GROUP BY run, step),
  ps AS (SELECT *, CAST(seq % 5 + 1 AS BIGINT) AS step FROM pushes),
  cm AS (SELECT step, CAST(count(*) * 4 AS DOUBLE) AS total_communication_bytes, CAST(count(*) AS BIGINT) AS num_updates FROM ps GROUP BY step),
  ev AS (SELECT expert, step, sum(n) OVER (PARTITION BY expert ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version
         FROM (SELECT expert, step, count(*) AS n FROM ps GROUP BY 1, 2) a),
  vs AS (SELECT step, string_agg(expert || ':' || CAST(version AS VARCHAR), ',' ORDER BY expert) AS expert_versions FROM ev GROUP BY step),
  gv AS (SELECT step, CAST(sum(num_updates) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS gateway_version FROM cm)
SELECT q.run, q.step, round(q.avg_exact_match, 9) AS avg_exact_match,
       round(q.avg_execution_pass_rate, 9) AS avg_execution_pass_rate,
       round((q.avg_exact_match + q.avg_execution_pass_rate) / 2, 9) AS avg_code_quality,
       coalesce(cm.total_communication_bytes, 0.0) AS total_communication_bytes,
       CAST(coalesce(cm.num_updates, 0) AS BIGINT) AS num_updates, vs.expert_versions, gv.gateway_version
FROM q LEFT JOIN cm USING (step) LEFT JOIN vs USING (step) LEFT JOIN gv USING (step)""",
    eval_score=X.EVAL_SCORE_SQL, pushes=X.pushes_sql()))
def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + A11: per (run, step) macro quality joined with the update log's communication,
    update count, expert versions and global version as of that step."""
    scores = X.eval_score(spark, sf_dir)
    q = scores.groupBy("run", "step").agg(F.avg("score").alias("avg_exact_match"),
                                          F.avg("exec_pass").alias("avg_execution_pass_rate"))
    log = X.pushes(spark, sf_dir).withColumn("step", _step())
    comm = U.communication(log)
    curve = U.version_curve(log)
    vs = curve.groupBy("step").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("expert", F.lit(":"), F.col("version").cast("string")))),
                     ",").alias("expert_versions"),
        F.max("global_version").alias("gateway_version"))
    out = (q.join(comm, "step", "left").join(vs, "step", "left")
            .select("run", "step", "avg_exact_match", "avg_execution_pass_rate",
                    ((F.col("avg_exact_match") + F.col("avg_execution_pass_rate")) / 2).alias("avg_code_quality"),
                    F.coalesce("total_communication_bytes", F.lit(0.0)).alias("total_communication_bytes"),
                    F.coalesce("num_updates", F.lit(0)).cast("bigint").alias("num_updates"),
                    "expert_versions", "gateway_version"))
    return rounded(out, "avg_exact_match", "avg_execution_pass_rate", "avg_code_quality")


