"""Update-log aggregation (U1-U8, U10-U12): a staleness-aware parameter server as a fold.

Each accepted push raises its expert's version by one, so the version a push
meets is its position in the expert's log minus one, and the final state is
``sum(SERVER_LR * decay_i * delta_i)`` with ``decay_i = 1 / (1 + 0.1 * staleness_i)``.
No iteration is needed:

* positions come from :func:`corpusfold.operators.sequence.running_rank` over the
  narrow columns (range-partitioned, so a hot expert is not one window task);
* vectors meet their decay in one join and are summed whole by one ``groupBy`` that
  also counts the versions (Spark ML ``Summarizer.sum`` weighted by the decay: one
  running vector per group and map task); only final sums become rows
  ``(expert, pos, value)``;
* the global fold sums the same weighted vectors in salted groups, then merges those.

A push counts as a push even where it adds nothing: if ``1 + 0.1 * staleness`` is
not positive (a worker 10 or more versions ahead) its decay is undefined, and a
vector of another length than its group's shape cannot be added. :func:`rejected`
returns those pushes with the reason. A group's shape is given, or that of its
first push.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.functions import rules as R
from corpusfold.operators.sequence import running_rank
from corpusfold.session import cut_lineage


# ------------------------------------------------------------------ registry

def registry(spark, experts: Sequence[str]) -> DataFrame:
    """Registered experts; re-registration is a no-op."""
    return spark.createDataFrame([(e,) for e in dict.fromkeys(experts)], "expert string")


def accepted(log: DataFrame, reg: DataFrame | Sequence[str], keys: Sequence[str] = ("expert",)) -> DataFrame:
    """Pushes for unknown experts are dropped silently.

    A registry given as a list (bounded by its length) is an ``isin`` filter that
    Catalyst pushes into the scan; a registry DataFrame of unknown size is a left
    semi join (AQE broadcasts it at runtime when it turns out small).
    """
    if isinstance(reg, (list, tuple)):
        return log.filter(F.col(keys[0]).isin(list(dict.fromkeys(reg))))
    return log.join(reg, on=list(keys), how="left_semi")


def first_registrations(registrations: DataFrame, keys: Sequence[str] = ("expert",), order: str = "seq") -> DataFrame:
    """(keys, order) of each expert's first registration; later ones change nothing (one narrow aggregation)."""
    return registrations.groupBy(*keys).agg(F.min(order).alias(order)).where(F.col(order).isNotNull())


def accepted_in_time(log: DataFrame, registrations: DataFrame, keys: Sequence[str] = ("expert",), order: str = "seq") -> DataFrame:
    """The pushes behind their expert's first registration in the log of registrations (keys, order).

    A push before it is dropped silently, as if it had never come; a registration at
    the place of a push comes first. The first registrations and the narrow pushes are
    merged by one range sort (a hot expert takes many partitions); nothing is compared
    pair by pair. Pushes or registrations without ``order`` have no place in time: the
    former are dropped, the latter ignored.
    """
    keys = list(keys)
    if any(_is_wide(t) for _c, t in log.dtypes):
        pushes = log.select(*keys, order).distinct()
        return log.join(_behind_registration(pushes, registrations, keys, order).select(*keys, order), [*keys, order], "left_semi")
    return _behind_registration(log, registrations, keys, order).drop("_cf_pos", "_cf_first")


def _behind_registration(narrow: DataFrame, registrations: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Narrow pushes behind the first registration, with ``_cf_pos`` and ``_cf_first`` (its position)."""
    firsts = first_registrations(registrations, keys, order).withColumn("_cf_reg", F.lit(True))
    both = narrow.where(F.col(order).isNotNull()).withColumn("_cf_reg", F.lit(False)).unionByName(firsts, allowMissingColumns=True)
    ranked = running_rank(both, keys, order, out="_cf_pos", mark="_cf_reg", mark_out="_cf_first")
    return ranked.where(~F.col("_cf_reg") & (F.col("_cf_pos") > F.col("_cf_first"))).drop("_cf_reg")


# -------------------------------------------------------------------- decay

def decay(staleness: Column) -> Column:
    """F16: ``1 / (1 + STALENESS_DECAY * staleness)``; null where the denominator is not positive."""
    den = F.lit(1.0) + F.lit(R.STALENESS_DECAY) * staleness.cast("double")
    return F.when(den > 0, F.lit(1.0) / den)


def _is_wide(dtype: str) -> bool:
    return dtype.startswith(("array", "map", "struct", "binary"))


def with_versions(log: DataFrame, keys: Sequence[str] = ("expert",), order: str = "seq",
                  base: DataFrame | None = None, registrations: DataFrame | None = None) -> DataFrame:
    """Add ``version`` (the version the push meets), ``staleness`` and ``decay``.

    ``base`` (keys, version) holds the versions reached before this log (none: 0).
    ``registrations`` (keys, order) drops pushes before their expert's first
    registration in the same sort (see :func:`accepted_in_time`).

    Narrow logs are numbered in place. When rows carry deltas (arrays), only
    ``(keys, seq, worker_version)`` - one row per push - is ranked, and the decay is
    joined back on ``(keys, seq)``: vectors are never sorted, and several rows of one
    push (named tensors) share its version.
    """
    keys = list(keys)

    def decorate(ranked: DataFrame) -> DataFrame:
        before = F.lit(0)
        if base is not None:
            ranked = ranked.join(base.select(*keys, F.col("version").alias("_cf_base")), keys, "left")
            before = F.coalesce("_cf_base", F.lit(0))
        return (ranked.withColumn("version", F.col("_cf_pos") - 1 + before).drop("_cf_pos", "_cf_base")
                .withColumn("staleness", F.col("version") - F.col("worker_version"))
                .withColumn("decay", decay(F.col("staleness"))))

    def positions(narrow: DataFrame) -> DataFrame:
        if registrations is None:
            return running_rank(narrow, keys, order, out="_cf_pos")
        behind = _behind_registration(narrow, registrations, keys, order)
        return behind.withColumn("_cf_pos", F.col("_cf_pos") - F.col("_cf_first")).drop("_cf_first")

    if not any(_is_wide(t) for _c, t in log.dtypes):
        return decorate(positions(log))
    pushes = log.select(*keys, order, "worker_version").dropDuplicates([*keys, order])
    ranked = decorate(positions(pushes))
    return log.drop("worker_version").join(ranked, on=[*keys, order], how="inner")


def _weight() -> Column:
    return F.lit(R.SERVER_LR) * F.col("decay")


# ----------------------------------------------------------- scalar deltas

def fold_scalar(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta",
                registrations: DataFrame | None = None) -> DataFrame:
    """U2 for scalar deltas: per key the version reached and the decayed sum."""
    v = with_versions(log, keys, registrations=registrations)
    return v.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("version"),
                                F.coalesce(F.sum(_weight() * F.col(delta)), F.lit(0.0)).alias("state"))


def expert_states(reg: DataFrame | Sequence[str], log: DataFrame, delta: str = "delta") -> DataFrame:
    """U1 + U2: registered experts with their folded state; never-pushed experts at version 0, state 0."""
    folded = fold_scalar(accepted(log, reg), delta=delta)
    reg_df = registry(log.sparkSession, reg) if isinstance(reg, (list, tuple)) else reg
    return (reg_df.join(folded, "expert", "left")
            .select("expert", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"),
                    F.coalesce("state", F.lit(0.0)).alias("state")))


def expert_states_in_time(registrations: DataFrame, log: DataFrame, delta: str = "delta") -> DataFrame:
    """U1 + U2: every expert of the log of registrations (expert, seq) with its state; version 0 and state 0 without pushes behind it."""
    folded = fold_scalar(log, delta=delta, registrations=registrations)
    return (first_registrations(registrations).select("expert").join(folded, "expert", "left")
            .select("expert", F.coalesce("version", F.lit(0)).cast("bigint").alias("version"),
                    F.coalesce("state", F.lit(0.0)).alias("state")))


def global_scalar(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta",
                  registrations: DataFrame | None = None) -> DataFrame:
    """Every accepted push also lands on the global state with weight 1/1 (single-expert batch)."""
    v = with_versions(log, keys, registrations=registrations)
    return v.agg(F.count(F.lit(1)).cast("bigint").alias("global_version"),
                 F.coalesce(F.sum(_weight() * F.col(delta)), F.lit(0.0)).alias("global_state"))


# ----------------------------------------------------------- vector deltas

GLOBAL_SALTS = 64


def shapes(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta", dim: int | None = None,
           order: str = "seq") -> DataFrame:
    """(keys, dim): each group's vector length - ``dim`` if given, else that of its first push (one narrow aggregation)."""
    first = F.lit(dim) if dim is not None else F.min_by(F.size(delta), F.struct(order, F.size(delta)))
    return log.groupBy(*keys).agg(first.cast("int").alias("dim"))


def _judged(log: DataFrame, groups: Sequence[str], version_keys: Sequence[str], delta: str, dim: int | None,
            state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pushes with decay, ``dim`` and ``reason`` - null if the push adds to the state -, shapes).

    ``state`` (groups, version, dim) holds what earlier pushes have set.
    """
    groups = list(groups)
    known = shapes(log, groups, delta, dim)
    if state is not None:
        known = known.join(state.select(*groups, F.col("dim").alias("_cf_dim")), groups, "left").select(
            *groups, F.coalesce("_cf_dim", "dim").alias("dim"))
    known = cut_lineage(known)
    v = with_versions(log, version_keys, base=state)
    v = v.join(known, groups) if groups else v.withColumn("dim", known.scalar())
    reason = F.when(F.col("decay").isNull(), "undefined decay").when(
        ~F.size(delta).eqNullSafe(F.col("dim")), "wrong shape").otherwise(F.lit(None).cast("string"))
    return v.withColumn("reason", reason), known


def judged_scalars(log: DataFrame, state: DataFrame | None = None, delta: str = "delta") -> DataFrame:
    """Scalar pushes as vectors of one number, judged alike: only an undefined decay keeps one from adding (a null adds 0)."""
    v = with_versions(log, ["expert"], base=state)
    reason = F.when(F.col("decay").isNull(), "undefined decay").otherwise(F.lit(None).cast("string"))
    return v.withColumns({delta: F.array(F.coalesce(F.col(delta).cast("double"), F.lit(0.0))), "dim": F.lit(1), "reason": reason})


def rejected(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta", dim: int | None = None) -> DataFrame:
    """(keys, seq, reason) of the pushes that count but add nothing."""
    v, _ = _judged(log, keys, keys, delta, dim)
    return v.where("reason IS NOT NULL").select(*keys, "seq", "reason")


def _vector_rows(v: DataFrame, known: DataFrame, groups: Sequence[str], delta: str, *extra: Column) -> DataFrame:
    """Rows to sum: (groups, vector, weight, push) - pushes that add nothing bring zeros, and each group has one more row of zeros."""
    ok = F.col("reason").isNull()
    zeros = F.expr("array_repeat(0.0D, dim)")
    pushes = v.select(*groups, *extra, F.when(ok, F.col(delta).cast("array<double>")).otherwise(zeros).alias("vector"),
                      F.when(ok, _weight()).otherwise(1.0).alias("weight"), F.lit(1).alias("push"))
    nothing = [F.lit(0).alias(c) for c in pushes.columns[len(list(groups)):-3]]
    return pushes.unionByName(known.select(*groups, *nothing, zeros.alias("vector"), F.lit(1.0).alias("weight"), F.lit(0).alias("push")))


def _sum_vectors() -> Column:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(F.col("vector")), F.col("weight")))


def _norm(values: str) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))


def _vector_state(rows: DataFrame, groups: Sequence[str], method: str) -> DataFrame:
    """(groups, version, values) by one aggregation."""
    groups = list(groups)
    if method == "summarizer":
        return rows.groupBy(*groups).agg(F.sum("push").cast("bigint").alias("version"), _sum_vectors().alias("values"))
    if method != "explode":
        raise ValueError(f"unknown method {method!r}")
    long = rows.select(*groups, "push", "weight", F.posexplode("vector").alias("pos", "x")).groupBy(*groups, "pos").agg(
        F.sum("push").cast("bigint").alias("version"), F.sum(F.col("weight") * F.col("x")).alias("value"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))       # a group's positions: its shape bounds them
    return long.groupBy(*groups).agg(F.max("version").alias("version"), F.transform(packed, lambda e: e["value"]).alias("values"))


def fold_vectors(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta",
                 method: str = "summarizer", dim: int | None = None) -> DataFrame:
    """U2 for array deltas: long-form state ``(keys..., version, pos, value, l2_norm)`` (F15: the norm of the whole state)."""
    v, known = _judged(log, keys, keys, delta, dim)
    state = _vector_state(_vector_rows(v, known, keys, delta), keys, method)
    return (state.withColumn("l2_norm", _norm("values"))
            .select(*keys, "version", F.posexplode("values").alias("pos", "value"), "l2_norm")
            .select(*keys, "version", F.col("pos").cast("int").alias("pos"), "value", "l2_norm"))


def global_vectors(log: DataFrame, keys: Sequence[str] = ("expert",), delta: str = "delta",
                   method: str = "summarizer", dim: int | None = None) -> DataFrame:
    """U3 for array deltas: position-wise decayed sum over every push; the global shape is given or the first push's."""
    v, known = _judged(log.where("true"), [], keys, delta, dim)
    known = known.where("dim IS NOT NULL")
    salt = F.pmod(F.xxhash64("seq"), F.lit(GLOBAL_SALTS)).cast("int").alias("salt")
    partial = _vector_state(_vector_rows(v, known, [], delta, salt), ["salt"], method)
    merged = partial.select(F.lit(0).alias("all"), F.col("version").alias("push"), F.col("values").alias("vector"), F.lit(1.0).alias("weight"))
    state = _vector_state(merged, ["all"], method)
    return state.select(F.col("version").alias("global_version"), F.posexplode("values").alias("pos", "value")).select(
        F.col("pos").cast("int").alias("pos"), "value", "global_version")


def fold_onto(state: DataFrame | None, log: DataFrame, delta: str = "delta", dim: int | None = None) -> DataFrame:
    """(expert, version, state) after the pushes of ``log`` on top of ``state`` (same columns; None: nothing yet)."""
    if not _is_wide(dict(log.dtypes)[delta]):
        v = with_versions(log, ["expert"], base=state)
        new = v.select("expert", F.lit(1).alias("push"), F.coalesce(_weight() * F.col(delta), F.lit(0.0)).alias("x"))
        if state is not None:
            new = new.unionByName(state.select("expert", F.col("version").alias("push"), F.col("state").alias("x")))
        return new.groupBy("expert").agg(F.sum("push").cast("bigint").alias("version"), F.sum("x").alias("state"))
    held = None if state is None else state.withColumn("dim", F.size("state"))
    v, known = _judged(log, ["expert"], ["expert"], delta, dim, held)
    rows = _vector_rows(v, known, ["expert"], delta)
    if state is not None:
        rows = rows.unionByName(state.select("expert", F.col("state").alias("vector"), F.lit(1.0).alias("weight"), F.col("version").alias("push")))
    return _vector_state(rows, ["expert"], "summarizer").withColumnRenamed("values", "state")


# ------------------------------------------------------------------ snapshots

def _known(expert: str | None, reg: Sequence[str]) -> list[str]:
    """The experts a read is about; an unknown one is an error."""
    if expert is not None and expert not in reg:
        raise KeyError(f"unknown expert {expert!r}")
    return list(dict.fromkeys(reg)) if expert is None else [expert]


def snapshot(log: DataFrame, reg: Sequence[str], expert: str | None = None, as_of: int | Column | None = None,
             delta: str = "delta", dim: int | None = None) -> DataFrame:
    """U8: weights and version of one expert (or all registered ones), now or after the push ``as_of``.

    A push's version depends on earlier pushes only, so the log up to ``as_of`` gives
    the state of that moment. Scalar logs give (expert, version, state); vector logs
    (expert, version, pos, value, l2_norm), with zeros for experts without a push if
    ``dim`` is given.
    """
    who = _known(expert, reg)
    log = accepted(log, who)
    if as_of is not None:
        log = log.filter(F.col("seq") <= as_of)
    if not _is_wide(dict(log.dtypes)[delta]):
        return expert_states(who, log, delta)
    state = fold_vectors(log, delta=delta, dim=dim)
    if dim is None:
        return state
    silent = registry(log.sparkSession, who).join(log.select("expert").distinct(), "expert", "left_anti")
    zeros = silent.select("expert", F.lit(0).cast("bigint").alias("version"),
                          F.posexplode(F.array_repeat(F.lit(0.0), dim)).alias("pos", "value"))
    return state.unionByName(zeros.withColumn("l2_norm", F.lit(0.0)))


def global_snapshot(log: DataFrame, reg: Sequence[str], as_of: int | Column | None = None, delta: str = "delta",
                    dim: int | None = None) -> DataFrame:
    """U8: the global state and version, now or after the push ``as_of``."""
    log = accepted(log, list(reg))
    if as_of is not None:
        log = log.filter(F.col("seq") <= as_of)
    return global_vectors(log, delta=delta, dim=dim) if _is_wide(dict(log.dtypes)[delta]) else global_scalar(log, delta=delta)


# ------------------------------------------------------------- batch combine

def batch_combine(batches: DataFrame, dim: int, strategy: str = "weighted_average",
                  batch: str = "batch", delta: str = "delta") -> tuple[DataFrame, DataFrame]:
    """U4: combine per-batch expert deltas into one global state.

    Input rows ``(batch, expert, delta)`` with one row per (batch, expert). Per
    batch, ``weighted_average`` weighs each update 1/N (N counts every expert of
    the batch, including those whose shape is wrong and are skipped); ``sum``
    weighs 1. Every non-empty batch raises the version by one; an unknown
    strategy changes only the version. Returns ``(state, contributions)``:
    state rows ``(pos, value, version)`` and the last weight recorded per
    accepted expert.
    """
    counts = cut_lineage(batches.groupBy(batch).agg(F.count(F.lit(1)).alias("_cf_n")))      # narrow: no vector is buffered
    sized = batches.join(counts, batch)
    version = counts.agg(F.count(F.lit(1)).cast("bigint")).scalar()   # scalar subquery
    if strategy == "weighted_average":
        weight = F.lit(1.0) / F.col("_cf_n")
    elif strategy == "sum":
        weight = F.lit(1.0)
    else:
        weight = None
    ok = sized.filter(F.size(delta) == F.lit(dim))
    if weight is None:
        zeros = batches.sparkSession.range(dim).select(F.col("id").cast("int").alias("pos"),
                                                       F.lit(0.0).alias("value"))
        contrib = ok.limit(0).select("expert", F.lit(0.0).alias("weight"))
        return zeros.withColumn("version", version), contrib
    ok = ok.withColumn("weight", weight)
    state = (ok.select("weight", F.posexplode(delta).alias("pos", "x"))
             .groupBy("pos").agg(F.sum(F.lit(R.SERVER_LR) * F.col("weight") * F.col("x")).alias("value"))
             .select(F.col("pos").cast("int").alias("pos"), "value", version.alias("version")))
    contrib = ok.groupBy("expert").agg(F.max_by("weight", batch).alias("weight"))
    return state, contrib


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, value_cols: Sequence[str]) -> DataFrame:
    """Keep the last row (by ``order``) per key, as a dict built in order would: ``max_by`` per column
    (partial aggregation, no window over a key)."""
    packed = F.struct(*[F.col(c) for c in value_cols])
    return (df.groupBy(*keys).agg(F.max_by(packed, order).alias("_cf_last"))
            .select(*keys, *[F.col("_cf_last")[c].alias(c) for c in value_cols]))


# ---------------------------------------------------------------- keyed fold

def adapter_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Keep adapter parameters (names containing ``lora_``)."""
    return df.filter(F.col(key).contains("lora_"))


def fold_keyed(log: DataFrame, key: str = "key", delta: str = "delta", method: str = "summarizer",
               before: int | Column | None = None) -> DataFrame:
    """Per (expert, parameter name) decayed sums; the version counts pushes (distinct seq),
    not key rows. A key absent from the state is inserted by the grouping itself.

    ``before`` adds the column ``value_before``: the state after that push (null for a
    key without a push by then), from the same aggregation.
    """
    groups = ["expert", key]
    v, known = _judged(log, groups, ["expert"], delta, None)
    versions = log.groupBy("expert").agg(F.countDistinct("seq").cast("bigint").alias("version"))
    if before is None:
        state = _vector_state(_vector_rows(v, known, groups, delta), groups, method).drop("version")
        out = state.select(*groups, F.posexplode("values").alias("pos", "value"))
        last = ["value"]
    else:
        early = (F.col("seq") <= before).cast("int").alias("early")
        rows = _vector_rows(v, known, groups, delta, early)
        both = _vector_state(rows, [*groups, "early"], method)
        at = lambda e, c: F.max(F.when(F.col("early") == e, F.col(c)))
        both = both.groupBy(*groups).agg(at(1, "values").alias("b"), at(0, "values").alias("a"))
        parts = F.arrays_zip(F.coalesce("b", "a").alias("x"), "a", "b")
        out = both.select(*groups, F.posexplode(parts).alias("pos", "z")).select(
            *groups, "pos", (F.coalesce("z.a", F.lit(0.0)) + F.coalesce("z.b", F.lit(0.0))).alias("value"), F.col("z.b").alias("value_before"))
        last = ["value", "value_before"]
    return out.join(versions, "expert").select("expert", "version", key, F.col("pos").cast("int").alias("pos"), *last)


def state_diff(after: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``after - before`` over the keys present in both."""
    a = after.select(*keys, F.col("value").alias("_a"))
    b = before.select(*keys, F.col("value").alias("_b"))
    return a.join(b, list(keys), "inner").select(*keys, (F.col("_a") - F.col("_b")).alias("value"))


def apply_delta(state: DataFrame, delta: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """``state + alpha * delta``; keys only in the delta are inserted, untouched keys kept."""
    s = state.select(*keys, F.col("value").alias("_s"))
    d = delta.select(*keys, F.col("value").alias("_d"))
    return s.join(d, list(keys), "full_outer").select(
        *keys, (F.coalesce("_s", F.lit(0.0)) + F.lit(alpha) * F.coalesce("_d", F.lit(0.0))).alias("value"))


# --------------------------------------------------------- snapshots, profile

def version_curve(log: DataFrame, step: str = "step", keys: Sequence[str] = ("expert",)) -> DataFrame:
    """U8: version of each expert as of the end of each step, and the global version.

    Counts are aggregated per (expert, step) first; the running sum runs over
    that small table.
    """
    per = log.groupBy(*keys, step).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("version", F.sum("_n").over(w).cast("bigint"))
    g = log.groupBy(step).agg(F.count(F.lit(1)).alias("_g"))
    wg = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)   # one row per step
    g = g.withColumn("global_version", F.sum("_g").over(wg).cast("bigint")).drop("_g")
    return per.drop("_n").join(g, step).select(*keys, step, "version", "global_version")


def staleness_profile(log: DataFrame, keys: Sequence[str] = ("expert",),
                      percentiles: Sequence[float] | None = None) -> DataFrame:
    """Staleness and decay per expert (the numbers the reference prints per push);
    ``percentiles`` adds approximate staleness quantiles (``percentile_approx``, mergeable
    sketches, so a hot expert is still aggregated map-side)."""
    v = with_versions(log, keys)
    extra = []
    if percentiles:
        extra.append(F.percentile_approx("staleness", list(percentiles)).alias("staleness_percentiles"))
    return v.groupBy(*keys).agg(*extra,
        F.count(F.lit(1)).cast("bigint").alias("pushes"),
        F.avg("staleness").alias("avg_staleness"),
        F.max("staleness").cast("bigint").alias("max_staleness"),
        F.avg("decay").alias("avg_decay"),
        F.min("decay").alias("min_decay"),
        F.sum((F.col("staleness") < 0).cast("int")).cast("bigint").alias("negative_staleness"))


def communication(log: DataFrame, step: str = "step", delta: str = "delta",
                  bytes_per_value: int = R.BYTES_PER_VALUE) -> DataFrame:
    """Bytes and updates per step (values per push x bytes per value)."""
    values = F.size(delta) if dict(log.dtypes).get(delta, "").startswith("array") else F.lit(1)
    return log.groupBy(step).agg(
        (F.sum(values) * F.lit(bytes_per_value)).cast("double").alias("total_communication_bytes"),
        F.count(F.lit(1)).cast("bigint").alias("num_updates"))
