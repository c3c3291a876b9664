"""Continuous staleness-decayed fold with Structured Streaming, as incremental keyed state.

Pushes arrive as files (``files_per_trigger`` of them a micro-batch, later files
holding later ``seq``). The state is a folder of tables:

* ``delta/batch=i``: what micro-batch ``i`` *added* - one row per expert it touched
  (pushes, dimension, summed vector) and one for the global state (U3);
* ``seen/batch=i``: (expert, seq) of the pushes it took;
* ``base/upto=i``: everything added by the batches up to ``i``, compacted.

Sums are all a later push needs, so a micro-batch reads no vectors of earlier ones:
only the versions and dimensions of the experts it touches, from the buckets that
hold them. Its own pushes are ranked and summed by the batch operator's rules
(:mod:`corpusfold.operators.updates`), so a hot expert takes as many tasks as in the
batch fold and the result equals it on the same log. Every ``compact_every`` batches
the base and the deltas behind it become a new base.

Exactly once. A table counts when its ``_COMMITTED`` mark is there, which is written
last. A micro-batch that is run again finds the same earlier state and overwrites its
own tables; a compaction that died is ignored and made again later. The base before
the last one and all behind it are kept, so that the last batch can be run again even
after its compaction; older tables are removed. A push that comes again within
``horizon`` batches - in the same micro-batch, or a file delivered twice under another
name - is ignored; beyond that it counts anew. Offsets live in the checkpoint
location, and a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators import updates as U
from corpusfold.session import cut_lineage, list_names, mark_path, path_exists, remove_path

PUSH_SCHEMA = "expert string, seq bigint, worker_version bigint, delta double"
# Vector deltas (adapter matrices flattened row-major): the state is the position-wise sum.
VECTOR_PUSH_SCHEMA = "expert string, seq bigint, worker_version bigint, delta array<double>"
REGISTRATION_SCHEMA = "expert string, seq bigint"

BUCKETS = 32
COMPACT_EVERY = 16
HORIZON = 64
_ADDED = "scope string, expert string, n bigint, dim int, scalar boolean, vector array<double>, bucket int"
_SEEN = "expert string, seq bigint"
_MARK = "_COMMITTED"


# ------------------------------------------------------------------- the store

_GLOBAL_BUCKET = 0


def _bucket() -> Column:
    return F.pmod(F.xxhash64("expert"), F.lit(BUCKETS)).cast("int")


def _placed(added: DataFrame) -> DataFrame:
    return added.withColumn("bucket", F.when(F.col("scope") == "global", F.lit(_GLOBAL_BUCKET)).otherwise(_bucket()))


def _numbers(spark: SparkSession, sink_dir: str, kind: str, name: str) -> list[int]:
    """Numbers of the committed tables of a kind, ascending (directory names only)."""
    found = [int(x.split("=")[1]) for x in list_names(spark, f"{sink_dir}/{kind}") if x.startswith(f"{name}=")]
    return sorted(n for n in found if path_exists(spark, f"{sink_dir}/{kind}/{name}={n}/{_MARK}"))


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = (df.repartition(by) if by else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    mark_path(df.sparkSession, f"{path}/{_MARK}")


def _added(spark: SparkSession, sink_dir: str, before: int | None = None, base_before: int | None = None) -> DataFrame | None:
    """All that counts before micro-batch ``before`` (None: by now): the last base (before ``base_before``) and the deltas behind it."""
    early = lambda n: before is None or n < before
    bases = [n for n in _numbers(spark, sink_dir, "base", "upto") if early(n) and (base_before is None or n < base_before)]
    base = bases[-1] if bases else -1
    paths = [f"{sink_dir}/delta/batch={n}" for n in _numbers(spark, sink_dir, "delta", "batch") if n > base and early(n)]
    paths += [f"{sink_dir}/base/upto={base}"] if bases else []
    parts = [spark.read.schema(_ADDED).parquet(p) for p in paths]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _merged(added: DataFrame) -> DataFrame:
    """One row per (scope, expert): pushes and vectors summed."""
    return (added.withColumn("weight", F.lit(1.0)).groupBy("scope", "expert")
            .agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), F.max("scalar").alias("scalar"), U._sum_vectors().alias("vector")))


def compact(spark: SparkSession, sink_dir: str, upto: int) -> None:
    """Make the base of the batches up to ``upto`` and remove what neither it nor the base before it needs."""
    earlier = [n for n in _numbers(spark, sink_dir, "base", "upto") if n < upto]
    added = _added(spark, sink_dir, upto + 1, upto)
    if added is None:
        return
    _write(_placed(_merged(added)), f"{sink_dir}/base/upto={upto}", "bucket")
    if earlier:
        for n in _numbers(spark, sink_dir, "delta", "batch"):
            if n <= earlier[-1]:
                remove_path(spark, f"{sink_dir}/delta/batch={n}")
        for n in earlier[:-1]:
            remove_path(spark, f"{sink_dir}/base/upto={n}")


# -------------------------------------------------------------- a micro-batch

def _new_pushes(batch: DataFrame, sink_dir: str, batch_id: int, horizon: int) -> DataFrame:
    """The pushes of a micro-batch, each once, without those taken in the last ``horizon`` batches."""
    spark = batch.sparkSession
    pushes = batch.dropDuplicates(["expert", "seq"])
    last = [n for n in _numbers(spark, sink_dir, "seen", "batch") if batch_id - horizon <= n < batch_id]
    if not last:
        return pushes
    seen = spark.read.schema(_SEEN).parquet(*[f"{sink_dir}/seen/batch={n}" for n in last])
    same = pushes["expert"].eqNullSafe(seen["expert"]) & pushes["seq"].eqNullSafe(seen["seq"])
    return pushes.join(seen, same, "left_anti")


def _held(pushes: DataFrame, sink_dir: str, batch_id: int) -> tuple[DataFrame | None, int | None, int | None]:
    """What holds before this batch, without reading a vector of it.

    (expert, version, dim) of the experts the pushes touch, the dimension of the global
    state, and - if there is none yet - that of the batch's first push.
    """
    # at most BUCKETS numbers and one dimension
    is_vector = U._is_wide(dict(pushes.dtypes)["delta"])
    size = F.size("delta") if is_vector else F.lit(1)
    facts = pushes.agg(F.collect_set(_bucket()).alias("buckets"), F.min_by(size, F.struct("seq", size)).alias("dim")).first()
    added = _added(pushes.sparkSession, sink_dir, batch_id)
    if added is None:
        return None, None, facts.dim
    wanted = F.col("bucket").isin(facts.buckets) & (F.col("scope") == "expert") | (F.col("bucket") == _GLOBAL_BUCKET) & (F.col("scope") == "global")
    narrow = added.where(wanted).select("scope", "expert", "n", "dim")
    touched = pushes.select(F.lit("expert").alias("scope"), "expert").unionByName(
        pushes.sparkSession.createDataFrame([("global", "*")], "scope string, expert string"))
    held = cut_lineage(narrow.join(touched.distinct(), ["scope", "expert"], "left_semi").groupBy("scope", "expert")
                       .agg(F.sum("n").alias("version"), F.max("dim").alias("dim")))
    whole = held.where("scope = 'global'").first()
    return held.where("scope = 'expert'").drop("scope"), None if whole is None else whole.dim, facts.dim


def _fold_batch(batch: DataFrame, sink_dir: str, batch_id: int, dim: int | None, registrations: str | None, horizon: int) -> None:
    spark = batch.sparkSession
    scalar = not U._is_wide(dict(batch.dtypes)["delta"])
    pushes = _new_pushes(batch, sink_dir, batch_id, horizon)
    if registrations is not None:
        log = spark.read.schema(REGISTRATION_SCHEMA).parquet(registrations)
        pushes = U.accepted_in_time(pushes, log)
    pushes = cut_lineage(pushes)                  # read several times below
    _write(pushes.select("expert", "seq"), f"{sink_dir}/seen/batch={batch_id}")

    held, global_dim, first_dim = _held(pushes, sink_dir, batch_id)
    if global_dim is None:
        global_dim = dim if dim is not None and not scalar else first_dim
    if scalar:
        judged = U.judged_scalars(pushes, held)
    else:
        judged, _ = U._judged(pushes, ["expert"], ["expert"], "delta", dim, held)
    own = F.struct(F.lit("expert").alias("scope"), F.col("expert").alias("expert"), F.lit(0).cast("long").alias("salt"),
                   F.col("dim").cast("int").alias("dim"), F.col("reason").isNull().alias("fits"))
    fits_all = F.col("decay").isNotNull() & (F.size("delta") == F.lit(global_dim))
    whole = F.struct(F.lit("global").alias("scope"), F.lit("*").alias("expert"), F.pmod(F.xxhash64("seq"), F.lit(U.GLOBAL_SALTS)).alias("salt"),
                     F.lit(global_dim).cast("int").alias("dim"), fits_all.alias("fits"))
    both = judged.select("delta", "decay", F.explode(F.array(own, whole)).alias("into"))
    rows = both.select("into.scope", "into.expert", "into.salt", "into.dim", F.lit(1).cast("long").alias("n"),
                       F.when(F.col("into.fits"), F.col("delta")).otherwise(F.expr("array_repeat(0.0D, into.dim)")).alias("vector"),
                       F.when(F.col("into.fits"), U._weight()).otherwise(1.0).alias("weight"))
    parts = rows.groupBy("scope", "expert", "salt").agg(F.sum("n").alias("n"), F.max("dim").alias("dim"), U._sum_vectors().alias("vector"))
    added = _merged(parts.withColumn("scalar", F.lit(scalar)))
    _write(_placed(added), f"{sink_dir}/delta/batch={batch_id}", "bucket")


def stream_fold(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                files_per_trigger: int = 1, vector: bool = False, processing_time: str | None = None,
                registry: Sequence[str] | None = None, dim: int | None = None, registrations: str | None = None,
                compact_every: int = COMPACT_EVERY, horizon: int = HORIZON):
    """Fold the pushes arriving in ``source_dir``; the state goes to ``sink_dir`` (see :func:`latest_states`, :func:`latest_global`).

    ``vector=True`` folds array deltas position-wise (``dim``: their length, else each
    expert's first push sets it). Pushes for experts outside ``registry`` (if given)
    are dropped. ``registrations`` names a table (expert, seq), read anew by every
    micro-batch: pushes before their expert's first registration are dropped (U1), so
    a registration must be written before the pushes behind it arrive. By default
    every available file is processed (``availableNow``) and the call returns when
    done. With ``processing_time`` (e.g. ``"10 seconds"``) the fold keeps running -
    workers may keep pushing files - and the running ``StreamingQuery`` is returned
    for the caller to stop.
    """
    stream = (spark.readStream.schema(VECTOR_PUSH_SCHEMA if vector else PUSH_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    if registry is not None:
        stream = U.accepted(stream, list(registry))

    def fold(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _fold_batch(batch, sink_dir, batch_id, dim, registrations, horizon)
        if (batch_id + 1) % compact_every == 0:
            compact(session, sink_dir, batch_id)
        for n in _numbers(session, sink_dir, "seen", "batch"):
            if n < batch_id - horizon:
                remove_path(session, f"{sink_dir}/seen/batch={n}")

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def _latest(spark: SparkSession, sink_dir: str, scope: str) -> DataFrame | None:
    added = _added(spark, sink_dir)
    return None if added is None else _merged(added.where(F.col("scope") == scope))


def _state(df: DataFrame) -> Column:
    """The sums as an array, or as a number where the pushes are numbers."""
    scalar = df.select("scalar").first()
    return F.col("vector")[0] if scalar is not None and scalar.scalar else F.col("vector")


def latest_states(spark: SparkSession, sink_dir: str) -> DataFrame | None:
    """(expert, version, state) after the last micro-batch; None before the first."""
    states = _latest(spark, sink_dir, "expert")
    return None if states is None else states.select("expert", F.col("n").alias("version"), _state(states).alias("state"))


def latest_global(spark: SparkSession, sink_dir: str) -> DataFrame | None:
    """(global_version, global_state) after the last micro-batch (U3); None before the first."""
    whole = _latest(spark, sink_dir, "global")
    return None if whole is None else whole.select(F.col("n").alias("global_version"), _state(whole).alias("global_state"))


def write_push_files(log: DataFrame, out_dir: str, steps: int, files: int = 1) -> None:
    """Write a push log as ``steps`` seq ranges one after another, each as ``files`` files.

    The file source takes older files first, so with ``files`` files a trigger a
    micro-batch is one range. The log is computed once into a staging table next to
    ``out_dir``; the ranges are cut from that copy.
    """
    delta = F.col("delta")
    delta = delta.cast("array<double>") if dict(log.dtypes)["delta"].startswith("array") else delta.cast("double")
    staging = out_dir.rstrip("/") + "-staging"
    log.select("expert", F.col("seq").cast("bigint"), F.col("worker_version").cast("bigint"),
               delta.alias("delta")).write.mode("overwrite").parquet(staging)
    staged = log.sparkSession.read.parquet(staging)
    lo, hi = staged.agg(F.min("seq"), F.max("seq")).first()
    if lo is None:
        return
    width = max(1, -(-(hi - lo + 1) // steps))
    for i in range(steps):
        part = staged.filter(F.floor((F.col("seq") - lo) / width) == i)
        part.repartition(files).write.mode("append").parquet(out_dir)
