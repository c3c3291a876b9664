"""U8: a versioned state history - states as of any push, without folding the log again.

A history is a folder of segments, one per :func:`write_history` / :func:`append_history`,
each holding the pushes of one range of ``seq``. Inside a segment an expert's pushes
are numbered from 0 and lie in blocks of ``every`` (K); K blocks form a block of the
next level, and so on. A segment keeps

* ``members``: one row per expert known by its end - version and state *before* it;
* ``index``: (expert, block, first_seq), one narrow row per block of pushes;
* ``pushes``: (expert, block, seq, vector), each delta with its decay applied;
* ``sums``: (expert, level, idx, prefix) - per block of every level the sum of its
  earlier siblings, at most K - 1 of them, so a prefix never looks further back.

A state as of push s is then the member's state, one prefix per level and the pushes
of one block up to s: fewer than K pushes and log_K(pushes) sums per expert, whatever
the length of the log. All points asked for are answered in one pass. The block of a
point comes from the index alone (a merge by (expert, seq) in range partitions, see
:func:`corpusfold.operators.sequence.running_count`), so only the folders ``part=``
that hold the blocks asked for are read.

Sums of blocks are partial aggregations, and prefixes are built from groups of at
most K sums, so an expert that holds a third of all pushes is spread like any other.
A segment counts once its row in ``heads`` is written, which is the last thing done:
a job that dies before that leaves nothing, and running it again overwrites the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.operators import updates as U
from corpusfold.operators.sequence import running_count
from corpusfold.session import cut_lineage, path_exists

EVERY = 64
PARTS = 64
_HEAD = "segment int, least long, greatest long, pushes long, levels int, every int, parts int, scalar boolean"
_MEMBERS = "expert string, version long, state array<double>"
_INDEX = "expert string, block long, first_seq long"
_PUSHES = "expert string, block long, seq long, vector array<double>, part int"
_SUMS = "expert string, level int, idx long, prefix array<double>, part int"


def _part(parts: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def _over(idx: Column, n: int) -> Column:
    return F.floor(idx / n).cast("long")


def heads(spark: SparkSession, path: str) -> list:
    """The finished segments in order; a history has one per append."""
    if not path_exists(spark, f"{path}/heads"):
        return []
    return sorted(spark.read.schema(_HEAD).option("recursiveFileLookup", True).parquet(f"{path}/heads").collect(), key=lambda h: h.segment)


def _table(spark: SparkSession, path: str, segment: int, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/segment-{segment}/{name}")


# -------------------------------------------------------------------- writing

def _prefixes(sums: DataFrame, every: int) -> DataFrame:
    """(expert, idx, prefix): for each sum, that of its earlier siblings; groups of at most ``every`` sums."""
    siblings = F.array_sort(F.collect_list(F.struct("idx", "vector")))
    start = F.struct(F.transform(F.col("siblings")[0]["vector"], lambda x: F.lit(0.0)).alias("acc"),
                     F.array().cast("array<array<double>>").alias("out"))
    walk = F.aggregate("siblings", start, lambda s, x: F.struct(
        F.zip_with(s["acc"], x["vector"], lambda a, b: a + b).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")))["out"]
    groups = sums.groupBy("expert", _over(F.col("idx"), every).alias("parent")).agg(siblings.alias("siblings"))
    pairs = F.arrays_zip(F.col("siblings")["idx"].alias("idx"), walk.alias("prefix"))
    return groups.select("expert", F.explode(pairs).alias("p")).select("expert", "p.idx", "p.prefix")


def _block_sums(rows: DataFrame, idx: Column) -> DataFrame:
    return (rows.groupBy("expert", idx.alias("idx")).agg(F.count(F.lit(1)).alias("n"), U._sum_vectors().alias("vector"))
            .select("expert", "idx", "vector"))


def _write_segment(log: DataFrame, path: str, segment: int, members: DataFrame | None, every: int, parts: int, dim: int | None,
                   delta: str, scalar: bool) -> None:
    spark = log.sparkSession
    at = f"{path}/segment-{segment}"
    pushes = log.select("expert", F.col("seq").cast("long"), F.col("worker_version").cast("long"), F.col(delta).alias("delta"))
    held = None if members is None else members.withColumn("dim", F.size("state"))
    if scalar:
        judged, known = U.judged_scalars(pushes, held), pushes.select("expert", F.lit(1).alias("dim")).distinct()
    else:
        judged, known = U._judged(pushes, ["expert"], ["expert"], "delta", dim, held)
    weighted = F.when(F.col("reason").isNull(), F.transform(F.col("delta").cast("array<double>"), lambda x: x * U._weight())).otherwise(
        F.expr("array_repeat(0.0D, dim)"))
    if members is None:
        rows, had = judged, F.lit(0)
    else:
        rows = judged.join(members.select("expert", F.col("version").alias("_cf_had")), "expert", "left")
        had = F.coalesce("_cf_had", F.lit(0))
    rows = rows.select("expert", _over(F.col("version") - had, every).alias("block"), "seq", weighted.alias("vector"))
    rows = rows.withColumn("part", _part(parts, F.col("expert"), _over(F.col("block"), every)))
    rows.repartition("part", "expert", "block").write.mode("overwrite").partitionBy("part").parquet(f"{at}/pushes")

    pushes = _table(spark, path, segment, "pushes", _PUSHES)
    index = pushes.groupBy("expert", "block").agg(F.min("seq").alias("first_seq"))
    index.select("expert", "block", "first_seq").write.mode("overwrite").parquet(f"{at}/index")
    facts = pushes.agg(F.min("seq").alias("least"), F.max("seq").alias("greatest"), F.count(F.lit(1)).alias("n"), F.max("block").alias("block")).first()
    levels, top = 1, facts.block or 0
    while top >= every:
        levels, top = levels + 1, top // every
    sums = _block_sums(pushes.select("expert", "block", "vector", F.lit(1.0).alias("weight")), F.col("block"))
    for level in range(1, levels + 1):
        sums = cut_lineage(sums)
        prefix = _prefixes(sums, every).withColumn("part", _part(parts, F.col("expert"), F.lit(level), _over(F.col("idx"), every)))
        (prefix.select("expert", F.lit(level).alias("level"), "idx", "prefix", "part").repartition("part")
         .write.mode("overwrite" if level == 1 else "append").partitionBy("part").parquet(f"{at}/sums"))
        if level < levels:
            sums = _block_sums(sums.withColumn("weight", F.lit(1.0)), _over(F.col("idx"), every))

    # experts first seen in this segment start from nothing
    fresh = known.select("expert", F.lit(0).cast("long").alias("version"), F.expr("array_repeat(0.0D, dim)").alias("state"))
    if members is not None:
        fresh = members.select("expert", "version", "state").unionByName(fresh.join(members.select("expert"), "expert", "left_anti"))
    fresh.write.mode("overwrite").parquet(f"{at}/members")
    head = [(segment, facts.least, facts.greatest, facts.n, levels, every, parts, scalar)]
    spark.createDataFrame(head, _HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/segment-{segment}")


def _accepted(log: DataFrame, registry) -> DataFrame:
    if isinstance(registry, DataFrame) and "seq" in registry.columns:
        return U.accepted_in_time(log, registry)
    return log if registry is None else U.accepted(log, registry)


def append_history(log: DataFrame, path: str, registry: DataFrame | Sequence[str] | None = None, dim: int | None = None,
                   delta: str = "delta", every: int = EVERY, parts: int = PARTS) -> bool:
    """Add the pushes of ``log`` (expert, seq, worker_version, delta) as the next segment; they must lie behind the last one.

    ``registry`` is a list of experts, a table of them, or a log of registrations
    (expert, seq). ``every`` and ``parts`` hold for the whole history: those of its
    first segment stay. Returns False, changing nothing, if no push is accepted.
    """
    spark = log.sparkSession
    scalar = not U._is_wide(dict(log.dtypes)[delta])
    log = _accepted(log, registry)
    least = log.agg(F.min("seq")).first()[0]
    if least is None:
        return False
    done = heads(spark, path)
    members = None
    if done:
        last = done[-1]
        if least <= last.greatest:
            raise ValueError(f"push {least} lies before the end of the history ({last.greatest})")
        if scalar != last.scalar:
            raise ValueError("a history holds either scalar or vector pushes")
        every, parts = last.every, last.parts
        members = cut_lineage(_states(spark, path, [last.greatest], None).select("expert", "version", "state"))
    _write_segment(log, path, len(done), members, every, parts, dim, delta, scalar)
    return True


def write_history(log: DataFrame, path: str, registry: DataFrame | Sequence[str] | None = None, dim: int | None = None,
                  delta: str = "delta", every: int = EVERY, parts: int = PARTS) -> bool:
    """Start a history with the pushes of ``log``; see :func:`append_history`."""
    if heads(log.sparkSession, path):
        raise ValueError(f"{path} holds a history already")
    return append_history(log, path, registry, dim, delta, every, parts)


# -------------------------------------------------------------------- reading

def _segment_states(spark: SparkSession, path: str, head, points: Sequence[int], experts: Sequence[str] | None) -> DataFrame:
    """(as_of, expert, version, state) at points that lie in one segment."""
    def own(df: DataFrame) -> DataFrame:
        return df if experts is None else df.where(F.col("expert").isin(list(experts)))

    members = own(_table(spark, path, head.segment, "members", _MEMBERS))
    asked = members.select("expert", F.explode(F.array(*[F.lit(int(p)).cast("long") for p in points])).alias("seq"), F.lit(False).alias("mark"))
    index = own(_table(spark, path, head.segment, "index", _INDEX)).select("expert", F.col("first_seq").alias("seq"), F.lit(True).alias("mark"))
    placed = running_count(asked.unionByName(index), ["expert"], "seq", "mark", out="blocks").where("NOT mark")
    # blocks are begun in order, so the number begun by a point names the last of them
    placed = cut_lineage(placed.select("expert", F.col("seq").alias("as_of"), (F.col("blocks") - 1).alias("block")))

    begun = placed.where("block >= 0")
    tails = begun.withColumn("part", _part(head.parts, F.col("expert"), _over(F.col("block"), head.every)))
    levels = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("level"), F.lit(head.every ** k).cast("long").alias("width")) for k in range(head.levels)]))
    sums = begun.withColumn("l", levels).select("expert", "as_of", "l.level", F.floor(F.col("block") / F.col("l.width")).cast("long").alias("idx"))
    sums = sums.withColumn("part", _part(head.parts, F.col("expert"), F.col("level"), _over(F.col("idx"), head.every)))

    def read(name: str, schema: str, keys: DataFrame) -> DataFrame:
        parts = [r.part for r in keys.select("part").distinct().collect()]          # at most head.parts
        return own(_table(spark, path, head.segment, name, schema)).where(F.col("part").isin(parts))

    tail = (read("pushes", _PUSHES, tails).join(tails, ["part", "expert", "block"]).where("seq <= as_of")
            .select("expert", "as_of", F.lit(1).cast("long").alias("n"), "vector"))
    prefix = (read("sums", _SUMS, sums).join(sums, ["part", "expert", "level", "idx"])
              .select("expert", "as_of", F.lit(0).cast("long").alias("n"), F.col("prefix").alias("vector")))
    start = placed.join(members, "expert").select(
        "expert", "as_of", (F.col("version") + F.greatest("block", F.lit(0)) * head.every).alias("n"), F.col("state").alias("vector"))
    every = start.unionByName(prefix).unionByName(tail).withColumn("weight", F.lit(1.0))
    return every.groupBy("as_of", "expert").agg(F.sum("n").alias("version"), U._sum_vectors().alias("state"))


def _states(spark: SparkSession, path: str, points: Sequence[int], experts: Sequence[str] | None) -> DataFrame:
    done = heads(spark, path)
    if not done:
        raise ValueError(f"{path} holds no history")
    of: dict[int, list[int]] = {}
    for p in dict.fromkeys(points):
        # the last segment begun by the point; before the first push all experts of the first one stand at version 0
        of.setdefault(max((h.segment for h in done if h.least <= p), default=0), []).append(p)
    out = None
    for h in done:
        if h.segment in of:
            states = _segment_states(spark, path, h, of[h.segment], experts)
            out = states if out is None else out.unionByName(states)
    return out if out is not None else spark.createDataFrame([], "as_of long, expert string, version long, state array<double>")


def read_as_of(spark: SparkSession, path: str, points: Sequence[int], experts: Sequence[str] | None = None) -> DataFrame:
    """(as_of, expert, version, state) of all known experts (or the named ones) as they were after each push of ``points``.

    ``state`` is an array, or a number for a history of scalar pushes. An expert is
    known from the segment of its first push on, with version 0 and zeros before that
    push; a named expert the history does not know at all is an error.
    """
    done = heads(spark, path)
    if experts is not None and done:
        known = {r.expert for r in _table(spark, path, done[-1].segment, "members", _MEMBERS).where(F.col("expert").isin(list(experts))).select("expert").collect()}
        unknown = sorted(set(experts) - known)
        if unknown:
            raise KeyError(f"unknown expert {unknown[0]!r}")
    states = _states(spark, path, points, experts)
    return states.withColumn("state", F.col("state")[0]) if done and done[-1].scalar else states


def global_as_of(spark: SparkSession, path: str, points: Sequence[int], dim: int | None = None) -> DataFrame:
    """(as_of, global_version, global_state): every push lands on the global state too, so it is the sum of the experts' (U3).

    Vector states of another length than ``dim`` (given, or that of the expert of the
    history's first push) count but cannot be added.
    """
    done = heads(spark, path)
    states = _states(spark, path, points, None)
    if dim is None:
        first = _table(spark, path, 0, "index", _INDEX).agg(F.min_by("expert", F.struct("first_seq", "expert")).alias("expert")).first().expert
        dim = _table(spark, path, 0, "members", _MEMBERS).where(F.col("expert").eqNullSafe(F.lit(first))).select(F.size("state")).first()[0]
    salted = states.select("as_of", F.pmod(F.xxhash64("expert"), F.lit(U.GLOBAL_SALTS)).alias("salt"), F.col("version").alias("n"), F.lit(1.0).alias("weight"),
                           F.when(F.size("state") == dim, F.col("state")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("vector"))
    total = [F.sum("n").alias("n"), U._sum_vectors().alias("vector")]
    merged = salted.groupBy("as_of", "salt").agg(*total).withColumn("weight", F.lit(1.0)).groupBy("as_of").agg(*total)
    state = F.col("vector")[0] if done[-1].scalar else F.col("vector")
    return merged.select("as_of", F.col("n").alias("global_version"), state.alias("global_state"))
