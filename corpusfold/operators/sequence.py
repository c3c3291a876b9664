"""Skew-safe ordered numbering within groups.

``row_number() OVER (PARTITION BY key ORDER BY seq)`` sends every row of a key
to one task; with a handful of keys (experts, domains) and one key holding a
third of the log, that task is the whole job. :func:`running_rank` numbers the
rows in these steps:

1. the narrow columns (keys, order) are range-partitioned by (keys, order, a hash
   of the row) and sorted, so a hot key takes as many partitions as it fills,
   whatever the gaps or ties of its order column;
2. the result is written to the shared checkpoint folder, where each row has a
   fixed (partition, place);
3. per (partition, key) the count and first place are summed: a table of at most
   partitions + keys rows, from which each key's offsets follow;
4. a row's position is its place less the key's first place plus the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.session import cut_lineage

_PLACE_BITS = 33        # Spark's monotonically_increasing_id: partition number above, place in it below


def running_rank(df: DataFrame, keys: Sequence[str], order_col: str, out: str = "rank",
                 partitions: int | None = None, mark: str | None = None, mark_out: str = "mark_rank") -> DataFrame:
    """Add ``out`` = 1-based position of each row by ``order_col`` within ``keys``.

    Rows that tie on ``order_col`` get distinct positions, in the order of a hash of
    the row. Null keys are a key of their own. The input is computed once.

    ``mark`` names a boolean column: marked rows come before the others of the same
    ``order_col``, and ``mark_out`` is the position of the key's first marked row (null
    without one), so rows are told from those before it without a join of the two.
    """
    keys = list(keys)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")])
    by = [*keys, order_col, *([F.col(mark).desc()] if mark else []), "_cf_tie"]
    placed = cut_lineage(df.withColumn("_cf_tie", tie).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_cf_tie")
                         .withColumn("_cf_at", F.monotonically_increasing_id()))
    part = F.shiftright("_cf_at", _PLACE_BITS).alias("_cf_part")
    marked = [F.min(F.when(F.col(mark), F.col("_cf_at"))).alias("_cf_mark")] if mark else []
    firsts = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_cf_n"), F.min("_cf_at").alias("_cf_first"), *marked)
    before = Window.partitionBy(*keys).orderBy("_cf_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = firsts.withColumn("_cf_shift", F.coalesce(F.sum("_cf_n").over(before), F.lit(0)) - F.col("_cf_first") + 1)
    first_mark = [F.min(F.col("_cf_mark") + F.col("_cf_shift")).over(Window.partitionBy(*keys)).cast("bigint").alias(mark_out)] if mark else []
    shift = shift.select(*[F.col(k).alias(f"_cf_{k}") for k in keys], "_cf_part", "_cf_shift", *first_mark)
    placed = placed.withColumn("_cf_of", part)
    same = F.col("_cf_of") == F.col("_cf_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_cf_{k}"))
    return (placed.join(cut_lineage(shift), same)
            .withColumn(out, (F.col("_cf_at") + F.col("_cf_shift")).cast("bigint"))
            .drop("_cf_at", "_cf_of", "_cf_part", "_cf_shift", *[f"_cf_{k}" for k in keys]))


def running_count(df: DataFrame, keys: Sequence[str], order_col: str, mark: str, out: str = "marks") -> DataFrame:
    """Add ``out`` = number of marked rows of the key at or before each row by ``order_col`` (marked rows first in ties).

    As in :func:`running_rank`, a key fills as many range partitions as it needs: the
    counts inside a partition meet the counts of the partitions before it.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, order_col, F.col(mark).desc(), F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")])]
    placed = cut_lineage(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_cf_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_cf_of", F.shiftright("_cf_at", _PLACE_BITS))
    inside = Window.partitionBy("_cf_of", *keys).orderBy("_cf_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_cf_in", F.sum(F.col(mark).cast("bigint")).over(inside))
    totals = placed.groupBy(*keys, F.col("_cf_of").alias("_cf_part")).agg(F.sum(F.col(mark).cast("bigint")).alias("_cf_n"))
    before = Window.partitionBy(*keys).orderBy("_cf_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_cf_{k}") for k in keys], "_cf_part", F.coalesce(F.sum("_cf_n").over(before), F.lit(0)).alias("_cf_carry"))
    same = F.col("_cf_of") == F.col("_cf_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_cf_{k}"))
    return (placed.join(cut_lineage(totals), same).withColumn(out, F.col("_cf_in") + F.col("_cf_carry"))
            .drop("_cf_at", "_cf_of", "_cf_in", "_cf_part", "_cf_carry", *[f"_cf_{k}" for k in keys]))
