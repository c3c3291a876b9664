"""Operator 3 - mixing sources to target weights by pivotal dependent rounding.

Sources, by code point with null last, weigh 3, 1, 2, 3, 1, 2, ... and share 150 %
of all words. No target is above 2 times its source's words; what is cut off is
shared again by weight, until nothing is (water filling: target = min(cap, level *
weight), with the level found in one ordered pass over the sources).

A document is taken ``target / source words`` times, which has a whole and a
fractional part. The fractional copies of a source are rounded together: two
documents exchange probability so that their expected *words* stay the same, until
one of them is 0 or 1 (which of the two ways is drawn so that expectations hold).
A chain over a group's documents ends with at most one fractional document; those
residuals meet in a reduction tree - ``FAN`` groups of a source at a time - and the
last one of a source is drawn alone. So a source's words miss its target by less
than its largest document.

Scale. Groups are hashed buckets of about ``CHAIN_ROWS`` rows of a source, so a hot
source spreads over all tasks; each tree level has one row a group. Draws come
from hashes of (source, bucket, level) and the rows' order, so reruns and retried
tasks agree, whatever the partitions. Texts are only counted, never shuffled.

Cases. Null text has size 0; rows of size 0 are taken 0 words (0 copies). A null
source is a source. Rows that agree in doc_id and size are interchangeable, each
counts. A null doc_id is an ordinary row. No words at all: targets 0. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import WORD_PATTERN, on_workers, read_table
from corpusfold.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2                        # copies of a document, and words of a source's target
CHAIN_ROWS = 8192
FAN = 16


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size); one row a source goes through one ordered window."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sources.select("source", "source_size", weight.cast("double").alias("weight"),
                             (F.col("source_size") * MOST).cast("double").alias("cap"),
                             F.row_number().over(by_name).alias("nth"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    leveled = weighed.withColumn("level", level)
    found = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(everything)
    return leveled.withColumn("level", found).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def pivotal(p: np.ndarray, w: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round probabilities p of items of weight w > 0, keeping the sum of w * p; index of what stays fractional or -1."""
    rng = np.random.default_rng(seed)
    draws = rng.random(len(p)).tolist()
    q, weight = p.tolist(), w.tolist()
    i = -1
    for j in range(len(q)):
        if not 0.0 < q[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        up = min((1.0 - q[i]) * weight[i], q[j] * weight[j])        # words that i can take from j
        down = min(q[i] * weight[i], (1.0 - q[j]) * weight[j])
        if draws[j] * (up + down) < down:
            full, empty, moved = i, j, up
        else:
            full, empty, moved = j, i, down
        fills = (1.0 - q[full]) * weight[full] <= q[empty] * weight[empty]
        if fills:
            q[empty] = q[empty] - moved / weight[empty]
            q[full] = 1.0
        else:
            q[full] = q[full] + moved / weight[full]
            q[empty] = 0.0
        i = empty if fills else full
        if not 1e-12 < q[i] < 1.0 - 1e-12:
            q[i] = float(round(q[i]))
            i = -1
    return np.array(q), i


def _seed(*key) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")


_CHAIN = "source string, bucket long, home long, doc_id long, th long, size long, copies int, p double"


def _chain(level: int):
    """Rows of one (source, bucket): copies decided, but for at most one row that keeps p."""
    def run(key, table):
        doc = table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        size, p, th, home = (table.column(c).to_numpy() for c in ("size", "p", "th", "home"))
        # large ones first, so that what stays open at the end is small
        order = np.lexsort((home, th, doc, -size))
        table, p, size = table.take(pa.array(order)), p[order], size[order]
        q, left = pivotal(p, size, _seed(key[0].as_py(), key[1].as_py(), level))
        whole = table.column("copies").to_numpy() + q.astype(np.int32)
        open_ = np.arange(len(q)) == left
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(np.where(open_, q, 0.0)))
        return table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(whole.astype(np.int32)))
    return run


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), source, size, source_size, target, copies for every row of ``docs``."""
    spark = docs.sparkSession
    on_workers(spark)
    sizes = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("th"), "source", word_count().alias("size")))
    per_source = cut_lineage(targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(per_source, sizes.source.eqNullSafe(per_source.source), "left").select(
        sizes.source, "doc_id", "th", "size", "source_size", "target", rate.alias("rate"))
    buckets = max(1, -(-sizes.count() // CHAIN_ROWS))
    whole = F.floor("rate").cast("int")
    home = F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets))
    open_ = rows.select("source", home.alias("bucket"), home.alias("home"), "doc_id", "th", "size",
                        F.when(F.col("size") > 0, whole).otherwise(0).alias("copies"),
                        F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("p"))
    done, level = [], 0
    while True:
        step = cut_lineage(open_.groupBy("source", "bucket").applyInArrow(_chain(level), _CHAIN))
        done.append(step.where("p = 0").select("source", "doc_id", "th", "size", "copies"))
        open_ = step.where("p > 0")
        if buckets == 1:
            break
        buckets = -(-buckets // FAN)
        level += 1
        open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    # the last of each source is drawn alone
    draw = (F.pmod(F.xxhash64("source", "doc_id", "th", F.lit("last")), F.lit(1 << 40)) / float(1 << 40)) < F.col("p")
    done.append(open_.select("source", "doc_id", "th", "size", (F.col("copies") + draw.cast("int")).alias("copies")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    out = out.alias("o")
    return (out.join(per_source.alias("s"), F.expr("o.source <=> s.source"), "left")
            .select("o.source", "doc_id", "th", "size", "source_size", "target", "copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (all columns of ``docs``, nothing else)."""
    cols = docs.columns
    # rows that agree in id and text are told apart by their order on both sides
    key = Window.partitionBy("__id", "__th").orderBy("__rank")
    taken = copies(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "copies",
                                F.xxhash64("source").alias("__rank"))
    taken = taken.withColumn("__nth", F.row_number().over(key)).where("copies > 0").select("__id", "__th", "__nth", "copies")
    rows = docs.withColumns({"__id": F.col("doc_id"), "__th": F.xxhash64("text"), "__rank": F.xxhash64("source")})
    rows = rows.withColumn("__nth", F.row_number().over(key)).alias("r")
    out = rows.join(taken.alias("t"), F.expr("r.__id <=> t.__id AND r.__th = t.__th AND r.__nth = t.__nth"))
    return (out.select(*(F.col(f"r.`{c}`") for c in cols), F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("__copy"))
            .select(*(F.col(f"`{c}`") for c in cols)))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all `documents`: what the mix takes of each document."""
    out = copies(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "source", "copies")
