"""Distribution and balance reports over a classified dataset.

Every report starts with a ``groupBy`` (partial aggregation on the map side,
so a domain holding a third of the rows costs one hash-map entry per task);
the windows that follow run over the aggregated rows only (one per domain or
per (domain, library)), never over items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfold.functions.text import line_count, py_strip


def domain_counts(classified: DataFrame) -> DataFrame:
    """A1: rows per domain."""
    return classified.groupBy("domain").agg(F.count(F.lit(1)).alias("cnt"))


def domain_distribution(classified: DataFrame, domains: Sequence[str]) -> DataFrame:
    """A3: counts over the *configured* domains (zeros included) with percentages.

    The per-domain counts (one row per observed domain) fold into a single map
    row; the configured list is exploded from a literal and looked up in it. No
    join and no predicate on ``domain`` reaches the (possibly lazy, rule-heavy)
    input plan.
    """
    counts = domain_counts(classified)
    wanted = F.col("domain").isin(list(domains))   # inside the aggregate: collects <= len(domains) entries
    folded = counts.agg(F.map_from_entries(F.collect_list(F.when(wanted, F.struct("domain", "cnt")))).alias("_m"),
                        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total"))
    conf = F.array(*[F.lit(d) for d in domains])
    rows = folded.select(F.posexplode(conf).alias("position", "domain"), "_m", "total")
    cnt = F.coalesce(F.try_element_at(F.col("_m"), F.col("domain")), F.lit(0)).cast("bigint")
    return rows.select(F.col("position").cast("int").alias("position"), "domain", cnt.alias("cnt"),
                       F.when(F.col("total") > 0, F.lit(100.0) * cnt / F.col("total"))
                       .otherwise(F.lit(0.0)).alias("pct"),
                       "total")


def reason_top(classified: DataFrame, k: int = 10, order_col: str = "item_id") -> DataFrame:
    """A2: top-k reasons by count, ties in first-seen order."""
    agg = classified.groupBy("reason").agg(F.count(F.lit(1)).alias("cnt"), F.min(order_col).alias("first_seen"))
    top = agg.orderBy(F.desc("cnt"), F.asc("first_seen")).limit(k)
    w = Window.orderBy(F.desc("cnt"), F.asc("first_seen"))
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "reason",
                      F.col("cnt").cast("bigint").alias("cnt"))


def domain_text_stats(classified: DataFrame, prompt: str = "prompt", code: str = "code") -> DataFrame:
    """A4: per domain mean prompt length, mean code length and mean line count (0 for empty code)."""
    p = F.coalesce(F.col(prompt), F.lit(""))
    c = F.coalesce(F.col(code), F.lit(""))
    lines = F.when(c == F.lit(""), F.lit(0)).otherwise(line_count(c))
    return classified.groupBy("domain").agg(
        F.count(F.lit(1)).cast("bigint").alias("cnt"),
        F.avg(F.length(p)).alias("avg_prompt_len"),
        F.avg(F.length(c)).alias("avg_code_len"),
        F.avg(lines).alias("avg_lines"))


def domain_top_libraries(classified: DataFrame, library: str = "library", k: int = 10,
                         order_col: str = "item_id") -> DataFrame:
    """A5: per domain the k most frequent (stripped, lower-cased) libraries, ties first-seen."""
    lib = F.lower(py_strip(library))
    agg = (classified.select("domain", order_col, lib.alias("lib"))
           .filter(F.col("lib") != F.lit(""))
           .groupBy("domain", "lib").agg(F.count(F.lit(1)).alias("cnt"), F.min(order_col).alias("first_seen")))
    w = Window.partitionBy("domain").orderBy(F.desc("cnt"), F.asc("first_seen"))
    return (agg.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k)
            .select("domain", "rank", "lib", F.col("cnt").cast("bigint").alias("cnt")))


def balance_summary(classified: DataFrame) -> DataFrame:
    """Balance over the observed domains; ratio max/min, balanced iff ratio < 2."""
    c = domain_counts(classified)
    return c.agg(
        F.sum("cnt").cast("bigint").alias("total_items"),
        F.count(F.lit(1)).cast("bigint").alias("num_domains"),
        (F.sum("cnt") / F.count(F.lit(1))).alias("avg_per_domain"),
        F.min("cnt").cast("bigint").alias("min_count"),
        F.max("cnt").cast("bigint").alias("max_count"),
        (F.max("cnt") / F.min("cnt")).alias("imbalance_ratio"),
        ((F.max("cnt") / F.min("cnt")) < F.lit(2.0)).alias("is_balanced"),
    ).filter(F.col("num_domains") > 0)


def balance_suggestions(classified: DataFrame) -> DataFrame:
    """Domains under 0.5x or over 1.5x the mean count (strict), with their percentage."""
    c = domain_counts(classified)
    w = Window.partitionBy()
    with_stats = c.select("domain", "cnt", F.avg("cnt").over(w).alias("mean"), F.sum("cnt").over(w).alias("total"))
    status = (F.when(F.col("cnt") < F.col("mean") * 0.5, F.lit("underrepresented"))
              .when(F.col("cnt") > F.col("mean") * 1.5, F.lit("overrepresented")))
    return (with_stats.select("domain", F.col("cnt").cast("bigint").alias("cnt"),
                              F.when(F.col("total") > 0, F.lit(100.0) * F.col("cnt") / F.col("total"))
                              .otherwise(F.lit(0.0)).alias("pct"),
                              status.alias("status"))
            .filter(F.col("status").isNotNull()))
