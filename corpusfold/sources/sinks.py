"""Sinks (S6, S10): domain-partitioned corpus output and small report files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusfold.session import cut_lineage, replace_path


def write_domains(classified: DataFrame, out: str, order_col: str = "item_id",
                  domains: Sequence[str] | None = None, files_per_domain: int | None = None) -> None:
    """One directory per domain (``domain=<name>``) holding the raw lines, overwritten.

    By default there is no shuffle: each task writes its own rows per domain,
    sorted by ``order_col`` (tasks x domains files; where the rows are read in order,
    so are the files by name). ``files_per_domain`` writes at most that many files a
    domain *in the order of* ``order_col``: reading them by name gives the order of the
    input. Each domain is cut at its own quantiles of ``order_col`` (mergeable
    sketches), and the ranges are dealt out in order, so a hot domain is split over as
    many tasks. ``domains`` also creates the directories of configured domains that
    received no rows. The table is written beside ``out`` and takes its place when it is
    complete: a job that fails leaves the old one.
    """
    rows = classified.select("domain", order_col, "raw")
    if files_per_domain:
        rows = cut_lineage(rows)                        # read twice: for the cuts and for the rows
        cuts = rows.groupBy("domain").agg(F.percentile_approx(order_col, [i / files_per_domain for i in range(1, files_per_domain)] or [1.0], 10_000).alias("_cf_cuts"))
        piece = F.size(F.filter("_cf_cuts", lambda c: c < F.col(order_col))) if files_per_domain > 1 else F.lit(0)
        # one row a domain: the configured ones, or as many as there are directories
        rows = rows.join(F.broadcast(cuts).withColumnRenamed("domain", "_cf_domain"), F.col("domain").eqNullSafe(F.col("_cf_domain")))
        rows = rows.select("domain", order_col, "raw", piece.alias("_cf_piece"))
        n_parts = files_per_domain * (len(domains) if domains else
                                      classified.sparkSession.sparkContext.defaultParallelism)
        rows = rows.repartitionByRange(n_parts, "domain", "_cf_piece")
    staging = f"{out.rstrip('/')}-staging-{uuid.uuid4().hex[:12]}"
    (rows.sortWithinPartitions("domain", order_col)
     .select("domain", "raw")
     .write.mode("overwrite").partitionBy("domain").text(staging))
    if domains:
        ensure_domain_dirs(classified.sparkSession, staging, domains)
    replace_path(classified.sparkSession, staging, out)


def ensure_domain_dirs(spark: SparkSession, out: str, domains: Sequence[str]) -> None:
    """Every configured domain gets its directory, also when no row went there
    (metadata only, one ``mkdirs`` per configured domain)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for d in domains:
        p = jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/domain={d}")
        p.getFileSystem(conf).mkdirs(p)


def read_domains(spark: SparkSession, out: str) -> DataFrame:
    """Read a :func:`write_domains` output back as ``(domain, raw)``; filters on ``domain``
    prune directories."""
    return spark.read.text(out).withColumnRenamed("value", "raw")


def write_json_report(report: DataFrame, out: str) -> None:
    """A small report DataFrame as JSON lines (one file)."""
    report.coalesce(1).write.mode("overwrite").json(out)


REPORT_REASONS = 15


def report_lines(distribution: DataFrame, stats: DataFrame | None = None, reasons: DataFrame | None = None,
                 libraries: DataFrame | None = None, title: str = "Dataset Splitting Report") -> DataFrame:
    """The text report as rows (section, key, nth, line), formatted by column expressions.

    Inputs are report tables: ``distribution`` (domain, cnt, pct, total), ``stats``
    (domain, avg_prompt_len, avg_code_len, avg_lines), ``libraries`` (domain, rank, lib,
    cnt), ``reasons`` (rank, reason, cnt). Sections: 0 head, 1 domains, 2 reasons.
    """
    rows = distribution.select("domain", "cnt", "pct", "total")
    line = lambda section, key, nth, text: F.struct(F.lit(section).alias("section"), key.alias("key"),
                                                    F.lit(nth).alias("nth"), text.alias("line"))
    none = F.lit("")
    per_domain = [line(1, F.col("domain"), 0, F.format_string("  %-15s %6d items (%5.1f%%)", "domain", "cnt", "pct"))]
    if stats is not None:
        rows = rows.join(stats.drop("cnt"), "domain", "left")
        known = F.col("avg_lines").isNotNull()
        for nth, (label, col, form) in enumerate((("Avg prompt len:", "avg_prompt_len", "%.0f chars"),
                                                  ("Avg code len:  ", "avg_code_len", "%.0f chars"),
                                                  ("Avg lines:     ", "avg_lines", "%.1f lines")), start=1):
            per_domain.append(F.when(known, line(1, F.col("domain"), nth, F.format_string(f"    - {label} {form}", col))))
    if libraries is not None:
        named = libraries.where("rank <= 5").groupBy("domain").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lib", "cnt"))),
                                     lambda x: F.concat(x["lib"], F.lit("("), x["cnt"].cast("string"), F.lit(")"))), ", ").alias("libs"))
        rows = rows.join(named, "domain", "left")
        per_domain.append(F.when(F.col("libs").isNotNull(),
                                 line(1, F.col("domain"), 4, F.concat(F.lit("    - Top libraries: "), F.col("libs")))))
    per_domain.append(line(1, F.col("domain"), 9, none))
    spell = lambda df, items: df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("x.*")
    body = spell(rows, per_domain)
    total = distribution.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    rule, thin = F.lit("=" * 80), F.lit("-" * 80)
    head = [rule, F.lit(title), rule, none, F.format_string("Total Items: %d", "total"), none, F.lit("Domain Distribution:"), thin]
    out = spell(total, [line(0, none, i, text) for i, text in enumerate(head)]).unionByName(body)
    if reasons is not None:
        share = F.when(F.col("total") > 0, F.col("cnt") / F.col("total") * 100).otherwise(0.0)
        ranked = reasons.where(F.col("rank") <= REPORT_REASONS).select(
            "rank", "reason", "cnt").withColumn("total", total.scalar())
        out = out.unionByName(spell(total, [line(2, none, -2, F.lit("Top Classification Reasons:")), line(2, none, -1, thin)]))
        out = out.unionByName(ranked.select(F.lit(2).alias("section"), none.alias("key"), F.col("rank").cast("int").alias("nth"),
                                            F.format_string("  %-40s %6d (%5.1f%%)", "reason", "cnt", share).alias("line")))
    return out


def render_text_report(*tables: DataFrame, **more) -> str:
    """The lines of :func:`report_lines` as one text (a few lines a configured domain)."""
    rows = report_lines(*tables, **more).orderBy("section", "key", "nth").select("line").collect()
    return "\n".join(r["line"] for r in rows)


def write_run_results(rounds: DataFrame, comparison: DataFrame, out: str) -> None:
    """The results of runs under ``out``: ``rounds`` (a row per run and step) and ``comparison``, as JSON lines."""
    write_json_report(rounds, f"{out}/rounds")
    write_json_report(comparison, f"{out}/comparison")


def read_run_results(spark: SparkSession, out: str, rounds_schema: str, comparison_schema: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(rounds_schema).json(f"{out}/rounds"), spark.read.schema(comparison_schema).json(f"{out}/comparison"))


def split_summary(classified: DataFrame, k: int = 10) -> dict:
    """S10 splitter summary ``{total, counts, top_reasons}`` (top ``k`` reasons, first-seen ties).

    Built from aggregated rows only (one per domain, ``k`` reasons).
    """
    from corpusfold.operators import report as A
    counts = {r["domain"]: r["cnt"] for r in A.domain_counts(classified).collect()}
    reasons = [(r["reason"], r["cnt"]) for r in A.reason_top(classified, k=k).orderBy("rank").collect()]
    return {"total": sum(counts.values()), "counts": counts, "top_reasons": dict(reasons)}


def statistics_summary(classified: DataFrame, prompt: str = "prompt", code: str = "code",
                       library: str = "library", reasons_k: int = 20) -> dict:
    """S10 statistics report: per domain (sorted by name) count, mean prompt / code length and
    line count rounded to 2 places (Python rounding, on the driver), top-10 libraries and the
    (never filled) ``top_keywords``; plus the top-20 classification reasons."""
    from corpusfold.operators import report as A
    stats = {r["domain"]: r for r in A.domain_text_stats(classified, prompt, code).collect()}
    libs: dict[str, list] = {}
    for r in A.domain_top_libraries(classified, library).orderBy("domain", "rank").collect():
        libs.setdefault(r["domain"], []).append((r["lib"], r["cnt"]))
    reasons = [(r["reason"], r["cnt"]) for r in A.reason_top(classified, k=reasons_k).orderBy("rank").collect()]
    domains = {}
    for d in sorted(stats):
        s = stats[d]
        domains[d] = {"domain": d, "count": s["cnt"], "avg_prompt_len": round(s["avg_prompt_len"], 2),
                      "avg_code_len": round(s["avg_code_len"], 2), "avg_lines": round(s["avg_lines"], 2),
                      "top_libraries": dict(libs.get(d, [])), "top_keywords": {}}
    return {"total_items": sum(s["cnt"] for s in stats.values()), "domains": domains,
            "classification_reasons": dict(reasons)}


def write_text(spark: SparkSession, text: str, out: str) -> None:
    """Write a small rendered report as one text file through Spark's writers (any filesystem)."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(out)


__all__ = ["write_domains", "read_domains", "write_json_report", "report_lines", "render_text_report",
           "write_run_results", "read_run_results", "split_summary", "statistics_summary", "write_text"]
