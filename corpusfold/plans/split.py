"""Split a corpus by domain - validate, read, route, write, report.

One scan and one narrow routing projection, written once as a Parquet table in the
shared folder. The domain-partitioned output reads its domain, id and raw line; the
reports read only the columns they name.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusfold.functions import rules as R
from corpusfold.operators import classify as C
from corpusfold.operators import report as A
from corpusfold.session import scratch_path
from corpusfold.sources import jsonl as S
from corpusfold.sources import sinks as SK

log = logging.getLogger(__name__)


@dataclass
class SplitResult:
    domains: list[str]
    output: str
    routed: DataFrame
    distribution: DataFrame
    reasons: DataFrame
    text_stats: DataFrame
    libraries: DataFrame
    balance: DataFrame
    suggestions: DataFrame

    def text_report(self) -> str:
        return SK.render_text_report(self.distribution, self.text_stats, self.reasons, self.libraries)

    def summary(self) -> dict:
        """Splitter summary: total, counts per domain, top-10 reasons."""
        return SK.split_summary(self.routed)

    def statistics(self) -> dict:
        """Per-domain statistics report (JSON-ready)."""
        return SK.statistics_summary(self.routed)

    def save_reports(self, spark: SparkSession, out_dir: str) -> None:
        """Text report, statistics JSON and distribution rows under ``out_dir``."""
        import json
        SK.write_text(spark, self.text_report(), f"{out_dir}/report_txt")
        SK.write_text(spark, json.dumps(self.statistics(), indent=2, ensure_ascii=False), f"{out_dir}/report_json")
        SK.write_json_report(self.distribution, f"{out_dir}/distribution")


def split_corpus(spark: SparkSession, input_path: str, out_dir: str,
                 domains: Sequence[str] = R.SPLIT_DOMAINS, default_domain: str = R.SPLIT_DEFAULT_DOMAIN,
                 create_misc: bool = False, sample_size: int | None = None, fmt: str | None = None,
                 rules: str = "chain") -> SplitResult:
    """Route every item of ``input_path`` and write ``out_dir/domain=<d>/``; return the reports.

    ``rules='chain'`` uses the ordered classifier chain (C6), ``rules='imports'`` the
    import-based chain with library-level buckets (C7).
    """
    doms = S.validate_split_args(spark, input_path, domains, default_domain, create_misc)
    items = S.read_items(spark, input_path, fmt=fmt, sample_size=sample_size)
    if rules == "chain":
        routed = C.classify_chain(items, doms, default_domain, keep=None, with_score=False)
    elif rules == "imports":
        routed = C.classify_imports(items, doms, default_domain, keep=None)
    else:
        raise ValueError(f"unknown rule set {rules!r}")
    table = scratch_path(spark, "routed")
    routed.select("item_id", "domain", "reason", "prompt", "code", "library", "raw").write.parquet(table)
    routed = spark.read.parquet(table)
    SK.write_domains(routed, out_dir, domains=doms)
    dist = A.domain_distribution(routed, doms)
    if routed.limit(1).count() == 0:
        log.warning("No items processed: the input is neither JSON lines nor a JSON array of objects.")
    return SplitResult(
        domains=doms, output=out_dir, routed=routed, distribution=dist,
        reasons=A.reason_top(routed, k=10), text_stats=A.domain_text_stats(routed),
        libraries=A.domain_top_libraries(routed), balance=A.balance_summary(routed),
        suggestions=A.balance_suggestions(routed))
