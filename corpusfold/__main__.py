"""Command line: ``python -m corpusfold split --input corpus.jsonl --outdir out ...``.

Mirrors the splitter's flags; the work runs as Spark jobs (see ``plans/split.py``).
Exit code 1 on invalid arguments, as the splitter does.
"""

from __future__ import annotations

import argparse
import sys

from corpusfold.functions import rules as R


def _split(args: argparse.Namespace) -> int:
    from corpusfold.plans.split import split_corpus
    from corpusfold.session import build_session

    domains = [d.strip() for d in args.domains.split(",") if d.strip()]
    spark = build_session(args.master)
    try:
        res = split_corpus(spark, args.input, args.outdir, domains=domains, default_domain=args.default_domain,
                           create_misc=args.create_misc, sample_size=args.sample_size, fmt=args.format,
                           rules=args.rules)
    except ValueError as e:
        print(f"[ERROR] {e}")
        return 1
    print(res.text_report())
    bal = res.balance.collect()
    if bal:
        b = bal[0]
        state = "even" if b["is_balanced"] else "uneven"
        print(f"\nLargest to smallest domain: {b['imbalance_ratio']:.2f} ({state})")
    sugg = res.suggestions.collect()
    if sugg:
        print("\nDomains far from the mean:")
        for r in sugg:
            print(f"  {r['domain']}: {r['status']}, {r['cnt']} items of {r['pct']:.1f} %")
    if args.report_dir:
        res.save_reports(spark, args.report_dir)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusfold")
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("split", help="route a JSONL / JSON-array corpus into domain directories")
    s.add_argument("--input", default="dataset/corpus.jsonl")
    s.add_argument("--outdir", default="dataset/domains")
    s.add_argument("--domains", default=",".join(R.SPLIT_DOMAINS))
    s.add_argument("--create-misc", action="store_true")
    s.add_argument("--default-domain", default=R.SPLIT_DEFAULT_DOMAIN)
    s.add_argument("--sample-size", type=int, default=None)
    s.add_argument("--format", choices=["jsonl", "json_array"], default=None, help="skip format detection")
    s.add_argument("--rules", choices=["chain", "imports"], default="chain")
    s.add_argument("--report-dir", default=None, help="also write text / JSON reports here")
    s.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    args = p.parse_args(argv)
    if args.cmd == "split":
        return _split(args)
    return 2


if __name__ == "__main__":
    sys.exit(main())
