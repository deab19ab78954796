"""Command line: a discovery run over tables that are already collected.

    python -m harrow.cli companies.csv out.csv --search results.parquet --responses responses.parquet
"""

from __future__ import annotations

import argparse
import os
import sys
import time


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harrow", description="Find addresses of companies in collected web content.")
    p.add_argument("input_file", help="companies: CSV, JSON, Parquet or a sheet, with a column Company")
    p.add_argument("output_file", help="results, by ending: CSV, JSON lines, a sheet, else Parquet")
    p.add_argument("--search", required=True, help="table of search results")
    p.add_argument("--responses", required=True, help="table of page responses")
    p.add_argument("--bodies", help="table of sitemap bodies (url, body)")
    p.add_argument("--robots", help="table of robots.txt (domain, text)")
    p.add_argument("--config", help="file of NAME=value lines, which take precedence over the environment")
    p.add_argument("--suffixes", help="public suffix list in the registry's format, or 'bundled' for the one in Spark's HTTP client")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--workers", type=int, help="local threads, if no cluster is configured")
    p.add_argument("--save-domain-only", action="store_true", help="a row for domains without addresses, too")
    p.add_argument("--process-pdfs", action="store_true", help="do not leave out addresses of PDF files")
    p.add_argument("--domain-threshold", type=int)
    p.add_argument("--max-pages", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .config import Options, read_settings
    from .functions import urls
    from .operators import stats
    from .plans import discovery
    from .runtime import cut
    from .sources import readers, writers

    args = parser().parse_args(argv)
    try:
        options = Options.from_env(os.environ | (read_settings(args.config) if args.config else {}))
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    given = {"domain_score_threshold": args.domain_threshold, "max_fallback_pages": args.max_pages, "max_workers": args.workers}
    options = options.updated({k: v for k, v in given.items() if v is not None} | {"process_pdfs": args.process_pdfs})
    builder = SparkSession.builder.appName("harrow")
    if not os.environ.get("SPARK_REMOTE") and not os.environ.get("MASTER"):
        builder = builder.master(f"local[{options['MAX_WORKERS']}]")
    spark, began = builder.getOrCreate(), time.time()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    try:
        companies = readers.companies(spark, args.input_file)
        results = readers.search_results(spark, args.search)
        responses = spark.read.parquet(args.responses)
        good = urls.validate_url(F.col("url"), int(options["MAX_URL_LENGTH"])) & ~urls.domain_blocked(F.col("url"), options.blocked_domains)
        responses = responses.where(good if options.process_pdfs else good & ~urls.is_pdf(F.col("url")))
        bodies = spark.read.parquet(args.bodies) if args.bodies else spark.createDataFrame([], "url string, body binary")
        robots = spark.read.parquet(args.robots) if args.robots else spark.createDataFrame([], "domain string, text string")
        rules = readers.suffix_rules(spark, None if args.suffixes == "bundled" else args.suffixes) if args.suffixes else None
        rows, flags = discovery.run(
            companies, results, responses, bodies, robots,
            threshold=options["DOMAIN_SCORE_THRESHOLD"], parts=options.priority_parts, page_limit=int(options["MAX_FALLBACK_PAGES"]), save_domain_only=args.save_domain_only, process_pdfs=options.process_pdfs, rules=rules,
        )
        rows = cut(rows)  # written and summed up
        writers.results(rows, args.output_file)
        for name, value in stats.summary(flags, responses, rows, time.time() - began).head().asDict().items():
            print(f"{name:16} {value}")
    except readers.InputError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
