"""Batch jobs for spark-submit: ``python -m textinsight survey|sites ...``.

The model client is named by import path, for example ``--client mymodels:make_client``.
"""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import functions as F

from .operators.report import write_report, write_site_report
from .plans.sites import compare_sites
from .plans.survey import analyze_survey
from .session import build_session, cut_lineage
from .sources.pages import read_pages
from .sources.responses import lines_until_marker, read_lines, read_responses, read_responses_csv, strip_nonblank


def _client(path: str):
    module, name = path.split(":")
    return getattr(import_module(module), name)


def _answers(spark, args):
    if args.format == "csv":
        return read_responses_csv(spark, args.input, args.text_column)
    if args.format == "parquet":
        return read_responses(spark, args.input, args.id_column, args.text_column)
    # ids are given once and written out, before the marker join can reorder rows
    lines = read_lines(spark, args.input).repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    numbered = cut_lineage(lines.withColumn("response_id", F.monotonically_increasing_id()))
    lines = strip_nonblank(numbered, "line") if args.format == "pasted" else lines_until_marker(numbered, ["file"])
    return lines.select("response_id", F.col("line").alias("response"))


def _sending(args) -> dict:
    return {"ledger": args.ledger or f"{args.output}/ledger", "backoff": args.backoff, "retries": args.retries}


def survey(args) -> None:
    spark = build_session("survey insight")
    result = analyze_survey(
        _answers(spark, args), args.name, args.question, _client(args.client), args.clusters,
        max_keywords=args.keywords, **_sending(args),
    )
    write_report(result.report, f"{args.output}/report", args.name, args.question, args.report_format)
    result.clustered.write.mode("overwrite").parquet(f"{args.output}/clustered")
    result.keywords.write.mode("overwrite").parquet(f"{args.output}/keywords")


def sites(args) -> None:
    spark = build_session("site comparison")
    pairs = spark.read.parquet(args.pairs)
    lines = compare_sites(pairs, read_pages(spark, args.pages), _client(args.client), args.depth, args.max_pages,
                          **_sending(args))
    write_site_report(lines, args.output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textinsight")
    jobs = parser.add_subparsers(required=True)

    one = jobs.add_parser("survey", help="cluster answers and report on each cluster")
    one.add_argument("--input", required=True)
    one.add_argument("--format", choices=["csv", "parquet", "lines", "pasted"], default="csv")
    one.add_argument("--id-column", default="response_id")
    one.add_argument("--text-column", default="Response")
    one.add_argument("--name", required=True)
    one.add_argument("--question", required=True)
    one.add_argument("--clusters", type=int, default=3)
    one.add_argument("--keywords", type=int, default=15)
    one.add_argument("--report-format", choices=["text", "json", "parquet"], default="text")
    one.set_defaults(run=survey)

    two = jobs.add_parser("sites", help="walk, profile and compare pairs of sites")
    two.add_argument("--pages", required=True)
    two.add_argument("--pairs", required=True)
    two.add_argument("--depth", type=int, default=2)
    two.add_argument("--max-pages", type=int, default=10)
    two.set_defaults(run=sites)

    for job in (one, two):
        job.add_argument("--client", required=True, help="module:make_client")
        job.add_argument("--output", required=True)
        job.add_argument("--ledger", help="folder of replies that are paid for; by default one in the output")
        job.add_argument("--retries", type=int, default=2)
        job.add_argument("--backoff", type=float, default=1.0, help="seconds before the second try, then twice as long each")
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
