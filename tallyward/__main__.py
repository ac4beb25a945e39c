"""Command line: audit saved catalogs, or compare two snapshots.

    python -m tallyward audit FOLDER_OR_FILE [--format terminal|json|sarif|markdown|html]
        [--output FILE] [--fail-on error|warning|info|never] [--snapshot FILE]
    python -m tallyward diff BEFORE AFTER [--format terminal|json|html] [--output FILE]

Exit codes: 0 fine, 1 findings at the gate or changes, 2 wrong usage or an incomplete result.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .functions.jsontext import JsonRefused
from .operators import diff, engine
from .operators.similarity import durable
from .sinks import reports
from .sources.catalog import parse, read_catalogs, tables

DIFFS = {"terminal": reports.comparison_text, "json": reports.comparison_json, "html": reports.comparison_html}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _put(text: str, path: str | None) -> None:
    if path:
        reports.write_report(path, text)
    else:
        print(text)


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    reports.check_paths([x for x in [args.output] if x], [args.path], args.snapshot)
    found = engine.audit(tables(durable(parse(read_catalogs(spark, args.path)))))
    renderers = {"terminal": reports.as_terminal, "json": lambda a: reports.as_json(a, _now()), "sarif": reports.as_sarif, "markdown": reports.as_markdown, "html": reports.as_html}
    _put(renderers[args.format](found), args.output)
    if args.snapshot:
        reports.write_snapshot(args.snapshot, diff.to_text(diff.snapshot_of(found.tables, _now())))
    if found.summary.isEmpty() or not found.summary.where("NOT complete").isEmpty():
        return 2
    return 0 if args.fail_on == "never" else reports.exit_code(not engine.should_fail(found.summary, args.fail_on).where("failed").isEmpty())


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    reports.check_paths([x for x in [args.output] if x], [args.before, args.after])
    sides = []
    for path in (args.before, args.after):
        with open(path, encoding="utf-8") as f:
            sides.append(diff.from_text(spark, f.read()))
    found = diff.compare(*sides)
    _put(DIFFS[args.format](found), args.output)
    return found.exit_code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyward", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("audit")
    one.add_argument("path")
    one.add_argument("--format", choices=["terminal", "json", "sarif", "markdown", "html"], default="terminal")
    one.add_argument("--fail-on", choices=["error", "warning", "info", "never"], default="error")
    one.add_argument("--snapshot")
    two = commands.add_parser("diff")
    two.add_argument("before")
    two.add_argument("after")
    two.add_argument("--format", choices=list(DIFFS), default="terminal")
    for p in (one, two):
        p.add_argument("--output")
    args = parser.parse_args(argv)  # exits with 2 on wrong usage
    spark = spark or SparkSession.builder.appName("tallyward").getOrCreate()
    try:
        return audit(spark, args) if args.command == "audit" else compare(spark, args)
    except (JsonRefused, OSError, ValueError) as e:
        print(f"tallyward: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
