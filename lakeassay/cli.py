"""python -m lakeassay [investigate] PATH [-t COLUMN] [-o FILE] [--compact] [--markdown] [--summary]

Exit codes: 0 done, 1 the investigation failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] == "investigate":
        argv = argv[1:]
    parser = argparse.ArgumentParser(prog="lakeassay", description="Investigate the integrity of a table.")
    parser.add_argument("path")
    parser.add_argument("-t", "--target", help="column to predict, for leakage checks")
    parser.add_argument("-o", "--output", help="file to write; standard output if absent")
    parser.add_argument("--compact", action="store_true", help="JSON on one line")
    parser.add_argument("--markdown", action="store_true", help="a report instead of JSON")
    parser.add_argument("--summary", action="store_true", help="also a summary on standard error")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.output and Path(args.output).resolve() == Path(args.path).resolve():
        print("the output would overwrite the input", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.investigate import investigate_file
    from .plans.report import markdown, summary

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("lakeassay").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        d = investigate_file(spark, args.path, args.target)
    except Exception as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    text = markdown(d, args.target) if args.markdown else d.to_json(None if args.compact else 2) + "\n"
    if args.output:
        try:
            Path(args.output).parent.mkdir(parents=True, exist_ok=True)
            Path(args.output).write_text(text, encoding="utf-8")
        except OSError as e:
            print(f"the report could not be written: {e.strerror or type(e).__name__}", file=sys.stderr)
            return 1
        sys.stdout.write(summary(d) + f"written to {args.output}\n")
    else:
        sys.stdout.write(text)
    if args.summary:
        sys.stderr.write(summary(d))
    return 0
