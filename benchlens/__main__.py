"""Command line: ``python -m benchlens report FOLDER --write TARGET | --show``.

``--write`` builds the report over every result file in FOLDER (S1-S3, P1-P3,
W1, A12/A13, F13/F14) and writes its tables under TARGET (K1-K3); ``--show N``
prints the first N rows of the lines table.  The Spark session is the one the
environment provides (``spark-submit`` settings); none is tuned here beyond the
shared checkpoint folder.
"""

from __future__ import annotations

import argparse
import platform
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="benchlens")
    report_args = ap.add_subparsers(dest="command", required=True).add_parser("report", help="tables over benchmark result files")
    report_args.add_argument("folder", help="where the result files lie (any store that Spark reads)")
    todo = report_args.add_mutually_exclusive_group(required=True)
    todo.add_argument("--write", metavar="TARGET", help="write all tables below this folder")
    todo.add_argument("--show", metavar="N", type=int, help="print N rows of the lines table")
    report_args.add_argument("--cluster", default=platform.node(), help="name of the measured cluster in task labels")
    report_args.add_argument("--subfolders", action="store_true", help="read files in folders below as well")
    args = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from .plans.report import report, write_report
    from .session import cleanup, ensure_checkpoint_dir
    spark = SparkSession.builder.appName("benchlens-report").getOrCreate()
    ensure_checkpoint_dir(spark)
    try:
        # writing every table: parse the documents once (written to the shared folder)
        rep = report(spark, args.folder, cluster=args.cluster, recursive=args.subfolders,
                     materialize=bool(args.write), host=platform.node())
    except ValueError as e:
        print(f"benchlens: {e}", file=sys.stderr)
        return 1
    if args.write:
        write_report(rep, args.write)
    else:
        rep.lines.orderBy("file").show(args.show, truncate=False)
    cleanup(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
