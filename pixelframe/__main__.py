"""Runs a registered query from the command line: ``python -m pixelframe QUERY DATA [--out FOLDER] [--rows N]``; ``list`` names them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.queries import QUERIES
from .sources.files import write_report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pixelframe", description=__doc__)
    parser.add_argument("query", help="name of a registered query, or list")
    parser.add_argument("data", nargs="?", help="folder with a parquet file for each table")
    parser.add_argument("--out", help="folder for the whole result as canonical JSON lines")
    parser.add_argument("--rows", type=int, default=20, help="rows to show where there is no --out")
    asked = parser.parse_args(argv)
    if asked.query == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if asked.query not in QUERIES or not asked.data:
        parser.print_usage(sys.stderr)
        return 2
    frame = QUERIES[asked.query](SparkSession.builder.getOrCreate(), asked.data)
    if asked.out:
        write_report(frame, asked.out)
    else:
        frame.show(asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
