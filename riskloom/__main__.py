"""Command line: scan a source tree, scan what changed in it, or curate a labelled corpus.

    python -m riskloom scan PATH [--output DIR]
    python -m riskloom changes PATH --state DIR --output DIR
    python -m riskloom curate CSV --output DIR [--language py]

With `spark-submit` the session of the cluster is used.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import jobs


def main() -> None:
    parser = argparse.ArgumentParser(prog="riskloom")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a folder of Python files")
    scan.add_argument("path")
    scan.add_argument("--output", "-o")
    changes = commands.add_parser("changes", help="scan the files changed since the last call")
    changes.add_argument("path")
    changes.add_argument("--state", "-s", required=True)
    changes.add_argument("--output", "-o", required=True)
    curate = commands.add_parser("curate", help="curate a labelled CSV corpus")
    curate.add_argument("path")
    curate.add_argument("--output", "-o", required=True)
    curate.add_argument("--language", default="py")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    if args.command == "scan":
        out = jobs.scan_corpus(spark, args.path, args.output)
        out["summary"].show(truncate=False)
        out["distribution"].show(truncate=False)
    elif args.command == "changes":
        print(jobs.scan_changes(spark, args.path, args.state, args.output))
    else:
        jobs.curate_corpus(jobs.load_labelled(spark, args.path), args.output,
                           args.language).show()


if __name__ == "__main__":
    main()
