"""Command line: list the named queries, or run one and write its result.

    python -m linkloom list
    python -m linkloom run <query> <tables folder> <output folder> [--master local[8]]

The tables folder holds ``pages.parquet`` (and the other test tables); the
result is written as parquet (overwrite).  On a cluster, submit the same
module with ``spark-submit`` and leave ``--master`` out.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m linkloom")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the named queries")
    run = sub.add_parser("run", help="run one query and write parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("output")
    run.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from linkloom.plans.queries import QUERIES
    if args.cmd == "list":
        for name, fn in QUERIES.items():
            doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
            print(f"{name:24s} {doc}")
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m linkloom list`", file=sys.stderr)
        return 2
    from linkloom.session import get_session
    spark = get_session(args.master, app=f"linkloom-{args.query}")
    QUERIES[args.query](spark, args.tables).write.mode("overwrite").parquet(args.output)
    print(spark.read.parquet(args.output).count(), "rows written to", args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
