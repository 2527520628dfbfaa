"""Run registered jobs from the command line.

    python -m quarry list
    python -m quarry run <job> <sf_dir> [--out PATH] [--show N] [--master local[8]]

``--out`` writes the job's result as parquet (executors write, nothing is collected);
``--show`` prints the first N rows.
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ap = argparse.ArgumentParser(prog="quarry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("job")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=0)
    run.add_argument("--master")
    args = ap.parse_args(argv)

    from .plans import catalog
    jobs = catalog.queries()
    if args.cmd == "list":
        oracles = catalog.oracle_sql()
        for name in sorted(jobs):
            doc = (jobs[name].__doc__ or "").strip().splitlines()
            print(f"{name:34s} {'sql ' if name in oracles else 'rows'}  {doc[0] if doc else ''}")
        return 0
    from .session import get_spark
    spark = get_spark(args.master)
    df = jobs[args.job](spark, args.sf_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=80)
    if not args.out and not args.show:
        df.write.format("noop").mode("overwrite").save()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
