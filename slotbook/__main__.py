"""Command line: list the registered jobs, or run one and write its result.

    python -m slotbook list
    python -m slotbook run KEY --data DIR [--out PATH] [--show N] [--explain]

Under ``spark-submit`` the session (master, memory, checkpoint folder) comes
from the cluster configuration; run directly, a local session is started.
"""

from __future__ import annotations

import argparse
import os
import sys


def _session():
    from pyspark.sql import SparkSession

    from slotbook.session import BASE_CONF, ensure_checkpoint_dir, local_session
    if os.environ.get("SPARK_ENV_LOADED") or SparkSession.getActiveSession() is not None:
        builder = SparkSession.builder.appName("slotbook")
        for k, v in BASE_CONF.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        ensure_checkpoint_dir(spark)
        return spark
    return local_session()


def main(argv=None) -> int:
    from slotbook.registry import all_oracle_sql, all_queries

    p = argparse.ArgumentParser(prog="slotbook")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list registered jobs")
    run = sub.add_parser("run", help="run one job")
    run.add_argument("key")
    run.add_argument("--data", required=True, help="folder with the input parquet tables")
    run.add_argument("--out", help="write the result as parquet here")
    run.add_argument("--show", type=int, default=0, help="print the first N rows")
    run.add_argument("--explain", action="store_true", help="print the formatted plan")
    args = p.parse_args(argv)

    queries = all_queries()
    if args.cmd == "list":
        sqls = all_oracle_sql()
        for k in sorted(queries):
            print(f"{k}{'' if k in sqls else '  (no oracle SQL)'}")
        return 0
    if args.key not in queries:
        print(f"unknown job {args.key!r}; see `python -m slotbook list`", file=sys.stderr)
        return 2
    spark = _session()
    df = queries[args.key](spark, args.data)
    if args.explain:
        df.explain("formatted")
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=False)
    if not args.out and not args.show and not args.explain:
        df.write.format("noop").mode("overwrite").save()
    return 0


if __name__ == "__main__":
    sys.exit(main())
