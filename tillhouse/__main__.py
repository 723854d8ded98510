"""Run the pipeline or its checks: ``spark-submit`` or ``python -m tillhouse``.

    run --lake PATH (--parquet DIR | --jdbc URL | --events DIR) [--no-serve] [--only NAME ...]
    check {ingestion,bronze,gold,marts} --lake PATH [--mode cdc]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from tillhouse.plans import checks
from tillhouse.plans.pipeline import TABLES, build, load_changes, load_snapshot
from tillhouse.plans.run import lake_run
from tillhouse.plans.serving import serve
from tillhouse.session import configure, size_shuffles
from tillhouse.sources.lake import Lake
from tillhouse.sources.landing import jdbc_sources, parquet_sources


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tillhouse", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--lake", required=True)
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--parquet", help="folder with <table>.parquet for each source table")
    source.add_argument("--jdbc", help="database URL; the driver must be on the class path")
    source.add_argument("--events", help="folder that holds cdc/<topic>/<partition>/*.parquet")
    run.add_argument("--schema", default="pos", help="database schema of the source tables")
    run.add_argument("--wide-keys", action="store_true", help="64-bit ids")
    run.add_argument("--no-serve", action="store_true", help="stop after the lake layers")
    run.add_argument("--only", nargs="*", metavar="LAYER.TABLE", help="build only these tables")
    check = commands.add_parser("check")
    check.add_argument("layer", choices=["ingestion", "bronze", "gold", "marts"])
    check.add_argument("--lake", required=True)
    check.add_argument("--mode", choices=["snapshot", "cdc"], default="snapshot")
    return parser


def _step(name: str, work) -> None:
    started = time.perf_counter()
    work()
    print(f"{name} in {time.perf_counter() - started:.3f}s", file=sys.stderr)


def _run(spark: SparkSession, args) -> None:
    lake, now = Lake(spark, args.lake), datetime.now(UTC).replace(tzinfo=None)
    known = {f"{t.layer}.{t.name}" for t in TABLES}
    if unknown := sorted(set(args.only or ()) - known):
        raise SystemExit(f"no such table: {', '.join(unknown)}")
    if folder := args.events or args.parquet:
        size_shuffles(spark, folder)
    if args.events:
        _step("bronze", lambda: load_changes(lake, args.events, now, wide_keys=args.wide_keys))
    else:
        extracts = (
            parquet_sources(spark, args.parquet)
            if args.parquet
            else jdbc_sources(spark, args.jdbc, args.schema)
        )
        _step("ingestion and bronze", lambda: load_snapshot(lake, extracts, now, args.wide_keys))
    only = [tuple(name.split(".", 1)) for name in args.only] if args.only else None
    _step("silver, gold and mart", lambda: build(lake, now, only))
    if not args.no_serve:
        _step("serve", lambda: serve(lake))


def _check(spark: SparkSession, args) -> bool:
    lake = Lake(spark, args.lake)
    read, counts = lake_run(lake, datetime.now(UTC)).read, checks.published_counts(lake)
    frame = {
        "ingestion": lambda: checks.ingestion(read, args.mode, counts),
        "bronze": lambda: checks.row_counts(read, "bronze", counts=counts),
        "gold": lambda: checks.gold(read),
        "marts": lambda: checks.served_counts(read, counts=counts),
    }[args.layer]
    result = checks.evaluate({args.layer: frame})[args.layer]
    print(json.dumps(result, default=str))
    return result["passed"]


def main(arguments: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = configure(SparkSession.builder.appName("tillhouse").getOrCreate())
    if args.command == "run":
        _run(spark, args)
        return 0
    return 0 if _check(spark, args) else 1


if __name__ == "__main__":
    sys.exit(main())
