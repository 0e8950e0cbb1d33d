"""python -m keyloom.cli plan | audit | apply --root DIR --registry FILE [--table NAME | --all] [--today DATE] [--pretty] [--confirm]"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.config import Registry, expand
from .plans.maintain import Maintenance
from .sources.catalog import Catalog


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="keyloom", description=__doc__)
    p.add_argument("command", choices=("plan", "audit", "apply"))
    p.add_argument("--root", required=True)
    p.add_argument("--registry", required=True)
    p.add_argument("--table")
    p.add_argument("--all", action="store_true")
    p.add_argument("--today", type=date.fromisoformat, default=None)
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--confirm", action="store_true")
    args = p.parse_args(argv)
    if not args.table and not args.all:
        p.error("name a table or give --all")
    if args.command == "apply" and not args.confirm:
        p.error("apply changes data: give --confirm")
    registry = Registry()
    registry.load(Path(args.registry).read_text())
    spark = spark or SparkSession.builder.appName("keyloom").getOrCreate()
    m = Maintenance(Catalog(spark, args.root), args.today or date.today())
    if args.command == "apply":
        out: object = asdict(m.run(registry, args.table))
    else:
        chosen = [c for c in registry if args.table in (None, c.table_name)]
        if not chosen:
            p.error(f"no such table: {args.table}")
        nodes = [n for c in chosen for n in expand(c) if args.command == "audit" or m.catalog.exists(n.table_name)]
        out = [asdict(m.report(n) if args.command == "plan" else m.audit(n)) for n in nodes]
    json.dump(out, sys.stdout, indent=2 if args.pretty else None, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
