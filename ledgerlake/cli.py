"""Command line: python -m ledgerlake.cli import|export|compact|vacuum ...

    import ROOT PATH [--environment E] [--resolve KEY] [--annotate [KEY]] [--delimiter D] [--json | --importer MODULE:CLASS] [--dry-run]
    export ROOT OUT  [--environment E] [--condition CCL] [--records 1,2] [--keys a,b] [--order "a desc, b"] [--size N] [--page N]
                     [--no-id] [--format csv|json|workbook]
    compact ROOT     [--environment E]
    vacuum ROOT      [--environment E]

A PATH of ``-`` is standard input, which the driver reads: for input that it can hold.
"""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Ledger
from .operators import order
from .operators.write import effective
from .plans.ccl import Page, parse
from .sources import files, importer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlake")
    sub = p.add_subparsers(dest="verb", required=True)
    i, e, *rest = [sub.add_parser(v) for v in ("import", "export", "compact", "vacuum")]
    for s in (i, e, *rest):
        s.add_argument("root")
        s.add_argument("--environment", default="default")
    i.add_argument("path")
    e.add_argument("path")
    i.add_argument("--importer")
    e.add_argument("--order")
    i.add_argument("--resolve")
    i.add_argument("--annotate", nargs="?", const="__datasource")
    i.add_argument("--delimiter", default=",")
    i.add_argument("--json", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    e.add_argument("--condition")
    e.add_argument("--records", type=lambda t: [int(x) for x in t.split(",")])
    e.add_argument("--keys", type=lambda t: t.split(","))
    e.add_argument("--size", type=int)
    e.add_argument("--page", type=int, default=1)
    e.add_argument("--no-id", action="store_true")
    e.add_argument("--format", choices=["csv", "json", "workbook"], default="csv")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    ledger = Ledger(spark, args.root, args.environment)
    if args.verb == "compact":
        ledger.compact()
        return 0
    if args.verb == "vacuum":
        return ledger.vacuum()
    return _import(spark, ledger, args) if args.verb == "import" else _export(ledger, args)


def _import(spark: SparkSession, ledger: Ledger, args: argparse.Namespace) -> int:
    version = ledger.new_record()
    if args.json or args.importer:
        resolve = args.resolve
        if args.importer:
            module, _, name = args.importer.partition(":")
            own = getattr(import_module(module), name)
            importer.register(spark, own)
            objects, resolve = spark.read.format(own.name).load(args.path), resolve or own.resolve_key
        elif args.path == "-":
            given = json.load(sys.stdin)
            objects = spark.createDataFrame([(json.dumps(o), "-") for o in (given if isinstance(given, list) else [given])], "object string, file string")
        else:
            read = spark.read.option("multiLine", True).json(args.path, primitivesAsString=True)
            objects = read.select(F.to_json(F.struct(*read.columns)).alias("object"), F.col("_metadata.file_path").alias("file"))
        new = importer.revisions(importer.numbered(objects, ledger, version, resolve), "_id", version, args.annotate)
    else:
        if args.path == "-":
            table = files.lines_as_table(spark, sys.stdin.read().splitlines(), args.delimiter)
            table = table.withColumn(args.annotate, F.lit("-")) if args.annotate else table
        else:
            table = files.read_delimited(spark, args.path, args.delimiter)
            table = table.select("*", F.col("_metadata.file_path").alias(args.annotate)) if args.annotate else table
        rows = files.record_numbers(table, version)
        if args.resolve:
            rows = files.resolve(rows, ledger.live(), args.resolve)
        new = _shred(rows, table.columns, version)
    done = effective(ledger.store.now(), new)
    if args.dry_run:
        return done.select("record").distinct().count()
    ledger.append(done)
    return 0


def _export(ledger: Ledger, args: argparse.Namespace) -> int:
    of = args.records if args.records else args.condition
    page = Page.number(args.page, args.size) if args.size else None
    by = parse(f"order by {args.order}").order if args.order else ()
    if args.format == "json":
        ledger.jsonify(ledger.find(of, by, page) if page or of else None, include_id=not args.no_id).select("json").write.text(args.path)
        return 0
    t = ledger.select(args.keys, of, order_by=by, page=page)
    keys = args.keys or sorted(r[0] for r in t.select("key").distinct().collect())
    out = files.export_table(t, keys)
    if by:
        out, columns, added = order.sort_columns(ledger.store, out, by)
        out = out.orderBy(*columns, *order.unsigned(F.col("record"))).drop(*added)
    out = out.drop("record") if args.no_id else out
    files.write_workbook(out, args.path) if args.format == "workbook" else files.write_delimited(out, args.path, ",")
    return 0


def _shred(rows, names: list[str], version: int):
    return files.shred_texts(rows.select(F.col("_id").alias("_rid"), *names), F.col("_rid"), version).filter("key <> '_rid'")


if __name__ == "__main__":
    run(SparkSession.builder.appName("ledgerlake").getOrCreate(), parser().parse_args(sys.argv[1:]))
