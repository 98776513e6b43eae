"""Command line: check and convert models, make and fill catalogs, insert, query and compare, and mine query logs."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .model import FLAT, NESTED, ModelError


def session(args: argparse.Namespace):
    from pyspark.sql import SparkSession

    from .sources import specs

    builder = SparkSession.builder.appName("prismal")
    for k, v in (specs.settings(args.conf) if args.conf else {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load_domain(path: str):
    from .sources import specs, xml_models

    return xml_models.domain(path, Path(path).stem) if path.lower().endswith(".xml") else specs.domain(path)


def load_design(path: str, domain: str | None, paradigm: str | None):
    from .sources import specs, xml_models

    if path.lower().endswith(".xml"):
        named = domain or f"{Path(path).parent}/{xml_models.referenced_domain(path)}.xml"
        return xml_models.design(path, load_domain(named), paradigm or FLAT)
    return specs.design(path, load_domain(domain) if domain else None, paradigm)


def tell(violations) -> int:
    for v in violations:
        print(f"{v.severity}: {v}")
    return int(any(v.severity == "error" for v in violations))


def domain_(args) -> int:
    from .plans import checks, describe
    from .sources import specs

    d = load_domain(args.path)
    if args.json:
        Path(args.json).write_text(json.dumps(specs.domain_json(d), indent=1), encoding="utf-8")
    if args.show:
        print(describe.domain(d))
    return tell(checks.check_domain(d))


def design_(args) -> int:
    from .operators.catalog import Catalog
    from .operators.migrate import migrate
    from .plans import checks, describe
    from .sources import specs, store

    x = load_design(args.path, args.domain, args.paradigm)
    if args.json:
        Path(args.json).write_text(json.dumps(specs.design_json(x), indent=1), encoding="utf-8")
    if args.show:
        print(describe.design(x))
    bad = tell(checks.check(x))
    if bad or not args.create:
        return bad
    spark = session(args)
    made = migrate(store.load(spark, args.source), x) if args.source else Catalog(spark, x)
    store.save(made, args.create, args.supersede)
    print(f"created {args.create}")
    return 0


def insert_(args) -> int:
    from .operators.insert import insert
    from .sources import specs, store

    catalog = store.load(session(args), args.catalog)
    for spec in specs.inserts(args.specs):
        catalog = insert(catalog, spec)
    if not args.dry:
        # the new rows are read from the old tables: write beside them, then take their place
        store.save(catalog, args.catalog + ".next", supersede=True)
        store.save(store.load(catalog.spark, args.catalog + ".next"), args.catalog, supersede=True)
    print("inserted" if not args.dry else "would be inserted")
    return 0


def query_(args) -> int:
    from .operators import report
    from .sources import specs, store

    catalog = store.load(session(args), args.catalog)
    lines = report.run(catalog, specs.queries(args.specs), args.cost, args.time, args.count, args.rows, args.repeat)
    for x in lines:
        print(f"{x.order}: {', '.join(x.tables)}" + (f"; cost {x.cost:.0f}" if x.cost is not None else "") + (f"; {x.seconds:.3f} s" if x.seconds is not None else "") + (f"; {x.count} rows" if x.count is not None else ""))
        for r in x.rows or ():
            print("  ", *r)
    if args.cost:
        print(f"weighted cost: {report.mean_cost(lines):.0f}")
    if args.time:
        print(f"weighted time: {report.mean_seconds(lines):.3f} s")
    if args.csv:
        report.write_csv(lines, args.csv)
    return 0


def log_(args) -> int:
    from .functions import workload
    from .sources import logs

    spark = session(args)
    if args.step in ("count", "fetch"):
        log = spark.read.parquet(args.log)
        if args.step == "count":
            print(logs.count(log, args.year, args.month, args.day).first()[0])
        else:
            logs.statements(log, args.year, args.month, args.day, args.limit).write.mode("overwrite").parquet(args.out)
        return 0
    statements = spark.read.parquet(args.log).select("statement") if Path(args.log).is_dir() or args.log.endswith(".parquet") else logs.read_text(spark, args.log)
    found, rejects = workload.parsed(statements)
    if args.step == "parse":
        found.write.mode("overwrite").json(args.out)
        rejects.write.mode("overwrite").json(args.out + ".rejects")
    else:
        workload.save(workload.grouped(found, args.threshold, args.jaccard, tuple(args.modifiers)), args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prismal", description=__doc__)
    p.add_argument("--conf", help="key=value lines for the Spark session")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("domain", help="check a domain (JSON or XML)")
    d.add_argument("path")
    d.add_argument("--json", help="write it as JSON")
    d.add_argument("--show", action="store_true")
    d.set_defaults(run=domain_)
    d = sub.add_parser("design", help="check a design, create its catalog")
    d.add_argument("path")
    d.add_argument("--domain")
    d.add_argument("--paradigm", choices=[FLAT, NESTED])
    d.add_argument("--json", help="write it as JSON")
    d.add_argument("--show", action="store_true")
    d.add_argument("--create", help="folder of the new catalog")
    d.add_argument("--source", help="catalog that the data come from")
    d.add_argument("--supersede", action="store_true")
    d.set_defaults(run=design_)
    d = sub.add_parser("insert", help="insert rows through the domain")
    d.add_argument("catalog")
    d.add_argument("specs")
    d.add_argument("--dry", action="store_true")
    d.set_defaults(run=insert_)
    d = sub.add_parser("query", help="run or compare queries")
    d.add_argument("catalog")
    d.add_argument("specs")
    d.add_argument("--rows", type=int, default=0)
    d.add_argument("--count", action="store_true")
    d.add_argument("--cost", action="store_true")
    d.add_argument("--time", action="store_true")
    d.add_argument("--repeat", type=int, default=1)
    d.add_argument("--csv")
    d.set_defaults(run=query_)
    d = sub.add_parser("log", help="a workload from a query log")
    d.add_argument("step", choices=["count", "fetch", "parse", "group"])
    d.add_argument("log")
    d.add_argument("--out", default="workload.json")
    for x in ("year", "month", "day", "limit"):
        d.add_argument(f"--{x}", type=int)
    d.add_argument("--threshold", type=float, default=0.005)
    d.add_argument("--jaccard", type=float, default=0.8)
    d.add_argument("--modifiers", nargs="*", default=[], choices=["distinct", "groupby", "orderby", "top"])
    d.set_defaults(run=log_)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except ModelError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
