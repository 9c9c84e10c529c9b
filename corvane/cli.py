"""Command line: chunk, index, build, clean, roles, search."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, load_config
from .functions import text
from .operators import report
from .operators.retriever import Retriever, merge_collections
from .plans import build as steps


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    sub = out.add_subparsers(dest="command")
    for name in ("chunk", "index", "build", "clean"):
        sub.add_parser(name)
    for name in ("chunk", "build"):
        sub.choices[name].add_argument("--force", action="store_true", help="go on though input files are missing")
    r = sub.add_parser("roles", help="sample chunks of each role")
    r.add_argument("collection", choices=("code", "docs"))
    r.add_argument("-n", "--limit", type=int, default=2)
    r.add_argument("--output", help="file for the report")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-n", "--limit", type=int, help="by default as the settings say")
    s.add_argument("-v", "--verbose", action="store_true")
    mode = s.add_mutually_exclusive_group()
    mode.add_argument("--hybrid", action="store_true")
    mode.add_argument("--bm25", action="store_true")
    where = s.add_mutually_exclusive_group()
    where.add_argument("--code", action="store_true")
    where.add_argument("--docs", action="store_true")
    s.add_argument("--role")
    s.add_argument("--type")
    s.add_argument("--class-name")
    s.add_argument("--pythonic", nargs="?", const="true", choices=("true", "false"))
    return out


def filters(args: argparse.Namespace) -> dict[str, object]:
    given = {"role": args.role, "chunk_type": args.type, "class_name": args.class_name, "is_pythonic": args.pythonic and args.pythonic == "true"}
    return {k: v for k, v in given.items() if v is not None}


def search(engine: Retriever, args: argparse.Namespace) -> DataFrame:
    """Dense search unless a flag names another mode, in both collections unless one names one; code comes first on ties."""
    names = [n for n, wanted in ((engine.code, args.code or not args.docs), (engine.docs, args.docs or not args.code)) if wanted and n in engine.collections]
    if not names:
        raise SystemExit("no collection to search: run `index` first")
    find = engine.hybrid_search if args.hybrid else engine.bm25_search if args.bm25 else engine.search
    limit = args.limit or engine.limit
    return merge_collections([find(args.query, n, limit, filters(args) or None) for n in names], limit)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, config: Config | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.command:
        p.print_help()
        return 1
    config = config or load_config()
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    if args.command == "clean":
        print("removed:", *steps.clean(spark, config) or ["nothing"])
    if args.command in ("chunk", "index", "build"):
        return 0 if steps.build(spark, config, args.command == "chunk", args.command == "index", getattr(args, "force", False)) else 1
    if args.command == "roles":
        points = steps.chunks(spark, config, config.code_collection if args.collection == "code" else config.docs_collection)
        order = ("example_id", "chunk_no") if args.collection == "code" else ("vtk_class", "pos")
        lines = [f"{x['role']} | {x['chunk_id']} | {' '.join(x['synopsis'].split())}\n{x['content']}\n" + "".join(f"? {q}\n" for q in x["queries"]) for x in report.sample_by_role(points, args.limit, *order).collect()]
        lines += [f"{x['role']}: {x['samples']}" for x in report.roles(points, args.limit, *order).collect()]
        if args.output:
            Path(args.output).write_text("\n".join(lines) + "\n")
        else:
            print("\n".join(lines))
    if args.command == "search":
        rows = search(steps.retriever(spark, config), args)
        shown = rows.select("score", "collection", "chunk_id", "class_name", "role", text.preview("synopsis", 100).alias("synopsis"), *([text.preview("content", 200).alias("content")] if args.verbose else []))
        for r in shown.orderBy(F.desc("score")).collect():
            print(" | ".join(" ".join(str(x).split()) for x in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
