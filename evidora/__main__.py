"""Command line: python -m evidora STORE COMMAND ...; callables are named as module:function."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .config import Settings


def named(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evidora", description=__doc__)
    p.add_argument("store")
    p.add_argument("--embed", required=True)
    p.add_argument("--extract")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("path")
    ingest.add_argument("--mode", default="auto", choices=("auto", "md", "ocr", "pdf"))
    extract = sub.add_parser("extract")
    extract.add_argument("--limit", type=int)
    refit = sub.add_parser("refit")
    refit.add_argument("--force", action="store_true")
    refit.add_argument("--if-needed", action="store_true")
    undo = sub.add_parser("undo")
    undo.add_argument("--yes", action="store_true")
    undo.add_argument("--dry-run", action="store_true")
    ask = sub.add_parser("ask")
    ask.add_argument("question", nargs="+")
    catalog = sub.add_parser("catalog")
    catalog.add_argument("path")
    evaluate = sub.add_parser("evaluate")
    evaluate.add_argument("gold")
    adjudicate = sub.add_parser("adjudicate")
    adjudicate.add_argument("--decide", required=True)
    adjudicate.add_argument("--batch-size", type=int, default=20)
    adjudicate.add_argument("--once", action="store_true")
    check = sub.add_parser("check-gold")
    check.add_argument("gold")
    check.add_argument("--count", action="append", default=[], metavar="TYPE=N")
    seeds = sub.add_parser("seeds")
    seeds.add_argument("gold")
    tune = sub.add_parser("tune")
    tune.add_argument("gold")
    tune.add_argument("--choice", action="append", default=[], metavar="SETTING=A,B", help="values of a setting to try")
    sub.add_parser("vacuum")
    sub.add_parser("health")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from .operators.evaluate import gold, gold_problems
    from .plans.engine import Engine
    from .plans.evaluation import report, seed_similarities, tuned
    from .sources.store import catalog as write_catalog

    spark = SparkSession.builder.appName("evidora").getOrCreate()
    e = Engine(spark, a.store, named(a.embed), named(a.extract), Settings.from_env())
    failed = False
    if a.command == "ingest":
        out = e.ingest(a.path, a.mode)
    elif a.command == "extract":
        out = e.extract_pending(a.limit)
    elif a.command == "refit":
        out = e.refit(a.force, a.if_needed)
    elif a.command == "undo":
        out = e.undo_clusters(a.yes, a.dry_run)
    elif a.command == "ask":
        rows = spark.createDataFrame([(str(i), q) for i, q in enumerate(a.question)], "query_id string, question string")
        sources, trace = e.retrieve(rows)
        out = {"sources": [r.asDict() for r in sources.orderBy("query_id", "citation").collect()], "trace": [r.asDict() for r in trace.collect()]}
    elif a.command == "catalog":
        write_catalog(e._t("text_chunk"), a.path)
        out = {"written": a.path}
    elif a.command == "evaluate":
        out = report(e, gold(spark, a.gold))
    elif a.command == "adjudicate":
        out = e.adjudicate(named(a.decide), a.batch_size, a.once)
    elif a.command == "check-gold":
        counts = {k: int(v) for k, _, v in (c.partition("=") for c in a.count)}
        out = {"problems": [r.asDict() for r in gold_problems(gold(spark, a.gold), e._t("text_chunk").select("id"), counts).collect()]}
        failed = bool(out["problems"])
    elif a.command == "seeds":
        out = {"seeds": [r.asDict() for r in seed_similarities(e, gold(spark, a.gold)).orderBy("type", "label").collect()]}
    elif a.command == "tune":
        out = tuned(e, gold(spark, a.gold), **{k: [json.loads(x) for x in v.split(",")] for k, _, v in (c.partition("=") for c in a.choice)})
    elif a.command == "vacuum":
        out = {"deleted": e.store.vacuum()}
    else:
        out = e.health()
        failed = not out["ok"]
    json.dump(out, sys.stdout, indent=1, default=str)
    print()
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
