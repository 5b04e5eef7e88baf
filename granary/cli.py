"""Command line: plan, run and resume, evaluate, release, review, query, verify, stress. Exit codes: 0 done, 1 failed checks, 2 usage, 3 a source breaks its format."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from granary.sources.records import SourceError


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="Parquet path; without it twenty rows are shown")
    pl = sub.add_parser("plan", help="cells and quotas of a JSON spec with axes and a target size")
    pl.add_argument("spec")
    pl.add_argument("--target", type=int, required=True)
    s = sub.add_parser("check-seeds", help="read JSON-lines seeds and report what breaks their format")
    s.add_argument("paths", nargs="+")
    v = sub.add_parser("verify", help="hash a release again")
    v.add_argument("path")
    for name, what in (("run", "start a run with the offline backend, or go on with it"), ("resume", "go on with the latest run"), ("evaluate", "metrics of a run"), ("release", "write a release of a run, if the gate passes")):
        r = sub.add_parser(name, help=what)
        r.add_argument("spec")
        r.add_argument("root")
        r.add_argument("--run", default=None)
        r.add_argument("--rounds", type=int, default=3)
        r.add_argument("--version", default="v1")
        r.add_argument("--waive", nargs="*", default=[])
    w = sub.add_parser("review", help="items of a queue that wait for a decision")
    w.add_argument("items", help="Parquet of n, content")
    w.add_argument("resolutions", help="Parquet of item_id, action, label, n")
    st = sub.add_parser("stress", help="failure scenarios")
    st.add_argument("root")
    sub.add_parser("list", help="names of registered queries")
    return p


def _pipeline(spark, args) -> int:
    from granary.operators.generate import MockBackend
    from granary.plans.pipeline import Pipeline
    from granary.plans.spec import compile_spec, read_spec
    from granary.sources import store

    p = Pipeline(spark, args.root, compile_spec(read_spec(args.spec)), MockBackend())
    run_id = args.run or (store.latest_run(spark, args.root) if args.command != "run" else None) or "r1"
    if args.command in ("run", "resume"):
        end = p.run(run_id, args.rounds)
        print(json.dumps({"run": run_id, "end": end, "accepted": p.accepted(run_id).count()}))
        return int(end != "complete")
    if args.command == "evaluate":
        for r in p.evaluate(run_id).orderBy(F.col("is_total").desc(), "cell_id").collect():  # a row per cell of the plan
            print(json.dumps(r.asDict(), sort_keys=True))
        return 0
    try:
        print(p.release(run_id, args.version, tuple(args.waive)))
    except store.ReleaseError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = build_parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from granary.plans import registry
    from granary.session import get_spark

    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = spark or get_spark("granary")
    try:
        if args.command == "query":
            if args.name not in registry.QUERIES:
                print(f"no query {args.name}", file=sys.stderr)
                return 2
            df = registry.QUERIES[args.name](spark, args.folder)
            df.write.mode("errorifexists").parquet(args.out) if args.out else df.show(20, truncate=False)
        elif args.command == "plan":
            from granary.operators import planning

            with open(args.spec, encoding="utf-8") as f:
                axes = planning.resolve_axes(json.load(f)["axes"])
            for r in planning.apportion(planning.cross(spark, axes), args.target).orderBy("pos").collect():
                print(json.dumps({"cell_id": r["cell_id"], "quota": r["quota"], "params": r["params"]}))
        elif args.command in ("run", "resume", "evaluate", "release"):
            return _pipeline(spark, args)
        elif args.command == "review":
            from granary.sources import store

            items = store.queue_items(spark.read.parquet(args.items))
            for r in store.pending(items, spark.read.parquet(args.resolutions)).orderBy("n").toLocalIterator():
                print(json.dumps({"item_id": r["item_id"], "content": r["content"]}))
        elif args.command == "stress":
            from granary.plans import stress

            found = stress.all_scenarios(spark, args.root)
            print(stress.as_json(found))
            return int(any(found.values()))
        elif args.command == "check-seeds":
            from granary.sources.records import read_seeds

            print(read_seeds(spark, args.paths).count())
        elif args.command == "verify":
            from granary.sources.store import verify_release

            wrong = verify_release(spark, args.path)
            print("\n".join(wrong) or "unchanged")
            return int(bool(wrong))
    except SourceError as e:
        print(e, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
