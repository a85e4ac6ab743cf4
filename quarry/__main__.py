"""python -m quarry COMMAND: predict, evaluate, fit, split, gates, audit, report, baseline, check, ablate, explain, ledger."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import evaluation
from .operators.report import match_health
from .operators.split import build_split
from .plans import jobs
from .plans.scratch import Scratch
from .sources import files
from .sources.ledger import LINES, SEED, ledger


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str, **options):
        p = sub.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n, default in options.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=default, **({"action": "store_true"} if default is False else {"type": type(default)}))

    command("predict", "data", "lines", "policy", "out", cold_start=False)
    command("evaluate", "data", "train", "policy", "out", cold_start=False, split="")
    command("fit", "data", "train", "out", split="")
    command("split", "train", "out")
    command("gates", "data", "train", "policy", "manifest", "out", split="", repeat=5)
    command("audit", "data", "out")
    command("report", "data", "first", "last", "out")
    command("baseline", "data", "first", "last", "out")
    command("check", "data", "first", "last", "golden", budget=10.0, repeat=5, strict=False)
    command("ablate", "data", "first", "last", limit=30.0)
    command("explain", "data", "first", "last")
    command("ledger", "out", seed=SEED, lines=LINES)
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "predict":
        jobs.predict(spark, a.data, a.lines, a.policy, a.out, a.cold_start)
    elif a.command == "evaluate":
        rows, lines = jobs.evaluated(spark, a.data, a.train, a.cold_start, a.split)
        policy = files.read_policy(spark, a.policy)
        for part in ("development", "validation", None):
            for name, df in jobs.measured(rows, lines, policy, part).items():
                files.write_json(df, f"{a.out}/{part or 'all'}/{name}")
    elif a.command == "fit":
        files.write_policy(jobs.fit(jobs.evaluated(spark, a.data, a.train, split_path=a.split)[0]), a.out)
    elif a.command == "gates":
        found = jobs.released(spark, a.data, a.train, a.policy, a.manifest, a.split, a.repeat)
        files.write_json(found, a.out)
        if not found.where("not passed").isEmpty():
            sys.exit(1)
    elif a.command == "split":
        lines, labels = files.read_order_lines(spark, a.train, labelled=True)
        files.write_json(build_split(Scratch(spark, "split"), lines.join(labels, "line_id")), a.out)
    elif a.command == "audit":
        files.write_json(evaluation.audit_catalogue(files.read_catalogue(spark, a.data)), f"{a.out}/catalogue")
        files.write_json(evaluation.audit_aliases(files.read_aliases(spark, f"{a.data}/customer_sku_map.csv")), f"{a.out}/aliases")
        files.write_json(files.manifest(spark, f"{a.data}/*.csv"), f"{a.out}/files")
    elif a.command in ("report", "baseline", "check", "ablate", "explain"):
        t = [spark.read.parquet(f"{a.data}/{n}") for n in ("tenants", "order_lines", "events", "items")]
        make = lambda names=None: match_health(*t, a.first, a.last, names)
        if a.command == "report":
            make().write.mode("overwrite").parquet(a.out)
        elif a.command == "baseline":
            jobs.baseline(make(), a.out)
        elif a.command == "check":
            verdict = jobs.check(spark, make, spark.read.parquet(a.golden), a.budget, a.repeat, a.strict)
            print(json.dumps(verdict))
            if not verdict["passed"]:
                sys.exit(1)
        elif a.command == "ablate":
            print(json.dumps(jobs.ablation(spark, make, a.limit)))
        else:
            print(jobs.explained(make()))
    else:
        for n, df in ledger(spark, a.seed, a.lines).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{n}")


if __name__ == "__main__":
    main()
