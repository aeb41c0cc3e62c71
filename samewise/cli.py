"""Command line: run, cross-match, init, analyze, show-group, remove."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from samewise import __version__
from samewise.operators import groups as G
from samewise.operators.match import FuzzyMatcher
from samewise.operators.rules import RuleBasedValidator
from samewise.plans import resolve as R
from samewise.sources import files


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("samewise")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="find duplicates in a table")
    cross = sub.add_parser("cross-match", help="match two tables")
    cross.add_argument("--input2", required=True)
    cross.add_argument("--id-column2", default="id")
    cross.add_argument("--name-column2", default="name")
    for x in (run, cross):
        x.add_argument("-i", "--input", required=True)
        x.add_argument("-o", "--output", required=True)
        x.add_argument("-c", "--config")
        x.add_argument("--id-column", default="id")
        x.add_argument("--name-column", default="name")
        x.add_argument("--threshold", type=float)
        x.add_argument("--scorer", default="ratio")
        x.add_argument("--validate", action="store_true")
        x.add_argument("--validator", choices=["rules", "none"], default="rules", help="what --validate uses")
        x.add_argument("-v", "--verbose", action="store_true", help="print the settings and counts of the run")
        x.add_argument("--no-resume", action="store_true")
    init = sub.add_parser("init", help="write a sample configuration")
    init.add_argument("-o", "--output", default="config.json")
    analyze = sub.add_parser("analyze", help="describe a saved result")
    analyze.add_argument("folder")
    analyze.add_argument("--format", choices=["json", "text"], default="text")
    show = sub.add_parser("show-group", help="members of an entity's group")
    show.add_argument("folder")
    show.add_argument("entity_id")
    remove = sub.add_parser("remove", help="write a table without duplicates")
    remove.add_argument("-i", "--input", required=True)
    remove.add_argument("-r", "--results", required=True)
    remove.add_argument("-o", "--output", required=True)
    remove.add_argument("--id-column", default="id")
    remove.add_argument("--strategy", choices=["first", "last", "highest_score"], default="first")
    return p


def _pipeline(args) -> R.DeduplicationPipeline:
    config = files.load_config(args.config) if args.config else {}
    matching = {"scorer": args.scorer, **config.get("matching", {})}
    if args.threshold is not None:
        matching["threshold"] = args.threshold
    rules = config.get("validation", {}).get("rules", {})
    validator = RuleBasedValidator(rules.get("min_score", 90.0), rules.get("metadata_rules", {})) if args.validate and args.validator == "rules" else None
    own = config.get("pipeline", {})
    if args.verbose:
        print(json.dumps({"matching": matching, "validator": args.validator if args.validate else "none", "pipeline": own}), file=sys.stderr)
    return R.DeduplicationPipeline(FuzzyMatcher(**matching), validator, bool(own.get("checkpoint", False)), own.get("checkpoint_dir", ".samewise_checkpoints"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        files.create_sample_config(args.output)
        return 0
    spark = spark or SparkSession.builder.appName("samewise").getOrCreate()
    if args.command == "run":
        result = _pipeline(args).run(files.load_data(spark, args.input), args.id_column, args.name_column, args.validate, not args.no_resume)
        R.save_dedup(result, args.output)
        print(json.dumps(result.statistics.first().asDict(), default=str))
    elif args.command == "cross-match":
        result = _pipeline(args).run_cross_dataset(files.load_data(spark, args.input), files.load_data(spark, args.input2), args.id_column, args.id_column2, args.name_column, args.name_column2, args.validate, not args.no_resume)
        R.save_cross(result, args.output)
        print(json.dumps(result.statistics.first().asDict(), default=str))
    elif args.command == "analyze":
        found = {r.measure: r.value for r in G.analyze(R.load_dedup(spark, args.folder).entity_groups).collect()}
        print(json.dumps(found) if args.format == "json" else "\n".join(f"{k}: {v:g}" for k, v in found.items() if v is not None))
    elif args.command == "show-group":
        result = R.load_dedup(spark, args.folder)
        kind = dict(result.entity_groups.dtypes)["entity_id"]
        for r in result.get_group(int(args.entity_id) if kind in ("bigint", "int") else args.entity_id).toLocalIterator():  # a part at a time
            print(f"{r.entity_id}\t{r.entity_name}")
    elif args.command == "remove":
        df = files.load_data(spark, args.input)
        cleaned = R.load_dedup(spark, args.results).remove_duplicates(df, args.id_column, args.strategy)
        files.save_data(cleaned, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
