"""python -m scoreloom COMMAND: the stages and the query catalogue from the command line; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .plans.catalogue import QUERIES
from .plans.stages import Stages
from .sources import cases as S

#: Commands of one stage and the settings that each takes.
STAGES = {
    "inspect": [], "index": [], "prepare": ["skip_errors"], "prototypes": [], "splits": ["strategy"], "train": [], "calibrate": ["prior_only", "rounds"],
    "evaluate": ["prior_only"], "ablation": [], "package": [], "predict": ["volume"], "run-all": ["strategy", "skip_errors", "skip_train", "rounds"],
}
FLAGS = {
    "skip_errors": {"action": "store_true", "help": "go on past unreadable volumes"}, "skip_train": {"action": "store_true", "help": "decode from the prior only"},
    "prior_only": {"action": "store_true", "help": "use prevalences as scores"}, "rounds": {"type": int, "default": 1, "help": "rounds of the threshold ascent"},
    "strategy": {"choices": ["stratified", "center"], "default": "stratified", "help": "how folds are made"},
    "volume": {"required": True, "help": "a volume to report on, or a folder of them"},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scoreloom")
    out.add_argument("--data", help="folder of cases, or of tables for query")
    out.add_argument("--work", default="work", help="folder of the stages' tables")
    out.add_argument("--config", help="settings of the stages, a JSON object")
    commands = out.add_subparsers(dest="command", required=True)
    for name, flags in STAGES.items():
        one = commands.add_parser(name)
        for f in flags:
            one.add_argument("--" + f.replace("_", "-"), **FLAGS[f])
    commands.add_parser("query").add_argument("name", choices=sorted(QUERIES))
    commands.add_parser("score-pairs").add_argument("pairs", help="JSON lines of prediction and reference")
    commands.add_parser("validate-output").add_argument("path", help="JSON output of one report")
    return out


def run(spark: SparkSession, args: argparse.Namespace):
    if args.command == "query":
        return QUERIES[args.name](spark, args.data)
    if args.command == "score-pairs":
        from .operators.metrics import caption_scores

        return caption_scores(S.read_pairs(spark, args.pairs).selectExpr("monotonically_increasing_id() as case_id", "prediction", "reference"))
    if args.command == "validate-output":
        raw = spark.read.text(args.path, wholetext=True)
        return S.challenge_output(raw.select(S.parse_output(raw["value"]).alias("report"))).select("report")
    known = {"least": 6, "most": 26, "least_support": 2, "shape": None, "spacing": None}
    stages = Stages(spark, args.work, args.data, **(S.overridden(S.load_config(args.config, known) if args.config else known)))
    return getattr(stages, args.command.replace("-", "_"))(**{f: getattr(args, f) for f in STAGES[args.command]})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"scoreloom {args.command}").getOrCreate()
    try:
        for row in run(spark, args).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str))
    except (ValueError, OSError, PySparkException) as wrong:
        print(f"scoreloom: {wrong}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
