"""python -m panelwright check CONFIG | spread RUNS COLUMN... | noise RUNS | compare INCUMBENT CANDIDATE --ratio R

RUNS are Parquet or CSV tables of fold scores with the columns run, fold, score (spread: status and the named columns)."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("check").add_argument("config")
    spread = sub.add_parser("spread")
    spread.add_argument("runs")
    spread.add_argument("columns", nargs="+")
    sub.add_parser("noise").add_argument("runs")
    pair = sub.add_parser("compare")
    pair.add_argument("incumbent")
    pair.add_argument("candidate")
    pair.add_argument("--ratio", type=float, required=True, help="test periods over train periods")
    args = parser.parse_args(argv)

    if args.what == "check":
        from .plans.config import check, load_yaml

        problems = check(load_yaml(args.config))
        print("\n".join(problems) or "no problem found")
        return int(bool(problems))

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.tuning import aggregate_spread, compare, noise_floor

    spark = SparkSession.builder.appName("panelwright").getOrCreate()
    read = lambda p: spark.read.csv(p, header=True, inferSchema=True) if p.endswith(".csv") else spark.read.parquet(p)
    if args.what == "spread":
        out = aggregate_spread(read(args.runs), args.columns)
    elif args.what == "noise":
        out = noise_floor(read(args.runs).groupBy("run").agg(F.avg("score").alias("score")))
    else:
        out = compare(read(args.incumbent), read(args.candidate), args.ratio)
    for row in out.toJSON().collect():  # a row a column, or one row
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
