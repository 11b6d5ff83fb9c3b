"""Jobs for spark-submit: ``ingest``, ``features``, ``train``, ``leads``, ``records``, ``thresholds``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from tallyscope.plans import ingest, nightly, scoring
from tallyscope.schemas import THRESHOLDS


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyscope", description=__doc__)
    parser.add_argument("--root", required=True, help="folder that holds all tables")
    jobs = parser.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("ingest", help="load CSV files")
    load.add_argument("--customers", required=True)
    load.add_argument("--transactions", required=True)
    load.add_argument("--labels")
    run = jobs.add_parser("features", help="compute all features for a day")
    run.add_argument("--date", type=dt.date.fromisoformat)
    for name, text in [("train", "train both models"), ("leads", "write the ranked leads"),
                       ("records", "show the nested score records")]:
        job = jobs.add_parser(name, help=text)
        job.add_argument("--product", default="home_loan")
        if name == "leads":
            job.add_argument("--min-score", type=float, default=0.0)
            job.add_argument("--role", default="rm")
    limits = jobs.add_parser("thresholds", help="change the gate's limits of a product")
    limits.add_argument("--product", default="home_loan")
    limits.add_argument("--max-dti", type=float)
    limits.add_argument("--min-vintage-months", type=int)
    limits.add_argument("--min-confidence", type=float)
    limits.add_argument("--role", default="admin")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"tallyscope-{args.job}").getOrCreate()
    if args.job == "ingest":
        ingest.ingest_all(spark, args.root, args.customers, args.transactions, args.labels)
    elif args.job == "features":
        print(nightly.run_nightly(spark, args.root, args.date))
    elif args.job == "train":
        print(scoring.train_models(spark, args.root, args.product))
    elif args.job == "leads":
        scoring.run_leads(spark, args.root, args.product, args.min_score, args.role).show()
    elif args.job == "thresholds":
        values = (args.product, args.max_dti, args.min_vintage_months, args.min_confidence)
        updates = spark.createDataFrame([values], THRESHOLDS)
        scoring.update_thresholds(spark, args.root, updates, args.role).show()
    else:
        scoring.score_records(spark, args.root, args.product).show(truncate=False)


if __name__ == "__main__":
    main()
