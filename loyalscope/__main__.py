"""Batch job: read the two tables, compute every report from one pass, write each as parquet.

    spark-submit --py-files loyalscope.zip -m loyalscope \\
        --reviews s3://bucket/reviews/ --users s3://bucket/user_attributes/ --out s3://bucket/nps/

With ``--apps`` the reviews are the public sentiment file (CSV with quoted line breaks) and the app file; it has no
users and no dates, so ``overall_nps`` and ``category_nps`` are written.

Uses the session (and the cluster's ``spark.checkpoint.dir``) it is launched with. Each report is
written to ``<out>/<name>/`` with overwrite, so a rerun after a failure replaces partial output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from loyalscope.plans.core import overall_nps
from loyalscope.plans.extended import sentiment_category_nps
from loyalscope.plans.report import nps_report
from loyalscope.session import ensure_checkpoint_dir
from loyalscope.sources import adapt_sentiment_reviews
from loyalscope.sources.readers import read_apps, read_reviews, read_sentiment_reviews, read_user_attributes


def run(spark: SparkSession, reviews_path: str, users_path: str, out: str, fmt: str = "parquet",
        text_dates: bool = False) -> list[str]:
    """Every report of the reviews and users; ``text_dates`` for Parquet files with the documented text date."""
    ensure_checkpoint_dir(spark)
    reviews = read_reviews(spark, reviews_path, fmt=fmt, text_dates=text_dates)
    return _write(nps_report(reviews, read_user_attributes(spark, users_path, fmt=fmt)), out)


def run_sentiment(spark: SparkSession, reviews_path: str, apps_path: str, out: str, fmt: str = "csv") -> list[str]:
    """The reports that the sentiment file allows."""
    reviews, apps = read_sentiment_reviews(spark, reviews_path, fmt), read_apps(spark, apps_path, fmt)
    return _write({"overall_nps": overall_nps(adapt_sentiment_reviews(reviews, apps)),
                   "category_nps": sentiment_category_nps(reviews, apps)}, out)


def _write(reports: dict[str, DataFrame], out: str) -> list[str]:
    written = []
    for name, df in reports.items():
        target = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(target)
        written.append(target)
    return written


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loyalscope", description=__doc__.splitlines()[0])
    parser.add_argument("--reviews", required=True)
    side = parser.add_mutually_exclusive_group(required=True)
    side.add_argument("--users")
    side.add_argument("--apps", help="app file; the reviews are then the sentiment file")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", choices=("parquet", "csv"), help="default: parquet, or csv with --apps")
    parser.add_argument("--text-dates", action="store_true", help="review_date of the Parquet files is text")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("loyalscope-report").getOrCreate()
    if args.apps:
        paths = run_sentiment(spark, args.reviews, args.apps, args.out, fmt=args.format or "csv")
    else:
        paths = run(spark, args.reviews, args.users, args.out, fmt=args.format or "parquet", text_dates=args.text_dates)
    for path in paths:
        print(path)


if __name__ == "__main__":
    main()
