"""Every registered query as ``(spark, sf_dir) -> DataFrame`` over the fixture views.

Each callable reads the whole generated tables of ``sf_dir`` through the views of
``loyalscope.sources.fixtures``; the matching DuckDB SQL lives in ``loyalscope.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyalscope.functions.buckets import age_bucket, or_unknown
from loyalscope.operators.tagging import tag_reviews, tag_with_users
from loyalscope.plans import core, extended
from loyalscope.session import new_folder
from loyalscope.sources import fixtures as fx
from loyalscope.sources.readers import read_apps, read_reviews, read_sentiment_reviews, read_user_attributes

Query = Callable[[SparkSession, str], DataFrame]


def _ru(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.reviews_view(spark, sf_dir), fx.user_attributes_view(spark, sf_dir)


def tagged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1a, P2, P4a at row level."""
    return tag_reviews(fx.reviews_view(spark, sf_dir), strict=True).select(
        "review_id", "rating", "nps_tier", "nps_value")


def tagged_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, P1b, P3a-P3c, P5b at row level."""
    reviews, users = _ru(spark, sf_dir)
    tagged = tag_with_users(reviews, users, review_columns=("review_id", "category", "rating"))
    age = F.col("account_age_days")
    return tagged.select(
        "review_id", "user_id", "rating", "nps_tier", "device_type", "region", "account_age_days",
        age_bucket(age, "long", "veteran").alias("age_bucket"),
        age_bucket(age, "short", "veteran").alias("age_bucket_short"),
        age_bucket(age, "long", "unknown").alias("age_bucket_or_unknown"),
        or_unknown("device_type").alias("device_or_unknown"),
        or_unknown("region").alias("region_or_unknown"),
    )


def csv_monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews as a CSV file with text dates, some of them impossible, through the reader."""
    rows = fx.reviews_view(spark, sf_dir).withColumn("review_date", F.expr(fx.TEXT_DATE))
    path = new_folder(spark, "reviews-csv")
    rows.write.option("header", "true").csv(path)
    return core.monthly_nps_trend(read_reviews(spark, path, fmt="csv"))


def parquet_segment_nps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as Parquet files with text dates and text ids, through the readers."""
    reviews, users = _ru(spark, sf_dir)
    text_id = F.col("user_id").cast("string")
    folders = [new_folder(spark, name) for name in ("reviews-parquet", "users-parquet")]
    reviews.withColumns({"review_date": F.expr(fx.TEXT_DATE), "user_id": text_id}).write.parquet(folders[0])
    users.withColumn("user_id", text_id).write.parquet(folders[1])
    return core.segment_nps(read_reviews(spark, folders[0], text_dates=True), read_user_attributes(spark, folders[1]))


def sentiment_file_nps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment and app files as CSV with quoted line breaks, through the readers and the adapter."""
    folders = [new_folder(spark, name) for name in ("sentiment-csv", "apps-csv")]
    reviews = fx.sentiment_view(spark, sf_dir).select("App", F.expr(fx.SENTIMENT_TEXT).alias("Translated_Review"), "Sentiment")
    for rows, folder in zip((reviews, fx.apps_view(spark, sf_dir)), folders):
        rows.write.options(header="true", quoteAll="true", escape='"').csv(folder)
    return extended.sentiment_category_nps(read_sentiment_reviews(spark, folders[0]), read_apps(spark, folders[1]))


#: A review column, a user column and a bucket.
FREE_DIMS = ("app_name", "nation", "account_age")

QUERIES: dict[str, Query] = {
    "overall_nps": lambda s, d: core.overall_nps(fx.reviews_view(s, d)),
    "tagged_reviews": tagged_reviews,
    "tagged_with_users": tagged_with_users,
    "segment_nps": lambda s, d: core.segment_nps(*_ru(s, d)),
    "segment_nps_free_dims": lambda s, d: core.segment_nps(*_ru(s, d), dims=FREE_DIMS),
    "csv_monthly_trend": csv_monthly_trend,
    "parquet_segment_nps": parquet_segment_nps,
    "monthly_trend": lambda s, d: core.monthly_nps_trend(fx.reviews_view(s, d)),
    "device_age_nps": lambda s, d: core.device_age_nps(*_ru(s, d)),
    "tier_counts_case": lambda s, d: core.tier_counts_by_device(*_ru(s, d), style="case"),
    "tier_counts_filter": lambda s, d: core.tier_counts_by_device(*_ru(s, d), style="filter"),
    "segment_benchmark": lambda s, d: core.segment_benchmark(*_ru(s, d)),
    "negative_drivers": lambda s, d: core.negative_drivers(*_ru(s, d)),
    "segment_rollup": lambda s, d: extended.segment_rollup(*_ru(s, d)),
    "device_region_nps": lambda s, d: extended.device_region_nps(*_ru(s, d)),
    "three_way_nps": lambda s, d: extended.three_way_nps(*_ru(s, d)),
    "driver_coverage": lambda s, d: extended.driver_coverage(*_ru(s, d)),
    "nps_bands": lambda s, d: extended.nps_bands(*_ru(s, d)),
    "sentiment_adapter": lambda s, d: extended.sentiment_adapter(fx.sentiment_view(s, d),
                                                                 fx.apps_view(s, d)),
    "sentiment_category_nps": lambda s, d: extended.sentiment_category_nps(fx.sentiment_view(s, d),
                                                                           fx.apps_view(s, d)),
    "sentiment_file_nps": sentiment_file_nps,
    "peer_gap_all": lambda s, d: extended.peer_gap_all(*_ru(s, d)),
    "trend_endpoints": lambda s, d: extended.trend_endpoints(fx.reviews_view(s, d)),
    "detractor_words": lambda s, d: extended.detractor_words(fx.documents_view(s, d),
                                                             fx.labels_view(s, d)),
    "recovery_transitions": lambda s, d: extended.recovery_transitions(fx.reviews_view(s, d)),
    "monthly_nps_interval": lambda s, d: extended.monthly_nps_interval(fx.reviews_view(s, d)),
    "input_checks": lambda s, d: extended.input_checks(*_ru(s, d)),
    "input_check_ids": lambda s, d: extended.input_check_ids(*_ru(s, d)),
}
