"""The one-pass report equals the six standalone queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from loyalscope.plans.report import nps_report
from loyalscope.sources import fixtures as fx
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("materialize", [False, True])
def test_report_equals_standalone_queries(spark, materialize):
    reviews, users = fx.reviews_view(spark, SF), fx.user_attributes_view(spark, SF)
    report = nps_report(reviews, users, materialize=materialize)
    for name, df in report.items():
        want = entry.queries()[name](spark, SF)
        assert df.columns == want.columns, name
        assert rows_of(df, *df.columns) == rows_of(want, *want.columns), name


def test_batch_job_writes_every_report(spark, tmp_path):
    from pyspark.sql import functions as F

    from loyalscope.__main__ import run
    reviews = fx.reviews_view(spark, SF).withColumn("user_id", F.col("user_id").cast("string"))
    users = fx.user_attributes_view(spark, SF).withColumn("user_id", F.col("user_id").cast("string"))
    reviews.write.parquet(str(tmp_path / "reviews"))
    users.write.parquet(str(tmp_path / "users"))
    written = run(spark, str(tmp_path / "reviews"), str(tmp_path / "users"), str(tmp_path / "out"))
    assert len(written) == 6
    got = spark.read.parquet(str(tmp_path / "out" / "negative_drivers"))
    want = entry.queries()["negative_drivers"](spark, SF)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_batch_job_reads_csv_inputs(spark, tmp_path):
    from pyspark.sql import functions as F

    from loyalscope.__main__ import run
    reviews = fx.reviews_view(spark, SF).select(
        "review_id", "app_name", "category", "rating",
        F.date_format("review_date", "yyyy-MM-dd").alias("review_date"),
        F.col("user_id").cast("string").alias("user_id"))
    users = fx.user_attributes_view(spark, SF).withColumn("user_id", F.col("user_id").cast("string")).drop("nation")
    reviews.write.option("header", "true").csv(str(tmp_path / "reviews"))
    users.write.option("header", "true").csv(str(tmp_path / "users"))
    run(spark, str(tmp_path / "reviews"), str(tmp_path / "users"), str(tmp_path / "out"), fmt="csv")
    for name in ("negative_drivers", "monthly_trend", "overall_nps"):
        got = spark.read.parquet(str(tmp_path / "out" / name))
        want = entry.queries()[name](spark, SF)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns), name
