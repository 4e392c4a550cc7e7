"""Plan shape: one scan per input, no Python in the SQL queries, windows after aggregation."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from loyalscope.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SINGLE_PASS = ["overall_nps", "segment_nps", "monthly_trend", "device_age_nps", "segment_benchmark",
               "negative_drivers", "segment_rollup", "three_way_nps", "peer_gap_all"]


def _final_plan(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", SINGLE_PASS)
def test_reviews_are_scanned_once(spark, name):
    plan = _final_plan(spark, name)
    scans = [line for line in plan.splitlines() if "FileScan parquet [o_" in line]
    anonymous = [line for line in scans if "IsNull(o_custkey)" in line]
    assert len(scans) - len(anonymous) == 1
    assert len(anonymous) == ("Join" in plan and any("IsNotNull(o_custkey)" in line for line in scans))
    assert "Subquery subquery" not in plan


@pytest.mark.parametrize("name", SINGLE_PASS)
def test_no_python_in_sql_queries(spark, name):
    plan = _final_plan(spark, name)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan


def test_columns_are_pruned_at_the_scan(spark):
    df = entry.queries()["monthly_trend"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().toString()) or \
        re.search(r"FileScan parquet \[([^\]]*)\]", plan)
    assert schema is not None
    assert "o_orderpriority" not in schema.group(1) and "o_orderstatus" not in schema.group(1)


def test_monthly_windows_sit_above_the_aggregate(spark):
    plan = _final_plan(spark, "monthly_trend")
    window_at = plan.index("Window")
    agg_at = plan.index("HashAggregate", window_at)
    scan_at = plan.index("FileScan", window_at)
    assert agg_at < scan_at


def test_filters_and_columns_reach_a_parquet_reviews_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from loyalscope.plans import core
    from loyalscope.sources import fixtures as fx
    from loyalscope.sources.readers import read_reviews, read_user_attributes
    fx.reviews_view(spark, SF).withColumn("user_id", F.col("user_id").cast("string")) \
        .write.parquet(str(tmp_path / "reviews"))
    fx.user_attributes_view(spark, SF).withColumn("user_id", F.col("user_id").cast("string")) \
        .write.parquet(str(tmp_path / "users"))
    reviews = read_reviews(spark, str(tmp_path / "reviews"))
    users = read_user_attributes(spark, str(tmp_path / "users"))
    plan = core.segment_nps(reviews, users)._jdf.queryExecution().executedPlan().toString()
    review_scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "rating" in line]
    assert len(review_scans) == 2
    for review_scan, user in zip(review_scans, ("IsNotNull", "IsNull")):
        assert f"PushedFilters: [IsNotNull(rating), {user}(user_id)]" in review_scan
        assert "ReadSchema: struct<category:string,rating:int,user_id:string>" in review_scan
    monthly = core.monthly_nps_trend(reviews)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in monthly.splitlines() if "FileScan parquet" in line][0]
    assert "IsNotNull(review_date)" in scan and "ReadSchema: struct<rating:int,review_date:date>" in scan


@pytest.mark.parametrize("name,key", [("monthly_trend", "review_month"),
                                      ("negative_drivers", "negative_impact_score")])
def test_single_partition_results_are_ordered_without_a_range_exchange(spark, name, key):
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")
    values = [r[key] for r in df.collect()]
    assert values == sorted(values, reverse=(key == "negative_impact_score"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


#: Queries that write a table first, by their own account.
EAGER = {"driver_coverage", "csv_monthly_trend", "sentiment_file_nps", "parquet_segment_nps"}


@pytest.mark.parametrize("threshold", ["10MB", "64m", "-1"])
def test_building_a_query_runs_no_job_and_hints_no_table(spark, threshold):
    """Queries are lazy plans from their first build on; only rows bounded by the plan are broadcast by hint."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for name, fn in QUERIES.items():
            if name in EAGER:
                continue
            sc.setJobGroup(f"build-{name}-{threshold}", "build only")
            df = fn(spark, SF)
            assert sc.statusTracker().getJobIdsForGroup(f"build-{name}-{threshold}") == [], name
            if name in ("segment_nps", "tagged_with_users", "input_checks"):
                assert "strategy=broadcast" not in df._jdf.queryExecution().analyzed().toString()
                assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc.setJobGroup("after-build", "")


def test_segment_windows_and_single_tasks(spark):
    """No window over all segments of a type, and no single task below the top-k cut."""
    for name in ("segment_benchmark", "peer_gap_all", "three_way_nps"):
        assert "Window" not in _final_plan(spark, name)
    for name in ("negative_drivers", "driver_coverage"):
        plan = _final_plan(spark, name)
        assert "Window" not in plan[plan.index("TakeOrderedAndProject"):] if name == "negative_drivers" else "Window" not in plan


def test_hot_user_is_split_by_aqe_and_results_hold(spark):
    """A user with 40% of the reviews, shuffle join forced: AQE splits the hot partition."""
    import random

    from tests.conftest import make_reviews, make_users, rows_of
    from loyalscope.plans import core
    rnd = random.Random(5)
    reviews = make_reviews(spark, [(rnd.choice([1, 2, 3, 4, 5]),
                                    "hot" if rnd.random() < 0.4 else f"u{rnd.randrange(200)}",
                                    rnd.choice(["Tools", "Games"])) for _ in range(6000)])
    users = make_users(spark, [(f"u{i}", rnd.choice(["iOS", "Android"]), "EU", rnd.randrange(900))
                               for i in range(200)] + [("hot", "iOS", "NA", 10)])
    cols = ("segment_type", "segment_value", "review_count", "promoters", "detractors", "nps_score")
    want = rows_of(core.segment_nps(reviews, users), *cols)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for pre in (False, True):
            from loyalscope.operators.cells import review_cells
            df = core.segment_nps_from_cells(review_cells(reviews.repartition(8), users,
                                                          preaggregate=pre))
            assert rows_of(df, *cols) == want
            if not pre:
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert "SortMergeJoin(skew=true)" in plan and "skewed" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_bucketed_tables_join_without_shuffling_reviews(spark):
    from pyspark.sql import functions as F

    from loyalscope.operators.cells import review_cells
    from loyalscope.plans import core
    from loyalscope.sources import fixtures as fx
    from loyalscope.sources.layout import write_bucketed
    from tests.conftest import rows_of
    reviews = write_bucketed(fx.reviews_view(spark, SF), "bucketed_reviews", 8)
    users = write_bucketed(fx.user_attributes_view(spark, SF), "bucketed_users", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = review_cells(reviews, users)
        cells.collect()
        plan = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan
        assert "hashpartitioning(user_id" not in plan
        cols = ("segment_type", "segment_value", "review_count", "promoters", "detractors", "nps_score")
        assert rows_of(core.segment_nps_from_cells(cells), *cols) == \
            rows_of(core.segment_nps(fx.reviews_view(spark, SF), fx.user_attributes_view(spark, SF)), *cols)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS bucketed_reviews")
        spark.sql("DROP TABLE IF EXISTS bucketed_users")


def test_word_lift_tokenises_each_text_once(spark):
    """The totals of the lift read only doc_id; the text column is scanned once."""
    plan = _final_plan(spark, "detractor_words")
    doc_scans = set(re.findall(r"FileScan parquet \[(doc_id#\d+L(?:,text#\d+)?)\]", plan))
    assert sum(1 for s in doc_scans if "text" in s) == 1


def test_recovery_scans_the_reviews_once_in_one_python_pass(spark):
    plan = _final_plan(spark, "recovery_transitions")
    assert len(re.findall(r"MapInPandas ", plan)) == 1 and len(re.findall(r"FileScan parquet \[o_", plan)) == 1
