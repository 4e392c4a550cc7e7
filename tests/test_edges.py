"""Hand-made edge rows: one test per semantic trap (T1-T13) and cut-off, plus the documented goldens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalscope.functions.buckets import age_bucket
from loyalscope.functions.measures import negative_impact, nps_band, nps_score, pct
from loyalscope.operators.checks import input_checks
from loyalscope.operators.drivers import rank_top
from loyalscope.operators.tagging import tag_reviews, tag_with_users
from loyalscope.operators.trend import monthly_trend, trend_endpoints
from loyalscope.plans import core
from loyalscope.sources.readers import read_reviews
from tests.conftest import make_reviews, make_users, rows_of

MONTHLY = T.StructType([
    T.StructField("review_month", T.StringType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("promoters", T.LongType()),
    T.StructField("passives", T.LongType()),
    T.StructField("detractors", T.LongType()),
    T.StructField("rating_sum", T.LongType()),
])


def monthly_with_scores(spark, tenths):
    """One month per score (in tenths), 1000 reviews each, promoters - detractors = score * 10."""
    rows = []
    for i, t in enumerate(tenths):
        p = (1000 + t) // 2 if t >= 0 else (1000 + t) // 2
        d = p - t
        q = 1000 - p - d
        assert q >= 0 and d >= 0
        rows.append((f"2022-{i + 1:02d}-01", 1000, p, q, d, 3000))
    return spark.createDataFrame(rows, MONTHLY)


# ---- T1: rounding of the documented example ----------------------------------------------------

def test_t1_documented_tie_rounds_to_11_5(spark):
    # The documented counts (4716 / 2713 / 3571 over 10,000) do not add up to 10,000; the measures
    # are checked on them as given. The two-term double formula would print 11.4 here.
    df = spark.createDataFrame([(10000, 4716, 2713, 3571)],
                               "n long, p long, q long, d long")
    row = df.select(pct("p", "n").alias("pp"), pct("q", "n").alias("qp"), pct("d", "n").alias("dp"),
                    nps_score("p", "d", "n").alias("s")).collect()[0]
    assert (row.pp, row.qp, row.dp, row.s) == (47.2, 27.1, 35.7, 11.5)


def test_t1_overall_on_real_rows(spark):
    ids = spark.range(10000)
    rating = (F.when(F.col("id") < 4716, 5).when(F.col("id") < 4716 + 2713, 3).otherwise(1)
              .cast("int"))
    reviews = ids.select(F.col("id").alias("review_id"), F.lit("a").alias("app_name"),
                         F.lit("Tools").alias("category"), rating.alias("rating"),
                         F.lit(dt.date(2022, 1, 1)).alias("review_date"),
                         F.lit("u").alias("user_id"))
    row = core.overall_nps(reviews).collect()[0]
    assert (row.total_reviews, row.promoters, row.passives, row.detractors) == (10000, 4716, 2713, 2571)
    assert (row.promoter_pct, row.passive_pct, row.detractor_pct, row.nps_score) == (47.2, 27.1, 25.7, 21.5)


# ---- T2: empty input -----------------------------------------------------------------------------

def test_t2_empty_input_gives_null_scores(spark):
    reviews, users = make_reviews(spark, []), make_users(spark, [])
    row = core.overall_nps(reviews).collect()[0]
    assert row.total_reviews == 0 and row.nps_score is None and row.promoter_pct is None
    assert core.segment_nps(reviews, users).count() == 0
    assert core.monthly_nps_trend(reviews).count() == 0
    assert core.segment_benchmark(reviews, users).count() == 0
    assert core.negative_drivers(reviews, users).count() == 0


# ---- T4: out-of-range ratings --------------------------------------------------------------------

def test_t4_strict_and_lax_tiers(spark):
    ratings = [None, 0, 1, 2, 3, 4, 5, 6]
    reviews = make_reviews(spark, [(r, "u1") for r in ratings])
    users = make_users(spark, [("u1", "iOS", "EU", 10)])
    q1 = core.overall_nps(reviews).collect()[0]
    assert (q1.total_reviews, q1.promoters, q1.passives, q1.detractors) == (5, 2, 1, 2)
    strict = rows_of(tag_reviews(reviews, strict=True), "rating", "nps_tier", "nps_value")
    assert strict == [(1, "detractor", -1), (2, "detractor", -1), (3, "passive", 0),
                      (4, "promoter", 1), (5, "promoter", 1)]
    lax = dict(rows_of(tag_with_users(reviews, users), "rating", "nps_tier"))
    assert lax == {0: "detractor", 1: "detractor", 2: "detractor", 3: "passive",
                   4: "promoter", 5: "promoter", 6: "promoter"}


# ---- T5: age buckets and cut-offs ----------------------------------------------------------------

def test_t5_age_bucket_variants(spark):
    ages = [None, 0, 30, 31, 90, 91, 365, 366]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = df.select("age",
                    age_bucket("age", "long", "veteran").alias("a"),
                    age_bucket("age", "short", "veteran").alias("b"),
                    age_bucket("age", "long", "unknown").alias("c")).collect()
    by_age = {r.age: (r.a, r.b, r.c) for r in got}
    assert by_age[None] == ("veteran (365d+)", "veteran", "unknown")
    assert by_age[30][1] == "new_user" and by_age[31][1] == "early"
    assert by_age[90][1] == "early" and by_age[91][1] == "established"
    assert by_age[365][1] == "established" and by_age[366][1] == "veteran"
    assert by_age[0][0] == "new_user (0-30d)"


# ---- J1: unmatched rows, T6: NULL dimensions -----------------------------------------------------

def test_unmatched_and_unknown_labels(spark):
    reviews = make_reviews(spark, [
        (5, "u_null_dev"), (1, "u_unknown_dev"), (3, "ghost", None), (4, "u_null_dev"),
    ])
    users = make_users(spark, [
        ("u_null_dev", None, "EU", 400), ("u_unknown_dev", "unknown", "EU", 400),
        ("u_silent", "iOS", "EU", 5),
    ])
    q2 = core.segment_nps(reviews, users).where("segment_type = 'device_type'")
    devices = rows_of(q2, "segment_value", "review_count")
    # NULL device (u_null_dev twice + the unmatched ghost) and literal 'unknown' stay two groups
    assert devices == [("unknown", 1), ("unknown", 3)]
    q2_cat = rows_of(core.segment_nps(reviews, users).where("segment_type = 'category'"),
                     "segment_value", "review_count")
    assert q2_cat == [("Tools", 3), ("unknown", 1)]
    q5 = core.segment_benchmark(reviews, users, min_n=0)
    q5_dev = rows_of(q5.where("segment_type = 'device_type'"), "segment_value", "review_count")
    assert q5_dev == [("unknown", 4)]
    q5_cat = [r.segment_value for r in q5.where("segment_type = 'category'").collect()]
    assert None in q5_cat
    # the silent user adds nothing
    assert core.overall_nps(reviews).collect()[0].total_reviews == 4


# ---- T12: the two sample-size thresholds ---------------------------------------------------------

def test_t12_sample_thresholds(spark):
    rows, users = [], []
    for dev, n, rating in (("A", 19, 5), ("B", 20, 5), ("C", 29, 1), ("D", 30, 1)):
        users.append((f"user_{dev}", dev, "EU", 1000))
        rows += [(rating, f"user_{dev}")] * n
    reviews, users = make_reviews(spark, rows), make_users(spark, users)
    q4 = rows_of(core.device_age_nps(reviews, users), "device_type", "review_count")
    assert q4 == [("B", 20), ("C", 29), ("D", 30)]
    q5 = rows_of(core.segment_benchmark(reviews, users).where("segment_type = 'device_type'"),
                 "segment_value")
    assert q5 == [("B",), ("C",), ("D",)]
    q6 = rows_of(core.negative_drivers(reviews, users), "segment_type", "segment_label", "review_count")
    assert q6 == [("device × age", "D · veteran (365d+)", 30), ("device_type", "D", 30)]


# ---- T7: dates parsed once at the source ---------------------------------------------------------

def test_t7_malformed_dates_are_null(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text("review_id,app_name,category,rating,review_date,user_id\n"
                    "1,a,Tools,5,2022-01-15,u1\n2,a,Tools,4,bad,u1\n3,a,Tools,3,2022-02-30,u1\n"
                    "4,a,Tools,2,,u1\n5,a,Tools,1,2022-03-01,u1\n")
    reviews = read_reviews(spark, str(path), fmt="csv")
    dates = dict(rows_of(reviews, "review_id", "review_date"))
    assert dates == {1: dt.date(2022, 1, 15), 2: None, 3: None, 4: None, 5: dt.date(2022, 3, 1)}
    checks = dict(rows_of(input_checks(reviews, make_users(spark, [])), "check_name", "violations"))
    assert checks["null_review_date"] == 3 and checks["unparseable_row"] == 0
    months = rows_of(core.monthly_nps_trend(reviews), "review_month", "total_reviews", "prev_month_nps")
    # February has no valid review: March's previous month is January
    assert months == [("2022-01-01", 1, None), ("2022-03-01", 1, 100.0)]


# ---- T3: trend metrics in integer tenths ---------------------------------------------------------

def test_t3_trend_steps_and_rolling_golden(spark):
    trend = monthly_trend(monthly_with_scores(spark, [83, 61, 48, 92, 141, 183])).orderBy("review_month")
    got = trend.collect()
    assert [r.nps_score for r in got] == [8.3, 6.1, 4.8, 9.2, 14.1, 18.3]
    assert [r.rolling_3mo_avg for r in got] == [8.3, 7.2, 6.4, 6.7, 9.4, 13.9]
    assert got[1].mom_delta == -2.2
    assert got[1].trend_direction == "declining"      # 6.1 < 8.3 - 2
    assert got[0].trend_direction == "first_month"
    assert [r.nps_rank_best for r in got] == [4, 5, 6, 3, 2, 1]


def test_t3_exact_two_point_steps_are_stable(spark):
    for scores in ([101, 121], [-659, -639]):
        got = monthly_trend(monthly_with_scores(spark, scores)).orderBy("review_month").collect()
        assert got[1].mom_delta == 2.0
        assert got[1].trend_direction == "stable"


def test_flat_months_are_below_trend(spark):
    got = monthly_trend(monthly_with_scores(spark, [50, 50, 50])).collect()
    assert {r.vs_rolling_avg for r in got} == {"below_trend"}
    ends = trend_endpoints(monthly_with_scores(spark, [83, 61, 183])).collect()[0]
    assert (ends.first_nps, ends.last_nps, ends.nps_change, ends.months) == (8.3, 18.3, 10.0, 3)


# ---- M6 / W8: impact golden and rank ties --------------------------------------------------------

def test_impact_golden_and_dense_rank(spark):
    rows = [("s1", -399, 712), ("s2", -199, 1197), ("s3", -216, 3198), ("s4", -258, 2187),
            ("s5", -236, 641)]
    df = spark.createDataFrame(rows, "segment_label string, s10 long, review_count long")
    scored = df.select("segment_label", F.lit("x").alias("segment_type"), "review_count",
                       negative_impact("s10", F.lit(0), "review_count", F.lit(10000))
                       .alias("negative_impact_score"))
    impacts = dict(rows_of(scored, "segment_label", "negative_impact_score"))
    assert impacts == {"s1": 2.84, "s2": 2.38, "s3": 6.91, "s4": 5.64, "s5": 1.51}
    ranks = dict(rows_of(rank_top(scored, top=15), "segment_label", "impact_rank"))
    assert ranks == {"s3": 1, "s4": 2, "s1": 3, "s2": 4, "s5": 5}


def test_rank_ties_share_rank_and_cut_is_stable(spark):
    rows = [("b", 1.5), ("a", 1.5), ("c", 1.0)]
    df = spark.createDataFrame(rows, "segment_label string, negative_impact_score double") \
        .withColumn("segment_type", F.lit("x"))
    top = rank_top(df, top=1).collect()
    assert [(r.segment_label, r.impact_rank) for r in top] == [("a", 1)]
    ranks = dict(rows_of(rank_top(df, top=3), "segment_label", "impact_rank"))
    assert ranks == {"a": 1, "b": 1, "c": 2}


# ---- M7 bands, T13 types, V1 duplicate users -----------------------------------------------------

def test_health_bands(spark):
    df = spark.createDataFrame([(s,) for s in (-0.1, 0.0, 29.9, 30.0, 70.0, 70.1, None)], "s double")
    got = dict(rows_of(df.select("s", nps_band("s").alias("b")).where("s is not null"), "s", "b"))
    assert got == {-0.1: "needs_attention", 0.0: "acceptable", 29.9: "acceptable", 30.0: "good",
                   70.0: "good", 70.1: "excellent"}


def test_t13_count_and_score_types(spark):
    df = core.overall_nps(make_reviews(spark, [(5, "u")]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types["total_reviews"] == "bigint" and types["promoters"] == "bigint"
    assert types["nps_score"] == "double" and types["promoter_pct"] == "double"


def test_duplicate_user_is_reported_and_fans_out(spark):
    reviews = make_reviews(spark, [(5, "u1"), (1, "u2"), (3, None), (4, "ghost")])
    users = make_users(spark, [("u1", "iOS", "EU", 10), ("u1", "iOS", "EU", 10),
                               ("u2", "Android", "EU", None), ("u3", "iOS", "EU", 5)])
    checks = dict(rows_of(input_checks(reviews, users), "check_name", "violations"))
    assert checks["duplicate_user_id"] == 1
    assert checks["review_user_unknown"] == 1
    assert checks["user_without_reviews"] == 1
    assert checks["null_user_id"] == 1
    assert checks["null_account_age"] == 1
    assert tag_with_users(reviews, users).count() == 5


def test_unparseable_csv_rows_are_counted(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("review_id,app_name,category,rating,review_date,user_id\n"
                    "1,a,Tools,five,2022-01-15,u1\n2,a,Tools,4,2022-01-16,u1\n")
    reviews = read_reviews(spark, str(path), fmt="csv")
    checks = dict(rows_of(input_checks(reviews, make_users(spark, [])), "check_name", "violations"))
    assert checks["unparseable_row"] == 1 and checks["null_rating"] == 1


def test_user_attributes_csv_is_typed(spark, tmp_path):
    from loyalscope.sources.readers import read_user_attributes
    path = tmp_path / "users.csv"
    path.write_text("user_id,device_type,region,account_age_days\n"
                    "user_00042,iOS,North America,31\nuser_00043,Android budget,,\n")
    users = read_user_attributes(spark, str(path), fmt="csv")
    assert [f.dataType.simpleString() for f in users.schema.fields[:4]] == ["string", "string", "string", "int"]
    assert users.columns[4:] == ["_corrupt_record"]
    got = rows_of(users, "user_id", "region", "account_age_days")
    assert got == [("user_00042", "North America", 31), ("user_00043", None, None)]


def test_interval_of_a_unanimous_month_has_zero_width(spark):
    from loyalscope.operators.trend import monthly_interval
    df = spark.createDataFrame([("2022-01-01", 40, 40, 0, 0, 200), ("2022-02-01", 100, 50, 20, 30, 350)],
                               MONTHLY)
    got = {r.review_month: (r.nps_score, r.nps_ci_low, r.nps_ci_high) for r in monthly_interval(df).collect()}
    assert got["2022-01-01"] == (100.0, 100.0, 100.0)
    score, lo, hi = got["2022-02-01"]
    # p = .5, d = .3: variance (.8 - .04) / 100, margin 196 * sqrt(.0076) = 17.09 -> [2.9, 37.1]
    assert (score, lo, hi) == (20.0, 2.9, 37.1)


def test_empty_inputs_for_recovery_and_coverage(spark):
    from loyalscope.operators.recovery import recovery_transitions
    from loyalscope.plans import extended
    assert recovery_transitions(make_reviews(spark, [])).count() == 0
    # every review is a promoter: no segment is below the overall score, nothing is covered
    reviews = make_reviews(spark, [(5, "u1")] * 40)
    users = make_users(spark, [("u1", "iOS", "EU", 10)])
    row = extended.driver_coverage(reviews, users).collect()[0]
    assert (row.reviews_covered, row.total_reviews, row.review_share_pct) == (0, 40, 0.0)
    assert row.detractor_share_pct is None      # no detractors at all: the share is undefined
