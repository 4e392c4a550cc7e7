"""Monthly NPS (A9) and its trend metrics.

The reviews are reduced to one row per month first (partial aggregation before the shuffle), so the
un-partitioned windows below only ever see one row per month: a few hundred rows for decades of
data, whatever the review volume. LAG and the 3-row frame count rows, not calendar months, so a
month without reviews is skipped rather than filled (T10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalscope.functions.dates import month_start, review_month
from loyalscope.functions.measures import mean_score, nps_score, nps_tenths, tenths_to_score
from loyalscope.functions.tiers import COUNT_COLUMNS, nps_tier, tier_count_aggs
from loyalscope.operators.tagging import valid_dated

# Labels of the trend columns.
FIRST_MONTH = "first_month"
IMPROVING = "improving"
DECLINING = "declining"
STABLE = "stable"
ABOVE_TREND = "above_trend"
BELOW_TREND = "below_trend"
# Fixed value: two-sided 95 % normal quantile for the monthly interval.
Z_95 = 1.96


def monthly_counts(reviews: DataFrame) -> DataFrame:
    """``review_month`` -> tier counts, over reviews with a rating and a date. Reads two columns.

    Rows are grouped by the month's first day as a DATE; the ``YYYY-MM-01`` text is built on the
    aggregated rows only.
    """
    counts = (valid_dated(reviews)
              .select(month_start("review_date").alias("month_start"),
                      nps_tier("rating").alias("nps_tier"), "rating")
              .groupBy("month_start").agg(*tier_count_aggs()))
    return counts.select(review_month("month_start").alias("review_month"), *COUNT_COLUMNS)


def monthly_trend(monthly: DataFrame, rolling: int = 3, threshold: float = 2.0, lag: int = 1) -> DataFrame:
    """Metrics against the row ``lag`` months of data earlier, on one row per month.

    Scores are compared and averaged as integer tenths: ``mom_delta`` of 8.3 -> 6.1 is exactly -2.2,
    a step of exactly 2.0 is ``stable``, and a month equal to its rolling mean is ``below_trend``.
    """
    lags, outputs = _trend_columns(rolling, int(round(threshold * 10)), lag)
    return (monthly.withColumn("s10", nps_tenths("promoters", "detractors", "review_count"))
            .withColumns(lags).select(*outputs))


def _trend_columns(rolling: int, step: int, lag: int) -> tuple[dict, list]:
    by_month = Window.orderBy("review_month")
    frame = by_month.rowsBetween(-(rolling - 1), Window.currentRow)
    running = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s10, prev10 = F.col("s10"), F.col("prev10")
    lags = {
        "prev10": F.lag("s10", lag).over(by_month),
        "roll_sum": F.sum("s10").over(frame),
        "roll_n": F.count("s10").over(frame),
        "cum_sum": F.sum("s10").over(running),
        "cum_n": F.count("s10").over(running),
    }
    outputs = [
        "review_month",
        F.col("review_count").alias("total_reviews"),
        "promoters", "passives", "detractors",
        nps_score("promoters", "detractors", "review_count").alias("nps_score"),
        tenths_to_score(prev10).alias("prev_month_nps"),
        tenths_to_score(s10 - prev10).alias("mom_delta"),
        mean_score("roll_sum", "roll_n").alias("rolling_3mo_avg"),
        mean_score("cum_sum", "cum_n").alias("cumulative_avg_nps"),
        F.rank().over(Window.orderBy(F.desc("s10"))).alias("nps_rank_best"),
        F.when(s10 * F.col("roll_n") > F.col("roll_sum"), ABOVE_TREND)
         .otherwise(BELOW_TREND).alias("vs_rolling_avg"),
        F.when(prev10.isNull(), FIRST_MONTH)
         .when(s10 > prev10 + step, IMPROVING)
         .when(s10 < prev10 - step, DECLINING)
         .otherwise(STABLE).alias("trend_direction"),
    ]
    return lags, outputs


def trend_endpoints(monthly: DataFrame) -> DataFrame:
    """First and last month of the period and the change between them (W9): one row."""
    s10 = nps_tenths("promoters", "detractors", "review_count")
    ends = monthly.agg(
        F.min("review_month").alias("first_month"),
        F.max("review_month").alias("last_month"),
        F.count(F.lit(1)).alias("months"),
        F.min_by(s10, "review_month").alias("first10"),
        F.max_by(s10, "review_month").alias("last10"),
    )
    return ends.select(
        "first_month", "last_month", "months",
        tenths_to_score("first10").alias("first_nps"),
        tenths_to_score("last10").alias("last_nps"),
        tenths_to_score(F.col("last10") - F.col("first10")).alias("nps_change"),
    )


def monthly_interval(monthly: DataFrame, z: float = Z_95) -> DataFrame:
    """Normal-approximation interval of each month's NPS.

    With p and d the promoter and detractor shares, NPS/100 = p - d has variance
    ((p + d) - (p - d)^2) / n; the bounds are 100 * (p - d) +- z * 100 * sqrt(variance), one decimal.
    """
    n = F.col("review_count")
    diff = (F.col("promoters") - F.col("detractors")).cast("double") / n
    share = (F.col("promoters") + F.col("detractors")).cast("double") / n
    margin = F.lit(round(z * 100.0, 10)) * F.sqrt((share - diff * diff) / n)
    center = diff * 100.0
    return monthly.select(
        "review_month",
        F.col("review_count").alias("total_reviews"),
        nps_score("promoters", "detractors", "review_count").alias("nps_score"),
        F.round(center - margin, 1).alias("nps_ci_low"),
        F.round(center + margin, 1).alias("nps_ci_high"),
    )
