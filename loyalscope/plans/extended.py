"""Analyses the reference documents without SQL (X1-X9, W9, V1), built from the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.measures import exact_ratio, nps_band, nps_score, pct, score_columns, tenths_to_score
from loyalscope.functions.tiers import nps_tier, sum_count_aggs, tier_count_aggs
from loyalscope.operators import checks, recovery, text, trend
from loyalscope.operators.benchmark import with_peers
from loyalscope.operators.cells import TOTAL, review_cells, rollup, segment_value
from loyalscope.operators.drivers import coverage, rank_order, with_impact
from loyalscope.operators.tagging import valid_ratings
from loyalscope.plans.core import (
    DRIVER_SETS,
    SINGLE_SETS,
    driver_rollup,
    driver_segments_from_cells,
    labels,
)
from loyalscope.session import stored
from loyalscope.sources.sentiment import adapt_sentiment_reviews

# Name of the three-way segment type and label of the grand-total row.
DEVICE_X_REGION_X_AGE = "device_type × region × age"
ALL = "all"


def segment_rollup(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """The four one-dimension tables and the grand total from one GROUPING SETS pass."""
    sets = (*SINGLE_SETS, (TOTAL, ()))
    rolled = rollup(review_cells(reviews, users), labels(), sets)
    value = F.when(F.col("segment_type") == TOTAL, F.lit(ALL)).otherwise(
        F.coalesce(segment_value(SINGLE_SETS), F.lit("unknown")))
    n, p, d = F.col("review_count"), F.col("promoters"), F.col("detractors")
    return rolled.select(
        "segment_type", value.alias("segment_value"), "review_count", "promoters", "passives",
        "detractors", nps_score(p, d, n).alias("nps_score"), pct(p, n).alias("promoter_pct"),
        pct(d, n).alias("detractor_pct"))


def device_region_nps(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Device x region, NULLs grouped and labelled ``unknown`` afterwards (as Q2)."""
    cells = review_cells(reviews, users)
    grouped = (cells.groupBy("device_type", "region").agg(*sum_count_aggs()))
    n, p, d = F.col("review_count"), F.col("promoters"), F.col("detractors")
    return grouped.select(
        F.coalesce("device_type", F.lit("unknown")).alias("device_type"),
        F.coalesce("region", F.lit("unknown")).alias("region"),
        "review_count", "promoters", "passives", "detractors",
        nps_score(p, d, n).alias("nps_score"), pct(d, n).alias("detractor_pct"))


def three_way_nps(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Every device x region x age bucket combination with its gap to the overall score and its
    impact (0 at or above it). Which of them are worst is the caller's ``orderBy``."""
    cells = review_cells(reviews, users)
    sets = ((DEVICE_X_REGION_X_AGE, ("device_type", "region", "age_bucket")),)
    scored = with_impact(driver_rollup(cells, sets), cells, sets)
    return scored.select(
        "device_type", "region", "age_bucket", "review_count", "nps_score",
        tenths_to_score(F.col("s10") - F.col("overall10")).alias("gap_vs_overall"), "detractor_pct",
        "negative_impact_score")


def driver_coverage(reviews: DataFrame, users: DataFrame, top: int = 3, min_n: int = 30) -> DataFrame:
    """Share of all reviews and of all detractors inside the union of the top drivers.

    The segments and the cells they cover are two readings of the same cells, so the cells are written
    once first (eager: the scan and the join run now, and once).
    """
    cells = stored(review_cells(reviews, users), "coverage-cells")
    lab = labels(device_null="unknown", age_null="unknown")
    labelled = (cells.select(*(e.alias(k) for k, e in lab.items()), "review_count", "promoters", "passives",
                             "detractors", "rating_sum").groupBy(*lab).agg(*sum_count_aggs()))
    best = driver_segments_from_cells(cells, min_n=min_n).orderBy(*rank_order()).limit(top)
    return coverage(labelled, best, DRIVER_SETS, list(lab), top=top).select(
        F.lit(top).alias("top_k"),
        "reviews_covered", "total_reviews",
        pct("reviews_covered", "total_reviews").alias("review_share_pct"),
        "detractors_covered", "total_detractors",
        pct("detractors_covered", "total_detractors").alias("detractor_share_pct"))


def nps_bands(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Every segment of the rollup (and the total) with its health band."""
    return segment_rollup(reviews, users).select(
        "segment_type", "segment_value", "review_count", "nps_score",
        nps_band("nps_score").alias("nps_band"))


def sentiment_adapter(sentiment_reviews: DataFrame, apps: DataFrame) -> DataFrame:
    """The sentiment file in the reviews schema."""
    return adapt_sentiment_reviews(sentiment_reviews, apps)


def sentiment_category_nps(sentiment_reviews: DataFrame, apps: DataFrame) -> DataFrame:
    """X5 end to end: NPS per app category of the adapted file (it has no users and no dates).

    Same rules as Q2's category table: NULL categories (apps missing from the app file) are grouped
    and labelled ``unknown`` afterwards.
    """
    adapted = valid_ratings(adapt_sentiment_reviews(sentiment_reviews, apps))
    counts = (adapted.select("category", nps_tier("rating").alias("nps_tier"), "rating")
              .groupBy("category").agg(*tier_count_aggs()))
    n, p, d = F.col("review_count"), F.col("promoters"), F.col("detractors")
    return counts.select(
        F.coalesce("category", F.lit("unknown")).alias("category"), "review_count", "promoters",
        "passives", "detractors", nps_score(p, d, n).alias("nps_score"))


def peer_gap_all(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Every segment's score less the unrounded mean score of its type, without a sample-size filter.

    The gap is an exact quotient of integers; nine decimals only drop the noise of binary fractions.
    """
    rolled = rollup(review_cells(reviews, users), labels(device_null="unknown", age_labels="short"), SINGLE_SETS).withColumns(score_columns())
    bench = with_peers(rolled)
    gap = exact_ratio(F.col("peer_n") * F.col("s10") - F.col("peer_sum"), F.col("peer_n") * 10, 9)
    return bench.select("segment_type", segment_value(SINGLE_SETS).alias("segment_value"), "review_count", "nps_score",
                        gap.alias("vs_segment_avg"))


def trend_endpoints(reviews: DataFrame) -> DataFrame:
    """First and last month and the change between them."""
    return trend.trend_endpoints(trend.monthly_counts(reviews))


def monthly_nps_interval(reviews: DataFrame, z: float = trend.Z_95) -> DataFrame:
    """Monthly NPS with a normal-approximation interval."""
    return trend.monthly_interval(trend.monthly_counts(reviews), z=z).orderBy("review_month")


def detractor_words(documents: DataFrame, labels_df: DataFrame) -> DataFrame:
    """Every word of detractor texts against all labelled texts."""
    return text.detractor_words(documents, labels_df)


def recovery_transitions(reviews: DataFrame) -> DataFrame:
    """Tier of each user's next review, per tier of the current one."""
    return recovery.recovery_transitions(reviews)


def input_checks(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """V1: constraint violations in both inputs."""
    return checks.input_checks(reviews, users)


def input_check_ids(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """V1: the ids that violate a constraint."""
    return checks.input_check_ids(reviews, users)


__all__ = [
    "segment_rollup", "device_region_nps", "three_way_nps", "driver_coverage", "nps_bands",
    "sentiment_adapter", "sentiment_category_nps", "peer_gap_all", "trend_endpoints", "monthly_nps_interval",
    "detractor_words", "recovery_transitions", "input_checks", "input_check_ids",
]
