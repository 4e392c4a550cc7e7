"""The six reference queries (Q1-Q6) as DataFrame plans.

Each function takes the ``reviews`` and ``user_attributes`` DataFrames and returns a lazy
DataFrame; nothing is collected. Q2, Q4, Q5 and Q6 share one physical shape: tagging join ->
base cells -> one GROUPING SETS pass -> a few hundred rows of scoring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.buckets import age_label, or_unknown
from loyalscope.functions.measures import avg_star, nps_score, pct, score_columns
from loyalscope.functions.tiers import sum_count_aggs, tier_count_aggs
from loyalscope.operators.benchmark import benchmark_columns, peer_benchmark
from loyalscope.operators.cells import CELL_KEYS, review_cells, rollup, segment_value
from loyalscope.operators.drivers import driver_columns, rank_order, rank_top, score_below_overall
from loyalscope.operators.tagging import tag_reviews, tag_with_users
from loyalscope.operators.trend import monthly_counts, monthly_trend

# Segment type names and the two-dimension label.
DEVICE = "device_type"
REGION = "region"
AGE = "account_age"
CATEGORY = "category"
DEVICE_X_AGE = "device × age"

DIMS = (DEVICE, REGION, AGE, CATEGORY)
SINGLE_SETS = ((DEVICE, ("device_type",)), (REGION, ("region",)),
               (AGE, ("age_bucket",)), (CATEGORY, ("category",)))


def labels(device_null: str = "keep", age_labels: str = "long", age_null: str = "veteran") -> dict:
    """Label expressions over cell keys.

    ``device_null='unknown'`` maps NULL device and region to ``'unknown'`` before grouping (one
    group with any literal ``'unknown'``); ``'keep'`` leaves them NULL. Category is never mapped.
    """
    dev, reg = F.col("device_type"), F.col("region")
    if device_null == "unknown":
        dev, reg = or_unknown(dev), or_unknown(reg)
    return {
        "device_type": dev,
        "region": reg,
        "age_bucket": age_label("age_code", labels=age_labels, null=age_null),
        "category": F.col("category"),
    }


# ---- Q1 ---------------------------------------------------------------------------------------

def overall_nps(reviews: DataFrame) -> DataFrame:
    """Q1: one row of totals over ratings 1..5 (out-of-range ratings are dropped)."""
    counts = tag_reviews(reviews, strict=True).agg(*tier_count_aggs())
    n, p, q, d = (F.col(c) for c in ("review_count", "promoters", "passives", "detractors"))
    return counts.select(
        n.alias("total_reviews"), "promoters", "passives", "detractors",
        pct(p, n).alias("promoter_pct"), pct(q, n).alias("passive_pct"),
        pct(d, n).alias("detractor_pct"), nps_score(p, d, n).alias("nps_score"),
    )


# ---- Q2 ---------------------------------------------------------------------------------------

def segment_nps(reviews: DataFrame, users: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Q2: NPS per value of every dimension in ``dims``, stacked.

    ``dims`` are ``device_type``, ``region``, ``account_age`` (buckets of ``account_age_days``),
    ``category`` and any other column of the users or the reviews (a name that both have is the
    users'). NULL values are grouped as NULL and labelled ``'unknown'`` afterwards, so a literal
    ``'unknown'`` and a NULL give two rows with the same label. A NULL age is a veteran here.
    """
    user_keys = [d for d in dims if d not in (*DIMS, *CELL_KEYS) and d in users.columns]
    extra_keys = [d for d in dims if d not in (*DIMS, *CELL_KEYS, *user_keys)]
    missing = [d for d in extra_keys if d not in reviews.columns]
    if missing:
        raise ValueError(f"no such dimension: {', '.join(missing)}")
    return segment_nps_from_cells(review_cells(reviews, users, extra_keys=extra_keys, user_keys=user_keys), dims)


def segment_nps_from_cells(cells: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Q2 from precomputed base cells (``review_cells``, or a stored cell table)."""
    known = labels()
    by_name = {d: known["age_bucket"] if d == AGE else known.get(d, F.col(d).cast("string")) for d in dims}
    sets = tuple((d, (d,)) for d in dims)
    rolled = rollup(cells, by_name, sets)
    return (rolled.select(
        "segment_type",
        F.coalesce(segment_value(sets), F.lit("unknown")).alias("segment_value"),
        "review_count", "promoters", "passives", "detractors",
        nps_score("promoters", "detractors", "review_count").alias("nps_score"))
        .orderBy("segment_type", "nps_score", F.asc_nulls_first("segment_value")))


# ---- Q3 ---------------------------------------------------------------------------------------

def monthly_nps_trend(reviews: DataFrame, rolling: int = 3, threshold: float = 2.0, lag: int = 1) -> DataFrame:
    """Q3: one row per month with lag, deltas, rolling and cumulative means, rank and direction."""
    # The trend windows have no partition keys, so their output is one partition already: sorting
    # within it orders the result without another exchange.
    return monthly_trend(monthly_counts(reviews), rolling=rolling, threshold=threshold, lag=lag) \
        .sortWithinPartitions("review_month")


# ---- Q4 ---------------------------------------------------------------------------------------

def device_age_nps(reviews: DataFrame, users: DataFrame, min_n: int = 20) -> DataFrame:
    """Q4: device x short age bucket, groups with at least ``min_n`` reviews. Device NULL stays NULL."""
    return device_age_nps_from_cells(review_cells(reviews, users), min_n=min_n)


def device_age_nps_from_cells(cells: DataFrame, min_n: int = 20) -> DataFrame:
    lab = labels(age_labels="short")
    grouped = (cells.select(lab["device_type"].alias("device_type"),
                            lab["age_bucket"].alias("age_bucket"),
                            "review_count", "promoters", "passives", "detractors", "rating_sum")
               .groupBy("device_type", "age_bucket").agg(*sum_count_aggs()))
    n, d = F.col("review_count"), F.col("detractors")
    return (grouped.where(n >= min_n).select(
        "device_type", "age_bucket", "review_count", "promoters", "detractors",
        nps_score("promoters", d, n).alias("nps_score"),
        pct(d, n).alias("detractor_pct"),
        avg_star("rating_sum", n).alias("avg_star_rating"))
        .orderBy("nps_score", F.asc_nulls_first("device_type"), "age_bucket"))


def tier_counts_by_device(reviews: DataFrame, users: DataFrame, style: str = "filter") -> DataFrame:
    """Q4's side forms (A4, A5): tier counts per device with CASE sums or FILTER counts."""
    tagged = tag_with_users(reviews, users)
    counts = tagged.groupBy("device_type").agg(*tier_count_aggs(style=style))
    return counts.select(
        F.lit("case_when" if style == "case" else "filter").alias("approach"),
        "device_type", F.col("review_count").alias("total"), "promoters", "passives", "detractors",
        nps_score("promoters", "detractors", "review_count").alias("nps_score"))


# ---- Q5 ---------------------------------------------------------------------------------------

def segment_benchmark(reviews: DataFrame, users: DataFrame, min_n: int = 20) -> DataFrame:
    """Q5: segments with ``n >= min_n`` against the overall score and their own peer group."""
    return segment_benchmark_from_cells(review_cells(reviews, users), min_n=min_n)


def segment_benchmark_from_cells(cells: DataFrame, min_n: int = 20) -> DataFrame:
    rolled = rollup(cells, labels(device_null="unknown", age_labels="short"), SINGLE_SETS) \
        .withColumns(score_columns())
    bench = peer_benchmark(rolled, cells, min_n=min_n)
    return (bench.select(
        "segment_type", segment_value(SINGLE_SETS).alias("segment_value"),
        "review_count", "nps_score", "detractor_pct", *benchmark_columns())
        .orderBy("vs_overall_nps", "segment_type", F.asc_nulls_first("segment_value")))


# ---- Q6 ---------------------------------------------------------------------------------------

DRIVER_SETS = (*SINGLE_SETS, (DEVICE_X_AGE, ("device_type", "age_bucket")))


def driver_segments_from_cells(cells: DataFrame, min_n: int = 30, sets=DRIVER_SETS) -> DataFrame:
    """Q6 before the cut: every segment with ``n >= min_n`` below the overall score, with its impact."""
    return score_below_overall(driver_rollup(cells, sets), cells, sets, min_n=min_n)


def driver_rollup(cells: DataFrame, sets=DRIVER_SETS) -> DataFrame:
    """The segments under Q6's labels (NULL dimensions and ages are ``'unknown'``) with their scores."""
    return rollup(cells, labels(device_null="unknown", age_null="unknown"), sets).withColumns(score_columns())


def negative_drivers(reviews: DataFrame, users: DataFrame, min_n: int = 30, top: int = 15) -> DataFrame:
    """Q6: the ``top`` segments that pull the overall score down most, by volume x gap."""
    return negative_drivers_from_cells(review_cells(reviews, users), min_n=min_n, top=top)


def negative_drivers_from_cells(cells: DataFrame, min_n: int = 30, top: int = 15) -> DataFrame:
    scored = driver_segments_from_cells(cells, min_n=min_n)
    return rank_top(scored, top=top).select(*driver_columns()).sortWithinPartitions(*rank_order())
