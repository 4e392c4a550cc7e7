"""Column expressions (built-in Spark functions only; no UDFs)."""

from loyalscope.functions.buckets import age_bucket, age_code, age_label, or_unknown
from loyalscope.functions.dates import parse_review_date, review_month
from loyalscope.functions.measures import (
    avg_star,
    exact_ratio,
    mean_score,
    mean_tenths,
    negative_impact,
    nps_band,
    nps_score,
    nps_tenths,
    pct,
    tenths_to_score,
)
from loyalscope.functions.tiers import nps_tier, nps_value, sum_count_aggs, tier_count_aggs

__all__ = [
    "age_bucket", "age_code", "age_label", "or_unknown", "parse_review_date", "review_month",
    "avg_star", "exact_ratio", "mean_score", "mean_tenths", "negative_impact", "nps_band",
    "nps_score", "nps_tenths", "pct", "tenths_to_score", "nps_tier", "nps_value",
    "sum_count_aggs", "tier_count_aggs",
]
