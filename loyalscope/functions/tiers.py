"""Star rating -> NPS tier (P1a, P1b, P2) and the per-tier counting aggregates (A2, A3, A4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loyalscope.functions.util import as_col

# The three NPS tiers and the star cut-offs of the 1-5 star proxy scale.
PROMOTER = "promoter"
PASSIVE = "passive"
DETRACTOR = "detractor"
PROMOTER_MIN_STARS = 4
PASSIVE_STARS = 3
DETRACTOR_MAX_STARS = 2
MIN_STARS = 1
MAX_STARS = 5
TIERS = (PROMOTER, PASSIVE, DETRACTOR)


def nps_tier(rating: Column | str, strict: bool = False) -> Column:
    """Tier label of a star rating.

    ``strict=True`` labels only ratings that fall in a tier's own star range and leaves anything else
    NULL; the default (lax) form sends every rating that is neither promoter nor passive to detractor,
    so 0 counts as a detractor and 6 as a promoter.
    """
    r = as_col(rating)
    tier = F.when(r >= PROMOTER_MIN_STARS, PROMOTER).when(r == PASSIVE_STARS, PASSIVE)
    if strict:
        return tier.when(r <= DETRACTOR_MAX_STARS, DETRACTOR)
    return tier.otherwise(DETRACTOR)


def nps_value(rating: Column | str) -> Column:
    """+1 promoter, 0 passive, -1 detractor (strict ranges, NULL otherwise)."""
    r = as_col(rating)
    return (F.when(r >= PROMOTER_MIN_STARS, 1).when(r == PASSIVE_STARS, 0)
            .when(r <= DETRACTOR_MAX_STARS, -1))


def tier_count_aggs(tier: Column | str = "nps_tier", rating: Column | str = "rating",
                    style: str = "filter", weight: Column | str | None = None) -> list[Column]:
    """``review_count, promoters, passives, detractors, rating_sum`` over tagged rows.

    ``style='filter'`` counts with ``count_if`` (SQL ``COUNT(*) FILTER (WHERE ...)``); ``style='case'``
    sums ``CASE WHEN ... THEN 1 ELSE 0 END``. Both are bigint and equal on every input.
    With ``weight``, each row stands for ``weight`` reviews (rows that were pre-aggregated).
    """
    t = as_col(tier)
    if weight is not None:
        w = as_col(weight)
        return [
            F.sum(w).cast("long").alias("review_count"),
            *(F.sum(F.when(t == name, w).otherwise(0)).cast("long").alias(alias)
              for name, alias in zip(TIERS, ("promoters", "passives", "detractors"))),
            F.sum(as_col(rating) * w).cast("long").alias("rating_sum"),
        ]
    if style == "filter":
        counts = [F.count_if(t == name) for name in TIERS]
    elif style == "case":
        counts = [F.sum(F.when(t == name, 1).otherwise(0)).cast("long") for name in TIERS]
    else:
        raise ValueError(f"unknown style {style!r}")
    return [
        F.count(F.lit(1)).alias("review_count"),
        counts[0].alias("promoters"),
        counts[1].alias("passives"),
        counts[2].alias("detractors"),
        F.sum(as_col(rating)).cast("long").alias("rating_sum"),
    ]


def sum_count_aggs(prefix: str = "") -> list[Column]:
    """Re-aggregate already counted cells: every tier count is additive."""
    return [F.sum(f"{prefix}{name}").cast("long").alias(name) for name in COUNT_COLUMNS]


COUNT_COLUMNS = ("review_count", "promoters", "passives", "detractors", "rating_sum")
