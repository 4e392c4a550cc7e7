"""Row-level steps: rating filters (P4) and the reviews-to-users join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.buckets import age_code
from loyalscope.functions.tiers import MAX_STARS, MIN_STARS, nps_tier, nps_value

USER_DIMENSIONS = ("device_type", "region", "account_age_days")


def valid_ratings(reviews: DataFrame, strict: bool = False) -> DataFrame:
    """Reviews with a rating; ``strict`` also drops ratings outside 1..5."""
    r = F.col("rating")
    return reviews.where(r.between(MIN_STARS, MAX_STARS) if strict else r.isNotNull())


def valid_dated(reviews: DataFrame) -> DataFrame:
    """Reviews with a rating and a (parseable) date."""
    return reviews.where(F.col("rating").isNotNull() & F.col("review_date").isNotNull())


def tag_reviews(reviews: DataFrame, strict: bool = True) -> DataFrame:
    """Every valid review with its tier label and +1/0/-1 value (Q1's first step)."""
    return (valid_ratings(reviews, strict=strict)
            .withColumns({"nps_tier": nps_tier("rating", strict=strict),
                          "nps_value": nps_value("rating")}))


def tag_with_users(reviews: DataFrame, users: DataFrame, strict: bool = False,
                   review_columns: tuple[str, ...] = ("review_id", "category", "rating"),
                   user_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rated reviews LEFT JOIN user attributes on ``user_id``, with tier and age code.

    Reviews without a matching user keep NULL attributes; users without reviews are dropped. Anonymous
    reviews (a NULL ``user_id``) can match nobody, so they go beside the join: a second scan reads them
    with a pushed ``IsNull``, which skips the row groups without any, and none of them is shuffled. The
    join's strategy is left to Spark: a broadcast when its size estimate is under the threshold, else a
    shuffle join that AQE turns into a broadcast once the user side's real size is known, and whose
    skewed partitions (a hot user) AQE splits into several tasks.
    ``user_columns`` are further user attributes to keep. A duplicated ``user_id`` in ``users`` fans the
    join out; ``input_checks`` reports it.
    """
    left = valid_ratings(reviews, strict=strict).select("user_id", *review_columns)
    right = users.select("user_id", *USER_DIMENSIONS, *user_columns)
    known = left.where(F.col("user_id").isNotNull()).join(right, "user_id", "left")
    nobody = {f.name: F.lit(None).cast(f.dataType) for f in right.schema if f.name != "user_id"}
    anonymous = left.where(F.col("user_id").isNull()).withColumns(nobody)
    return (known.unionByName(anonymous)
            .withColumns({"nps_tier": nps_tier("rating", strict=strict),
                          "age_code": age_code("account_age_days")}))
