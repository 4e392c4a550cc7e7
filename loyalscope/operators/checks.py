"""Input checks (V1): one aggregate per table, stacked as ``check_name, violations, rows_checked``.

The documented constraints (unique review and user ids, ratings 1..5, every review's user known) are
never enforced by the queries, and a duplicated user id silently fans out the tagging join, so they
are counted here. Distinct counts are hash aggregates with map-side combining; both unmatched counts
come from one full outer join of per-user review counts with the distinct user ids. CSV rows that
failed to parse (``_corrupt_record``) are counted for each table whose reader kept that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.tiers import MAX_STARS, MIN_STARS
from loyalscope.sources.readers import CORRUPT


def _stack(one_row: DataFrame, checks: dict[str, Column], rows: Column) -> DataFrame:
    wide = one_row.agg(rows.alias("rows_checked"), *(c.alias(name) for name, c in checks.items()))
    long = wide.unpivot("rows_checked", list(checks), "check_name", "violations")
    return long.select("check_name", F.col("violations").cast("long"), F.col("rows_checked").cast("long"))


def input_checks(reviews: DataFrame, users: DataFrame) -> DataFrame:
    r, u = F.col("rating"), F.col("user_id")
    per_review = {
        "null_review_id": F.count_if(F.col("review_id").isNull()),
        "duplicate_review_id": F.count("review_id") - F.count_distinct("review_id"),
        "null_rating": F.count_if(r.isNull()),
        "rating_out_of_range": F.count_if(r.isNotNull() & ~r.between(MIN_STARS, MAX_STARS)),
        "null_review_date": F.count_if(F.col("review_date").isNull()),
        "null_user_id": F.count_if(u.isNull()),
    }
    if CORRUPT in reviews.columns:
        per_review["unparseable_row"] = F.count_if(F.col(CORRUPT).isNotNull())
    review_checks = _stack(reviews, per_review, F.count(F.lit(1)))
    per_user_row = {
        "duplicate_user_id": F.count("user_id") - F.count_distinct("user_id"),
        "null_account_age": F.count_if(F.col("account_age_days").isNull()),
        "null_device_type": F.count_if(F.col("device_type").isNull()),
        "null_region": F.count_if(F.col("region").isNull()),
    }
    if CORRUPT in users.columns:
        per_user_row["unparseable_user_row"] = F.count_if(F.col(CORRUPT).isNotNull())
    user_checks = _stack(users, per_user_row, F.count(F.lit(1)))
    # Unmatched ids in both directions from one full outer join of per-user review counts (combined
    # map-side, so a heavy user is one partial row per task) with the distinct user ids.
    per_user = reviews.where(u.isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    known = users.where(u.isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_copies"))
    n, copies = F.col("_n"), F.col("_copies")
    linked = per_user.join(known, "user_id", "full_outer").agg(
        F.coalesce(F.sum(F.when(copies.isNull(), n)), F.lit(0)).alias("unknown"),
        F.coalesce(F.sum(n), F.lit(0)).alias("reviews_with_user"),
        F.count_if(n.isNull()).alias("silent"),
        F.count(copies).alias("distinct_users"))
    link_checks = linked.select(F.explode(F.array(
        F.struct(F.lit("review_user_unknown").alias("check_name"), F.col("unknown").alias("violations"),
                 F.col("reviews_with_user").alias("rows_checked")),
        F.struct(F.lit("user_without_reviews").alias("check_name"), F.col("silent").alias("violations"),
                 F.col("distinct_users").alias("rows_checked")))).alias("c")).select(
        "c.check_name", F.col("c.violations").cast("long").alias("violations"),
        F.col("c.rows_checked").cast("long").alias("rows_checked"))
    return review_checks.unionByName(user_checks).unionByName(link_checks)


def input_check_ids(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """The ids behind V1's counts: ``check_name, id, n`` (ids as text, ``n`` rows of the table that holds them).

    Repeated review ids and user ids, user ids of reviews that the user table lacks, and users without a review.
    Every id is returned; NULL ids have no row here (``input_checks`` counts them). The per-user counts of both
    tables meet in one full outer join, and one pass over it finds the last three.
    """
    u = F.col("user_id")
    repeated = (reviews.where(F.col("review_id").isNotNull()).groupBy("review_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select(F.lit("duplicate_review_id").alias("check_name"), F.col("review_id").cast("string").alias("id"), "n"))
    written = reviews.where(u.isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("written"))
    known = users.where(u.isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("copies"))

    def found(name: str, when: Column, n: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("check_name"), n.alias("n")))

    w, c = F.col("written"), F.col("copies")
    hits = F.array_compact(F.array(found("duplicate_user_id", c > 1, c), found("review_user_unknown", c.isNull(), w),
                                   found("user_without_reviews", w.isNull(), c)))
    per_user = written.join(known, "user_id", "full_outer").select(u.cast("string").alias("id"), F.explode(hits).alias("hit"))
    return repeated.unionByName(per_user.select("hit.check_name", "id", "hit.n"))
