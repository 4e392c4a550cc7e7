"""Adapter for the public review file that carries a sentiment label instead of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentiment label -> star rating.
SENTIMENT_STARS = {"Positive": 5, "Neutral": 3, "Negative": 1}


def sentiment_rating(sentiment) -> F.Column:
    s = F.col(sentiment) if isinstance(sentiment, str) else sentiment
    expr = None
    for label, stars in SENTIMENT_STARS.items():
        expr = (F.when(s == label, stars) if expr is None else expr.when(s == label, stars))
    return expr.cast("int")


def adapt_sentiment_reviews(reviews: DataFrame, apps: DataFrame) -> DataFrame:
    """``App, Sentiment[, review_id]`` + ``App, Category`` -> the reviews schema.

    Category comes from a left join on ``App`` (apps missing from the app file keep a NULL
    category); the file has no date and no user, so those columns are typed NULLs. A row id is
    taken from ``review_id`` when the file has one, else generated (unique, not consecutive).
    The public app file lists some apps more than once; the smallest category name is kept so the
    join never fans out and the choice is deterministic.
    """
    app_dim = apps.groupBy("App").agg(F.min("Category").alias("category"))
    rid = (F.col("review_id").cast("long") if "review_id" in reviews.columns
           else F.monotonically_increasing_id())
    return (reviews.join(app_dim, "App", "left")
            .select(rid.alias("review_id"),
                    F.col("App").alias("app_name"),
                    F.col("category"),
                    sentiment_rating("Sentiment").alias("rating"),
                    F.lit(None).cast("date").alias("review_date"),
                    F.lit(None).cast("string").alias("user_id")))
