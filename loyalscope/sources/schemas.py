"""Explicit input schemas: nothing is inferred."""

from pyspark.sql import types as T

# reviews as documented, with a text date (any CSV file): it stays text until ``parse_review_date``.
REVIEWS_TEXT_DATES = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_date", T.StringType()),
    T.StructField("user_id", T.StringType()),
])

# reviews after the source step (and as a parquet table).
REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_date", T.DateType()),
    T.StructField("user_id", T.StringType()),
])

USER_ATTRIBUTES = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("account_age_days", T.IntegerType()),
])

# The public sentiment file and its app file (adapter S3).
SENTIMENT_REVIEWS = T.StructType([
    T.StructField("App", T.StringType()),
    T.StructField("Sentiment", T.StringType()),
])
APPS = T.StructType([
    T.StructField("App", T.StringType()),
    T.StructField("Category", T.StringType()),
])
