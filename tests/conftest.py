from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from loyalscope.session import get_session  # noqa: E402

REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_date", T.DateType()),
    T.StructField("user_id", T.StringType()),
])
USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("account_age_days", T.IntegerType()),
])


@pytest.fixture(scope="session")
def spark():
    return get_session(cores=4, shuffle_partitions=4)


def make_reviews(spark, rows):
    """rows: (rating, user_id[, category[, date]]) tuples; ids are assigned in order."""
    out = []
    for i, r in enumerate(rows):
        rating, user = r[0], r[1]
        category = r[2] if len(r) > 2 else "Tools"
        date = r[3] if len(r) > 3 else dt.date(2022, 1, 1)
        out.append((i + 1, "app", category, rating, date, user))
    return spark.createDataFrame(out, REVIEWS)


def make_users(spark, rows):
    return spark.createDataFrame(rows, USERS)


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def rows_of(df, *cols):
    """The selected columns of every row, sorted (NULLs first)."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
