"""Scans of the two input tables (S1, S2). Lazy: only the file listing happens on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loyalscope.functions.dates import parse_review_date
from loyalscope.sources import schemas
from loyalscope.sources.quoted_csv import read_quoted_csv

CORRUPT = "_corrupt_record"
_CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``; from CSV also ``_corrupt_record``, the text of a line that does not parse."""
    if fmt == "csv":
        return spark.read.schema(_with_corrupt(schema)).options(**_CSV_OPTIONS).csv(path)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet", text_dates: bool = False) -> DataFrame:
    """``review_id, app_name, category, rating, review_date (DATE), user_id``.

    The schema is given, never inferred. CSV dates are text, and so are those of Parquet files written
    with the documented text column (``text_dates=True``): they are parsed here, once, so a malformed
    or impossible date is NULL everywhere downstream. A CSV line whose fields do not parse (a rating
    that is not an integer) keeps its text in ``_corrupt_record`` for ``input_checks``.
    """
    text_dates = text_dates or fmt == "csv"
    raw = _read(spark, path, fmt, schemas.REVIEWS_TEXT_DATES if text_dates else schemas.REVIEWS)
    return raw.withColumn("review_date", parse_review_date("review_date")) if text_dates else raw


def read_user_attributes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``user_id, device_type, region, account_age_days`` (and ``_corrupt_record`` from CSV)."""
    return _read(spark, path, fmt, schemas.USER_ATTRIBUTES)


def read_sentiment_reviews(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The public review file, ``App, Sentiment``; further columns of the file are left out."""
    return _read_by_name(spark, path, fmt, schemas.SENTIMENT_REVIEWS)


def read_apps(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The app file, ``App, Category``; further columns of the file are left out."""
    return _read_by_name(spark, path, fmt, schemas.APPS)


def _read_by_name(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Known text columns of a file with more columns; CSV fields may hold line breaks, and splits are read in parallel."""
    if fmt != "csv":
        return _read(spark, path, fmt, schema)
    return read_quoted_csv(spark, path).select(*schema.fieldNames())
