"""Date handling: parse review dates once at the source, month keys as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loyalscope.functions.util import as_col

# Input date format and the month-start key format.
DATE_FORMAT = "yyyy-MM-dd"
MONTH_KEY_FORMAT = "yyyy-MM-01"


def parse_review_date(text: Column | str) -> Column:
    """Text ``YYYY-MM-DD`` -> DATE; malformed or impossible dates (``2022-02-30``) become NULL."""
    return F.try_to_date(as_col(text), DATE_FORMAT)


def review_month(date: Column | str) -> Column:
    """First day of the month as text ``YYYY-MM-01``; sorts chronologically as a string."""
    return F.date_format(as_col(date), MONTH_KEY_FORMAT)


def month_start(date: Column | str) -> Column:
    """First day of the month as a DATE: integer arithmetic, cheap enough for every row.

    Group by this and format the key with ``review_month`` after the aggregation, so the text is
    built once per month instead of once per review.
    """
    return F.trunc(as_col(date), "month")
