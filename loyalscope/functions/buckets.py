"""Account-age buckets (P3a, P3b, P3c) and the NULL-dimension label (P5).

Base cells keep the age as a small code (0-3, NULL for an unknown age) so that every label variant
can be applied after aggregation; ``age_bucket`` applies a variant directly to a row-level age.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loyalscope.functions.util import as_col

# Inclusive upper bounds (days) of the first three buckets, the two label sets,
# and the label used for a missing dimension value.
AGE_UPPER_BOUNDS = (30, 90, 365)
AGE_LABELS = {
    "long": ("new_user (0-30d)", "early (31-90d)", "established (91-365d)", "veteran (365d+)"),
    "short": ("new_user", "early", "established", "veteran"),
}
UNKNOWN = "unknown"

_NULL_RULES = ("veteran", "unknown", "null")


def age_code(age_days: Column | str) -> Column:
    """0..3 for the four buckets, NULL when the age is NULL."""
    a = as_col(age_days)
    lo, mid, hi = AGE_UPPER_BOUNDS
    return (F.when(a <= lo, 0).when(a <= mid, 1).when(a <= hi, 2).when(a.isNotNull(), 3)
            .cast("int"))


def age_label(code: Column | str, labels: str = "long", null: str = "veteran") -> Column:
    """Label of an age code.

    ``null='veteran'`` puts unknown ages in the oldest bucket (the ELSE branch of a plain CASE),
    ``null='unknown'`` gives them their own label, ``null='null'`` keeps them NULL.
    """
    if null not in _NULL_RULES:
        raise ValueError(f"null must be one of {_NULL_RULES}")
    names = AGE_LABELS[labels]
    c = as_col(code)
    expr = F.when(c == 0, names[0]).when(c == 1, names[1]).when(c == 2, names[2])
    if null == "veteran":
        return expr.otherwise(names[3])
    expr = expr.when(c == 3, names[3])
    return expr.otherwise(UNKNOWN) if null == "unknown" else expr


def age_bucket(age_days: Column | str, labels: str = "long", null: str = "veteran") -> Column:
    return age_label(age_code(age_days), labels=labels, null=null)


def or_unknown(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(UNKNOWN))
