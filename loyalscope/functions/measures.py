"""NPS measures (M1-M7) on aggregated counts.

Every rounded value is ``ROUND(num / den, k)`` of two integers, evaluated in decimal arithmetic:
exact, half away from zero, and NULL for an empty denominator. Doubles would make the result depend
on the engine (``100*p/n - 100*d/n`` prints 11.4 for the documented 4716/2713/3571 of 10,000, and
two engines round 0.285 to two places differently), so scores are kept as integer tenths (``s10``)
wherever they are compared, averaged or subtracted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loyalscope.functions.util import as_col

# decimal(18,0) / decimal(18,0) has scale 19 in Spark: far finer than any tie between two integer
# ratios with a denominator below 1e16, so the final rounding is exact.
_EXACT = "decimal(18,0)"

# NPS health bands, lower bounds inclusive: < 0, [0, 30), [30, 70], > 70.
BAND_NEEDS_ATTENTION = "needs_attention"
BAND_ACCEPTABLE = "acceptable"
BAND_GOOD = "good"
BAND_EXCELLENT = "excellent"
BAND_ACCEPTABLE_FROM = 0
BAND_GOOD_FROM = 30
BAND_GOOD_TO = 70


def exact_ratio(num: Column | str, den: Column | str, places: int) -> Column:
    """``ROUND(num / den, places)`` for integer inputs, as a double; NULL when ``den`` is 0."""
    q = F.try_divide(as_col(num).cast(_EXACT), as_col(den).cast(_EXACT))
    return F.round(q, places).cast("double")


def nps_score(promoters: Column | str, detractors: Column | str, n: Column | str) -> Column:
    """NPS = 100 * (promoters - detractors) / n, one decimal (M1)."""
    return exact_ratio((as_col(promoters) - as_col(detractors)) * 100, n, 1)


def nps_tenths(promoters: Column | str, detractors: Column | str, n: Column | str) -> Column:
    """The same score in integer tenths."""
    return exact_ratio((as_col(promoters) - as_col(detractors)) * 1000, n, 0).cast("long")


def pct(x: Column | str, n: Column | str) -> Column:
    """Percentage with one decimal (M2)."""
    return exact_ratio(as_col(x) * 100, n, 1)


def avg_star(rating_sum: Column | str, n: Column | str) -> Column:
    """Mean star rating with two decimals (M3)."""
    return exact_ratio(rating_sum, n, 2)


def tenths_to_score(t: Column | str) -> Column:
    """Integer tenths back to a one-decimal score (gaps, deltas: M4, M5, W2)."""
    return exact_ratio(t, F.lit(10), 1)


def mean_score(sum_tenths: Column | str, count: Column | str) -> Column:
    """Unweighted mean of one-decimal scores, rounded to one decimal."""
    return exact_ratio(sum_tenths, as_col(count) * 10, 1)


def mean_tenths(sum_tenths: Column | str, count: Column | str) -> Column:
    """That rounded mean in integer tenths."""
    return exact_ratio(sum_tenths, count, 0).cast("long")


def negative_impact(seg_tenths: Column | str, overall_tenths: Column | str,
                    n: Column | str, total: Column | str) -> Column:
    """|min(segment - overall, 0)| * n / total, two decimals (M6)."""
    shortfall = F.abs(F.least(as_col(seg_tenths) - as_col(overall_tenths), F.lit(0)))
    return exact_ratio(shortfall * as_col(n), as_col(total) * 10, 2)


def nps_band(score: Column | str) -> Column:
    """Health band of a score (M7); NULL score -> NULL band."""
    s = as_col(score)
    return (F.when(s < BAND_ACCEPTABLE_FROM, BAND_NEEDS_ATTENTION)
            .when(s < BAND_GOOD_FROM, BAND_ACCEPTABLE)
            .when(s <= BAND_GOOD_TO, BAND_GOOD)
            .when(s > BAND_GOOD_TO, BAND_EXCELLENT))


def score_columns(prefix: str = "") -> dict[str, Column]:
    """Standard derived columns over ``review_count, promoters, passives, detractors``."""
    n, p, q, d = (F.col(prefix + c) for c in ("review_count", "promoters", "passives", "detractors"))
    return {
        "nps_score": nps_score(p, d, n),
        "promoter_pct": pct(p, n),
        "passive_pct": pct(q, n),
        "detractor_pct": pct(d, n),
        "s10": nps_tenths(p, d, n),
    }
