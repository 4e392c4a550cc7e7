"""All reports from one pass over the reviews.

Each query function reads the reviews itself; a daily report that runs all of them would read the
big table six times. ``nps_report`` reads it once: one join and one aggregation into cells keyed by
the segment dimensions, the review month and whether the rating is in 1..5. Every report is a
re-aggregation of those cells - Q1 sums the in-range cells, Q3 groups them by month, the segment
queries roll them up - so the cell table (dimension domains x months x 2 rows, whatever the number
of reviews) is the only thing the reports read. It is written once as a parquet table under
``spark.checkpoint.dir``, which cuts the lineage: a lost executor never re-runs the join. Writing
the table is a single job; an eager ``DataFrame.checkpoint()`` runs its last stage a second time to
write the checkpoint files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.dates import month_start, review_month
from loyalscope.functions.measures import nps_score, pct
from loyalscope.functions.tiers import COUNT_COLUMNS, MAX_STARS, MIN_STARS, sum_count_aggs
from loyalscope.operators.cells import CELL_KEYS, review_cells
from loyalscope.operators.trend import monthly_trend
from loyalscope.plans import core
from loyalscope.session import stored

REPORT_KEYS = ("month_start", "in_range")


def report_cells(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Cells keyed by the four dimensions, the month (NULL for an unknown date) and ``in_range``."""
    keyed = reviews.withColumns({
        "month_start": month_start("review_date"),
        "in_range": F.col("rating").between(MIN_STARS, MAX_STARS),
    })
    return review_cells(keyed, users, extra_keys=REPORT_KEYS)


def _counts_by(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(*sum_count_aggs())


def overall_from_cells(cells: DataFrame) -> DataFrame:
    """Q1 from report cells: the in-range reviews only (the strict rule)."""
    counts = cells.where(F.col("in_range")).agg(*sum_count_aggs())
    n, p, q, d = (F.col(c) for c in ("review_count", "promoters", "passives", "detractors"))
    return counts.select(
        n.alias("total_reviews"), "promoters", "passives", "detractors",
        pct(p, n).alias("promoter_pct"), pct(q, n).alias("passive_pct"),
        pct(d, n).alias("detractor_pct"), nps_score(p, d, n).alias("nps_score"))


def monthly_from_cells(cells: DataFrame) -> DataFrame:
    """Q3 from report cells: every rated review with a date, one row per month."""
    monthly = (_counts_by(cells.where(F.col("month_start").isNotNull()), "month_start")
               .select(review_month("month_start").alias("review_month"), *COUNT_COLUMNS))
    return monthly_trend(monthly).sortWithinPartitions("review_month")


def nps_report(reviews: DataFrame, users: DataFrame, materialize: bool = True,
               path: str | None = None) -> dict[str, DataFrame]:
    """Q1-Q6 from one pass. ``materialize`` writes the cells first (eager: runs the pass now), and from them
    the segment cells that four reports share, so each is aggregated once. The tables lie under ``path``
    and stay there, or in the checkpoint folder until the session ends."""
    cells = report_cells(reviews, users)
    if materialize:
        cells = stored(cells, "report-cells", path and f"{path.rstrip('/')}/report_cells")
    segment_cells = _counts_by(cells, *CELL_KEYS)
    if materialize:
        segment_cells = stored(segment_cells, "segment-cells", path and f"{path.rstrip('/')}/segment_cells")
    return {
        "overall_nps": overall_from_cells(cells),
        "segment_nps": core.segment_nps_from_cells(segment_cells),
        "monthly_trend": monthly_from_cells(cells),
        "device_age_nps": core.device_age_nps_from_cells(segment_cells),
        "segment_benchmark": core.segment_benchmark_from_cells(segment_cells),
        "negative_drivers": core.negative_drivers_from_cells(segment_cells),
    }
