"""Negative drivers: segments below the overall score, ranked by volume x gap.

Only aggregated rows reach this module. The ranking sorts with a total order (impact, then
segment type and label) and cuts to ``top`` before the rank window, so the window runs over ``top``
rows whatever the number of segments; dense ranks of the first ``top`` rows only depend on rows
that sort before them, so they are the same as ranks over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loyalscope.functions.measures import negative_impact, tenths_to_score
from loyalscope.operators.benchmark import with_overall
from loyalscope.operators.cells import SegmentSets, segment_value


def rank_order() -> list:
    """Impact descending, then a total order on (type, label) so the cut is deterministic."""
    return [F.desc("negative_impact_score"), F.asc_nulls_first("segment_type"),
            F.asc_nulls_first("segment_label")]


def with_impact(rolled: DataFrame, cells: DataFrame, sets: SegmentSets) -> DataFrame:
    """Every segment of a rollup (with ``s10``) of the ``cells`` with its label, the overall score and its impact."""
    return with_overall(rolled, cells).withColumns({
        "segment_label": segment_value([s for s in sets if s[1]]),
        "negative_impact_score": negative_impact("s10", "overall10", "review_count", "total_reviews"),
    })


def score_below_overall(rolled: DataFrame, cells: DataFrame, sets: SegmentSets, min_n: int = 30) -> DataFrame:
    """Segments with ``review_count >= min_n`` whose rounded score is below the rounded overall.

    The comparison uses the rounded scores, as the gap and the impact do.
    """
    return with_impact(rolled, cells, sets).where((F.col("review_count") >= min_n) & (F.col("s10") < F.col("overall10")))


def rank_top(scored: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` highest-impact segments with their dense rank (ties share a rank).

    The cut (TakeOrderedAndProject: per-task top-k, then a merge) leaves one partition, which the
    rank window and a final ``sortWithinPartitions`` use without further exchanges.
    """
    head = scored.orderBy(*rank_order()).limit(top)
    return head.withColumn("impact_rank",
                           F.dense_rank().over(Window.orderBy(F.desc("negative_impact_score"))))


def driver_columns() -> list:
    s10, o10 = F.col("s10"), F.col("overall10")
    return [
        "impact_rank", "segment_type", "segment_label", "review_count", "nps_score",
        tenths_to_score(o10).alias("overall_nps"),
        tenths_to_score(s10 - o10).alias("gap_vs_overall"),
        "detractor_pct", "negative_impact_score",
    ]


def coverage(labelled_cells: DataFrame, top_segments: DataFrame, sets: SegmentSets,
             dims: Sequence[str], top: int = 100) -> DataFrame:
    """Share of reviews and detractors inside the union of ``top_segments`` (X3): one row.

    A review is covered when its cell matches any of the segments; overlapping segments count it
    once. Each labelled cell is expanded into its key under every grouping set (a handful of rows per
    cell), semi-joined with the top segments on (type, keys) with NULL-safe equality, and the covered
    cells are de-duplicated before summing. At most ``top`` segments are taken, so what is broadcast is
    bounded here. ``labelled_cells`` must have unique label keys.
    Covered and total counts are summed in one aggregate over both row sets.
    """
    cell_cols = [f"cell_{d}" for d in dims]
    keyed = labelled_cells.select(*(F.col(d).alias(c) for d, c in zip(dims, cell_cols)),
                                  "review_count", "detractors")
    variants = F.array(*(
        F.struct(F.lit(name).alias("segment_type"),
                 *((F.col(c) if d in set_dims else F.lit(None).cast("string")).alias(d)
                   for d, c in zip(dims, cell_cols)))
        for name, set_dims in sets if set_dims))
    expanded = keyed.select("*", F.explode(variants).alias("k")).select(
        *cell_cols, "review_count", "detractors", "k.*")
    keys = ["segment_type", *dims]
    targets = F.broadcast(top_segments.select(*keys).limit(top))
    cond = [expanded[k].eqNullSafe(targets[k]) for k in keys]
    covered = (expanded.join(targets, cond, "left_semi")
               .select(*cell_cols, "review_count", "detractors").distinct()
               .select(F.lit(True).alias("covered"), "review_count", "detractors"))
    everything = keyed.select(F.lit(False).alias("covered"), "review_count", "detractors")
    cov, n, d = F.col("covered"), F.col("review_count"), F.col("detractors")
    zero = F.lit(0)
    return covered.unionByName(everything).agg(
        F.coalesce(F.sum(F.when(cov, n)), zero).cast("long").alias("reviews_covered"),
        F.coalesce(F.sum(F.when(~cov, n)), zero).cast("long").alias("total_reviews"),
        F.coalesce(F.sum(F.when(cov, d)), zero).cast("long").alias("detractors_covered"),
        F.coalesce(F.sum(F.when(~cov, d)), zero).cast("long").alias("total_detractors"),
    )
