"""Segment benchmarks: each segment against the overall score and its peer group.

In SQL the overall score is an uncorrelated scalar subquery and the peer-group mean ("average score
of all segments of my type with n >= min_n, me included") a correlated one. Here the overall counts
are one row, aggregated from the same cells as the segments and joined to every segment, and the peer
means are one row per segment type, joined on the type. Nothing sees all segments in one task. The
branches share the cells' exchange, so the reviews are read and joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.measures import mean_tenths, nps_tenths, tenths_to_score


def overall_row(cells: DataFrame) -> DataFrame:
    """``total_reviews`` and ``overall10`` (overall score in tenths): one row."""
    n, p, d = (F.sum(c) for c in ("review_count", "promoters", "detractors"))
    return cells.agg(n.cast("long").alias("total_reviews"), nps_tenths(p, d, n).alias("overall10"))


def with_overall(rolled: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``total_reviews`` and ``overall10`` to every segment row (an aggregate without keys is one row)."""
    return rolled.crossJoin(F.broadcast(overall_row(cells)))


def with_peers(segments: DataFrame) -> DataFrame:
    """Add the sum and number of the scores of each segment's type (itself included), and their rounded mean.

    There is one row of peers per grouping set, so that side is broadcast.
    """
    peers = segments.groupBy("segment_type").agg(F.sum("s10").alias("peer_sum"), F.count("s10").alias("peer_n"))
    return segments.join(F.broadcast(peers), "segment_type").withColumn("peer10", mean_tenths("peer_sum", "peer_n"))


def peer_benchmark(rolled: DataFrame, cells: DataFrame, min_n: int = 20) -> DataFrame:
    """Segments with ``review_count >= min_n`` of a rollup of ``cells`` (with ``s10``) against overall and peers."""
    return with_overall(with_peers(rolled.where(F.col("review_count") >= min_n)), cells)


def benchmark_columns() -> list[Column]:
    s10, o10, p10 = F.col("s10"), F.col("overall10"), F.col("peer10")
    return [
        tenths_to_score(o10).alias("overall_nps"),
        tenths_to_score(p10).alias("avg_nps_for_segment_type"),
        tenths_to_score(s10 - p10).alias("vs_peer_group_avg"),
        tenths_to_score(s10 - o10).alias("vs_overall_nps"),
    ]
