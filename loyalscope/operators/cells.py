"""Base cells (design D1) and segment rollups.

The big input is joined and aggregated exactly once, into additive cells keyed by the raw segment
dimensions ``(device_type, region, age_code, category)``: per cell the review count, the three tier
counts and the rating sum. The number of cells is bounded by the product of the dimension domains,
not by the number of reviews, and partial aggregation collapses every task's rows to at most that
many before the shuffle, so a hot key costs nothing extra. Every segment table, two- and three-way
combination and the overall row is a re-aggregation of the cells in one GROUPING SETS pass.

Cells keep NULLs and the age as a code, so each query applies its own labels before the rollup:
NULL to ``'unknown'`` before grouping (one group) or after grouping (two rows that share a label),
an unknown age as ``veteran`` or as its own bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.functions.tiers import COUNT_COLUMNS, sum_count_aggs, tier_count_aggs
from loyalscope.operators.tagging import tag_with_users, valid_ratings

CELL_KEYS = ("device_type", "region", "age_code", "category")
TOTAL = "total"
# Separators in the labels of multi-dimension segments.
LABEL_SEPARATOR = " · "

SegmentSets = Sequence[tuple[str, Sequence[str]]]


def review_cells(reviews: DataFrame, users: DataFrame, strict: bool = False,
                 extra_keys: Sequence[str] = (), user_keys: Sequence[str] = (),
                 preaggregate: bool = False) -> DataFrame:
    """One join, one aggregation: ``CELL_KEYS + extra_keys + user_keys`` -> additive tier counts.

    ``extra_keys`` are further review columns and ``user_keys`` further user columns to keep as cell
    keys (for example ``app_name``); the cells then grow with that column's cardinality and stay a
    distributed DataFrame.

    ``preaggregate=True`` first counts reviews per ``(user_id, category, rating, extra_keys)``. The
    map-side half of that aggregate collapses a heavy user's reviews inside every task before
    anything is shuffled, so the join then moves a few rows per user instead of one per review.
    It costs a second shuffle, which pays off when users write many reviews (or one user writes a
    large share of them); with about one review per user the plain plan moves less data.
    """
    keys = ("category", "rating", *extra_keys)
    cell = (*CELL_KEYS, *extra_keys, *user_keys)
    if not preaggregate:
        tagged = tag_with_users(reviews, users, strict=strict, review_columns=keys, user_columns=tuple(user_keys))
        return tagged.groupBy(*cell).agg(*tier_count_aggs())
    counted = (valid_ratings(reviews, strict=strict).groupBy("user_id", *keys)
               .agg(F.count(F.lit(1)).alias("_reviews")))
    tagged = tag_with_users(counted, users, strict=strict, review_columns=(*keys, "_reviews"), user_columns=tuple(user_keys))
    return tagged.groupBy(*cell).agg(*tier_count_aggs(weight="_reviews"))


def grouping_id_of(dims: Sequence[str], columns: Sequence[str]) -> int:
    """Spark's ``grouping_id()`` for a grouping set: one bit per column, 1 = not grouped."""
    gid = 0
    for col in columns:
        gid = (gid << 1) | (0 if col in dims else 1)
    return gid


def rollup(cells: DataFrame, labels: Mapping[str, Column], sets: SegmentSets) -> DataFrame:
    """Re-aggregate labelled cells over several grouping sets in one pass (Expand + one aggregate).

    ``labels`` maps output dimension names to expressions over the cell keys; ``sets`` is a list of
    ``(segment_type, dims)``; ``()`` as dims gives the overall row. The output has ``segment_type``,
    every label column (NULL where not grouped; a grouped NULL is a data NULL, told apart by the
    grouping id, never by ``IS NULL``) and the summed counts.
    """
    columns = list(labels)
    labelled = cells.select(*(expr.alias(name) for name, expr in labels.items()), *COUNT_COLUMNS)
    grouped = labelled.groupingSets([list(dims) for _, dims in sets], *columns).agg(
        *sum_count_aggs(), F.grouping_id(*columns).alias("_gid"))
    return grouped.withColumn("segment_type", _segment_type(_freeze(sets), tuple(columns))).drop("_gid")


def _freeze(sets: SegmentSets) -> tuple:
    return tuple((name, tuple(dims)) for name, dims in sets)


def _segment_type(sets: tuple, columns: tuple) -> Column:
    """Segment type name from the grouping id of each grouping set."""
    segment_type = None
    for name, dims in sets:
        cond = F.col("_gid") == grouping_id_of(dims, columns)
        segment_type = F.when(cond, name) if segment_type is None else segment_type.when(cond, name)
    return segment_type


def segment_value(sets: SegmentSets, separator: str = LABEL_SEPARATOR) -> Column:
    """The grouped value(s) of each row: the dimension itself, or ``v1 · v2`` (NULL-propagating)."""
    return _segment_value(_freeze(sets), separator)


def _segment_value(sets: tuple, separator: str) -> Column:
    expr = None
    for name, dims in sets:
        if not dims:
            value = F.lit(None).cast("string")
        elif len(dims) == 1:
            value = F.col(dims[0])
        else:
            parts = [F.col(dims[0])]
            for d in dims[1:]:
                parts += [F.lit(separator), F.col(d)]
            value = F.concat(*parts)
        cond = F.col("segment_type") == name
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr
