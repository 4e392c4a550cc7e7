"""Recovery (X8): what tier does a user's next review fall in, given the tier of this one?

"Next" is the user's following review by (date, review id). A window partitioned by user would
put all of one user's reviews into one task, and a single account (a bot, a heavy reviewer) may own
a large share of all reviews. So the reviews are sorted globally instead: range partitioning splits
even one user's timeline over several partitions of bounded size. Each partition is scanned in
order with vectorised pandas (``mapInPandas``, batch by batch with one carried row), counting
transitions inside the partition and reporting its first and last review. Transitions that cross a
partition boundary are then found on those boundary rows - two per partition, so their window
covers only as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyalscope.functions.measures import pct
from loyalscope.functions.tiers import TIERS, nps_tier
from loyalscope.operators.tagging import valid_dated

_K = len(TIERS)


def _tier_code(rating: str = "rating"):
    tier = nps_tier(rating)
    expr = None
    for code, name in enumerate(TIERS):
        expr = F.when(tier == name, code) if expr is None else expr.when(tier == name, code)
    return expr.cast("int")


def _scan_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(_K * _K, dtype=np.int64)
    first_user = first_tier = prev_user = prev_tier = part = None
    for pdf in batches:
        if pdf.empty:
            continue
        users = pdf["user_id"].to_numpy()
        tiers = pdf["tier"].to_numpy(dtype=np.int64)
        if first_user is None:
            part = int(pdf["part"].iloc[0])
            first_user, first_tier = users[0], int(tiers[0])
        elif users[0] == prev_user:
            counts[prev_tier * _K + tiers[0]] += 1
        same = users[1:] == users[:-1]
        counts += np.bincount(tiers[:-1][same] * _K + tiers[1:][same], minlength=_K * _K)
        prev_user, prev_tier = users[-1], int(tiers[-1])
    if first_user is not None:
        yield pd.DataFrame({"part": [part], "pairs": [counts.tolist()],
                            "first_user": [first_user], "first_tier": [first_tier],
                            "last_user": [prev_user], "last_tier": [prev_tier]})


def recovery_transitions(reviews: DataFrame) -> DataFrame:
    """``from_tier, to_tier, transitions, from_total, transition_pct`` over consecutive reviews.

    Only reviews with a rating, a date and a user take part; a user's last review has no successor.
    """
    seq = (valid_dated(reviews).where(F.col("user_id").isNotNull())
           .select("user_id", "review_date", "review_id", _tier_code().alias("tier")))
    user_type = seq.schema["user_id"].dataType
    out_schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("first_user", user_type), T.StructField("first_tier", T.IntegerType()),
        T.StructField("last_user", user_type), T.StructField("last_tier", T.IntegerType()),
    ])
    ordered = seq.orderBy("user_id", "review_date", "review_id", "tier")
    scanned = (ordered.select("user_id", "tier", F.spark_partition_id().alias("part"))
               .mapInPandas(_scan_partition, out_schema))

    # One row per partition: its own pairs, and the pair that crosses into the next partition.
    by_part = Window.orderBy("part")
    joined = scanned.withColumns({"next_user": F.lead("first_user").over(by_part),
                                  "next_tier": F.lead("first_tier").over(by_part)})
    crossing = F.when(F.col("last_user") == F.col("next_user"), F.col("last_tier") * _K + F.col("next_tier"))
    total = F.transform("pairs", lambda n, i: n + F.when(i == crossing, 1).otherwise(0))
    counts = (joined.select(F.posexplode(total).alias("pair", "n"))
              .groupBy(F.floor(F.col("pair") / _K).cast("int").alias("from_tier"), (F.col("pair") % _K).alias("to_tier"))
              .agg(F.sum("n").cast("long").alias("transitions")).where("transitions > 0"))
    by_from = Window.partitionBy("from_tier")
    names = F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("from_tier") + 1)
    to_names = F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("to_tier") + 1)
    return (counts.withColumn("from_total", F.sum("transitions").over(by_from).cast("long"))
            .select(names.alias("from_tier"), to_names.alias("to_tier"), "transitions", "from_total",
                    pct("transitions", "from_total").alias("transition_pct")))
