"""Properties on random inputs and brute-force checks of the operators without SQL."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loyalscope.functions.tiers import tier_count_aggs
from loyalscope.operators.cells import review_cells, rollup
from loyalscope.operators.drivers import coverage, rank_order
from loyalscope.operators.recovery import recovery_transitions
from loyalscope.operators.tagging import tag_with_users
from loyalscope.plans import core, extended
from loyalscope.sources.sentiment import adapt_sentiment_reviews
from tests.conftest import _key, make_reviews, make_users, rows_of

DEVICES = [None, "iOS", "Android", "unknown"]
REGIONS = [None, "EU", "NA"]
CATS = [None, "Tools", "Games"]

review_rows = st.lists(
    st.tuples(st.sampled_from([None, 0, 1, 2, 3, 4, 5, 6]), st.sampled_from(["u1", "u2", "u3", "u4", None]),
              st.sampled_from(CATS)),
    min_size=0, max_size=60)
user_rows = st.lists(
    st.tuples(st.sampled_from(["u1", "u2", "u3", "u5"]), st.sampled_from(DEVICES),
              st.sampled_from(REGIONS), st.sampled_from([None, 0, 30, 31, 100, 400])),
    min_size=0, max_size=4, unique_by=lambda t: t[0])

SETTINGS = dict(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck),
                phases=[Phase.explicit, Phase.reuse, Phase.generate])


def _tier(r):
    return "promoter" if r >= 4 else "passive" if r == 3 else "detractor"


@settings(**SETTINGS)
@given(review_rows, user_rows)
def test_segment_counts_are_consistent(spark, reviews, users):
    rv, us = make_reviews(spark, reviews), make_users(spark, users)
    q2 = core.segment_nps(rv, us).collect()
    rated = sum(1 for r in reviews if r[0] is not None)
    per_type = defaultdict(int)
    for row in q2:
        assert row.promoters + row.passives + row.detractors == row.review_count
        assert -100.0 <= row.nps_score <= 100.0
        per_type[row.segment_type] += row.review_count
    assert all(v == rated for v in per_type.values())
    # brute force for the device table (NULL and unmatched grouped together, labelled afterwards)
    dev = {u[0]: u[1] for u in users}
    want = Counter()
    for rating, user, _ in reviews:
        if rating is not None:
            want[(dev.get(user) or "unknown", dev.get(user) is None, _tier(rating))] += 1
    got = Counter()
    for row in q2:
        if row.segment_type == "device_type":
            for tier, n in (("promoter", row.promoters), ("passive", row.passives),
                            ("detractor", row.detractors)):
                if n:
                    got[(row.segment_value, tier)] += n
    want_flat = Counter()
    for (label, _, tier), n in want.items():
        want_flat[(label, tier)] += n
    assert got == want_flat


@settings(**SETTINGS)
@given(review_rows, user_rows)
def test_filter_equals_case_and_cells_equal_union(spark, reviews, users):
    rv, us = make_reviews(spark, reviews), make_users(spark, users)
    f = rows_of(core.tier_counts_by_device(rv, us, "filter").drop("approach"),
                "device_type", "total", "promoters", "passives", "detractors", "nps_score")
    c = rows_of(core.tier_counts_by_device(rv, us, "case").drop("approach"),
                "device_type", "total", "promoters", "passives", "detractors", "nps_score")
    assert f == c
    cells = review_cells(rv, us)
    rolled = core.driver_rollup(cells)
    tagged = tag_with_users(rv, us)
    lab = core.labels(device_null="unknown", age_null="unknown")
    named = tagged.select(*(e.alias(k) for k, e in lab.items()), "nps_tier", "rating")
    union = []
    for kind, dims in core.DRIVER_SETS:       # the literal form: one aggregate per segment type
        union += [(kind, *(r[d] if d in dims else None for d in lab), r.review_count, r.promoters, r.detractors)
                  for r in named.groupBy(*dims).agg(*tier_count_aggs()).collect()]
    assert rows_of(rolled, "segment_type", *lab, "review_count", "promoters", "detractors") == sorted(union, key=_key)


def test_results_do_not_depend_on_partitioning(spark):
    rnd = random.Random(7)
    reviews = [(rnd.choice([1, 2, 3, 4, 5, None]), f"u{rnd.randrange(30)}", rnd.choice(CATS))
               for _ in range(600)]
    users = [(f"u{i}", rnd.choice(DEVICES), rnd.choice(REGIONS), rnd.choice([None, 5, 60, 200, 900]))
             for i in range(25)]
    rv, us = make_reviews(spark, reviews), make_users(spark, users)
    base = rows_of(core.negative_drivers(rv, us, min_n=5), *core.negative_drivers(rv, us).columns)
    for n in (1, 3, 11):
        shuffled = rv.repartition(n, F.rand(n))
        again = rows_of(core.negative_drivers(shuffled, us.repartition(n), min_n=5),
                        *core.negative_drivers(rv, us).columns)
        assert again == base


def test_preaggregated_cells_equal_plain_cells(spark):
    rnd = random.Random(11)
    reviews = [(rnd.choice([None, 0, 1, 3, 4, 5, 6]),
                "hot" if rnd.random() < 0.35 else rnd.choice([f"u{i}" for i in range(30)] + [None]),
                rnd.choice(CATS)) for _ in range(800)]
    users = [(f"u{i}", rnd.choice(DEVICES), rnd.choice(REGIONS), rnd.choice([None, 5, 60, 900]))
             for i in range(25)] + [("hot", "iOS", "EU", 10)]
    rv, us = make_reviews(spark, reviews), make_users(spark, users)
    cols = ("device_type", "region", "age_code", "category", "review_count", "promoters",
            "passives", "detractors", "rating_sum")
    for strict in (False, True):
        assert rows_of(review_cells(rv, us, strict=strict, preaggregate=True), *cols) == \
            rows_of(review_cells(rv, us, strict=strict), *cols)


def test_rollup_total_equals_every_segment_type(spark):
    rnd = random.Random(3)
    reviews = [(rnd.choice([1, 3, 5]), f"u{rnd.randrange(10)}", rnd.choice(CATS)) for _ in range(200)]
    users = [(f"u{i}", rnd.choice(DEVICES), rnd.choice(REGIONS), rnd.choice([None, 5, 500]))
             for i in range(8)]
    out = extended.segment_rollup(make_reviews(spark, reviews), make_users(spark, users)).collect()
    total = [r for r in out if r.segment_type == "total"][0]
    sums = defaultdict(lambda: [0, 0, 0])
    for r in out:
        if r.segment_type != "total":
            s = sums[r.segment_type]
            s[0] += r.review_count
            s[1] += r.promoters
            s[2] += r.detractors
    assert all(v == [total.review_count, total.promoters, total.detractors] for v in sums.values())


def _brute_transitions(reviews):
    by_user = defaultdict(list)
    for rid, (rating, user, _, date) in enumerate(reviews, start=1):
        if rating is not None and user is not None and date is not None:
            by_user[user].append((date, rid, _tier(rating)))
    out = Counter()
    for seq in by_user.values():
        seq.sort()
        for a, b in zip(seq, seq[1:]):
            out[(a[2], b[2])] += 1
    return out


@pytest.mark.parametrize("partitions, coalesce", [(1, True), (5, True), (5, False), (23, True), (23, False)])
def test_recovery_matches_brute_force_with_a_hot_user(spark, partitions, coalesce):
    import datetime as dt
    rnd = random.Random(partitions)
    reviews = []
    for _ in range(900):
        user = "hot" if rnd.random() < 0.4 else rnd.choice([f"u{i}" for i in range(40)] + [None])
        date = rnd.choice([None, dt.date(2022, 1, 1) + dt.timedelta(days=rnd.randrange(60))])
        reviews.append((rnd.choice([None, 1, 2, 3, 4, 5, 6]), user, "Tools", date))
    prev = {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true" if coalesce else "false")
    try:
        got = {(r.from_tier, r.to_tier): r.transitions
               for r in recovery_transitions(make_reviews(spark, reviews)).collect()}
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    assert got == dict(_brute_transitions(reviews))


def test_coverage_counts_overlapping_segments_once(spark):
    reviews = make_reviews(spark, [(1, "a")] * 5 + [(1, "b")] * 3 + [(5, "c")] * 4)
    users = make_users(spark, [("a", "X", "EU", 10), ("b", "X", "NA", 500), ("c", "Y", "NA", 500)])
    lab = core.labels(device_null="unknown", age_null="unknown")
    cells = review_cells(reviews, users)
    labelled = (cells.select(*(e.alias(k) for k, e in lab.items()), "review_count", "detractors")
                .groupBy(*lab).agg(F.sum("review_count").alias("review_count"),
                                   F.sum("detractors").alias("detractors")))
    sets = core.DRIVER_SETS
    rolled = rollup(cells, lab, sets)
    # device X (8 reviews) and region EU (5 reviews, all inside device X) overlap
    top = rolled.where("(segment_type = 'device_type' and device_type = 'X') or "
                       "(segment_type = 'region' and region = 'EU')")
    row = coverage(labelled, top, sets, list(lab)).collect()[0]
    assert (row.reviews_covered, row.total_reviews, row.detractors_covered, row.total_detractors) == (8, 12, 8, 8)


def test_sentiment_adapter(spark):
    sentiment = spark.createDataFrame(
        [("A", "Positive"), ("A", "Negative"), ("B", "Neutral"), ("Z", "Positive"), ("B", "garbled")],
        "App string, Sentiment string")
    apps = spark.createDataFrame([("A", "Tools"), ("A", "Games"), ("B", "Finance")],
                                 "App string, Category string")
    out = adapt_sentiment_reviews(sentiment, apps)
    assert out.columns == ["review_id", "app_name", "category", "rating", "review_date", "user_id"]
    got = rows_of(out, "app_name", "category", "rating")
    assert got == [("A", "Games", 1), ("A", "Games", 5), ("B", "Finance", None), ("B", "Finance", 3),
                   ("Z", None, 5)]
    q1 = core.overall_nps(out).collect()[0]
    assert (q1.total_reviews, q1.promoters, q1.detractors) == (4, 2, 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_driver_coverage_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    odd = [*DEVICES, "a\u0001b", "\u0000"]           # labels are open strings
    reviews = [(rnd.choice([1, 2, 3, 4, 5, 5, 5]), f"u{rnd.randrange(40)}", rnd.choice(CATS)) for _ in range(700)]
    users = [(f"u{i}", rnd.choice(odd), rnd.choice(REGIONS), rnd.choice([None, 5, 60, 200, 900])) for i in range(35)]
    rv, us = make_reviews(spark, reviews), make_users(spark, users)
    lab = core.labels(device_null="unknown", age_null="unknown")
    rows = tag_with_users(rv, us).select(*(e.alias(k) for k, e in lab.items()), "nps_tier").collect()
    dims = dict(core.DRIVER_SETS)
    for top in (1, 3, 8):
        best = core.driver_segments_from_cells(review_cells(rv, us), min_n=10).orderBy(*rank_order()).limit(top).collect()
        hit = [r for r in rows if any(all(r[d] == s[d] for d in dims[s.segment_type]) for s in best)]
        got = extended.driver_coverage(rv, us, top=top, min_n=10).head()
        assert (got.reviews_covered, got.total_reviews, got.detractors_covered, got.total_detractors) == (
            len(hit), len(rows), sum(r.nps_tier == "detractor" for r in hit), sum(r.nps_tier == "detractor" for r in rows))
