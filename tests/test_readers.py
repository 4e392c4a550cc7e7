"""Readers: given schemas, text dates, lines that do not parse, the sentiment and app files, free dimensions."""

from __future__ import annotations

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loyalscope.__main__ import main
from loyalscope.operators.checks import input_check_ids, input_checks
from loyalscope.operators.tagging import tag_with_users
from loyalscope.plans import core
from loyalscope.plans.report import nps_report
from loyalscope.sources.quoted_csv import csv_records, read_quoted_csv
from loyalscope.sources import adapt_sentiment_reviews, read_apps, read_reviews, read_sentiment_reviews, read_user_attributes
from tests.conftest import make_reviews, make_users, rows_of


def test_parquet_reviews_with_text_dates(spark, tmp_path):
    rows = [(1, "a", "Tools", 5, "2022-02-28", "u"), (2, "a", "Tools", 1, "2022-02-30", "u"), (3, "a", None, 4, "bad", "u"), (4, "a", "x", 2, None, None)]
    spark.createDataFrame(rows, "review_id long, app_name string, category string, rating int, review_date string, user_id string") \
        .write.parquet(str(tmp_path / "r"))
    reviews = read_reviews(spark, str(tmp_path / "r"), text_dates=True)
    assert rows_of(reviews, "review_id", "review_date") == [(1, dt.date(2022, 2, 28)), (2, None), (3, None), (4, None)]
    assert [r.review_month for r in core.monthly_nps_trend(reviews).collect()] == ["2022-02-01"]


def test_lines_that_do_not_parse_are_counted_for_both_tables(spark, tmp_path):
    (tmp_path / "u.csv").write_text("user_id,device_type,region,account_age_days\nu1,iOS,EU,10\nu2,iOS,EU,abc\n")
    (tmp_path / "r.csv").write_text("review_id,app_name,category,rating,review_date,user_id\n1,a,Tools,five,2022-01-01,u1\n2,a,Tools,5,2022-01-01,u1\n")
    users, reviews = read_user_attributes(spark, str(tmp_path / "u.csv"), "csv"), read_reviews(spark, str(tmp_path / "r.csv"), "csv")
    found = {r.check_name: r.violations for r in input_checks(reviews, users).collect()}
    assert (found["unparseable_user_row"], found["unparseable_row"], found["null_account_age"], found["null_rating"]) == (1, 1, 1, 1)
    assert sum(r.review_count for r in core.segment_nps(reviews, users).collect() if r.segment_type == "region") == 1


def test_sentiment_and_app_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('App,Translated_Review,Sentiment,Sentiment_Polarity\nA,"good, really",Positive,1.0\nB,"two\nlines",Negative,-1\nC,x,nan,nan\n')
    (tmp_path / "a.csv").write_text("App,Category,Rating\nA,Tools,4.1\nB,Games,3\n")
    adapted = adapt_sentiment_reviews(read_sentiment_reviews(spark, str(tmp_path / "s.csv")), read_apps(spark, str(tmp_path / "a.csv")))
    assert rows_of(adapted, "app_name", "category", "rating") == [("A", "Tools", 5), ("B", "Games", 1), ("C", None, None)]


@pytest.mark.parametrize("reader", [read_reviews, read_user_attributes, read_apps])
def test_unknown_format(spark, reader):
    with pytest.raises(ValueError, match="unsupported format"):
        reader(spark, "/nowhere", "xml")


def test_free_dimensions(spark):
    reviews = make_reviews(spark, [(5, "a"), (1, "b"), (4, None)])
    users = make_users(spark, [("a", "iOS", "EU", 10), ("b", None, "NA", 900)]).withColumn("plan", F.lit("paid"))
    got = rows_of(core.segment_nps(reviews, users, dims=("plan", "app_name", "device_type")), "segment_type", "segment_value", "review_count")
    assert got == [("app_name", "app", 3), ("device_type", "iOS", 1), ("device_type", "unknown", 2),
                   ("plan", "paid", 2), ("plan", "unknown", 1)]
    with pytest.raises(ValueError, match="no such dimension: colour"):
        core.segment_nps(reviews, users, dims=("colour",))


def test_report_in_a_callers_folder(spark, tmp_path):
    report = nps_report(make_reviews(spark, [(5, "a"), (1, "b")]), make_users(spark, [("a", "iOS", "EU", 10)]), path=str(tmp_path / "cells"))
    assert report["overall_nps"].head().total_reviews == 2
    assert sorted(p.name for p in (tmp_path / "cells").iterdir()) == ["report_cells", "segment_cells"]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,split,end", [(1, 700, "\n"), (2, 1000, "\r\n"), (3, 100000, "\n")])
def test_quoted_csv_over_many_splits(spark, tmp_path, small_splits, seed, split, end):
    """Records that cross one split's edge or several, held against the csv module."""
    rng, expected = random.Random(seed), []
    (tmp_path / "c").mkdir()
    for part in range(3):
        with open(tmp_path / "c" / f"{part}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["App", "Translated Review", "Sentiment"])
            for i in range(60):
                text = "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '""', '\n\n']) for _ in range(rng.choice([0, 1, 5, 30, 400])))
                row = [f"app {part} {i}", f"x{text}y", rng.choice(["Positive", "Negative", ""])]
                out.writerow(row)
                expected.append((row[0], row[1], row[2] or None))
    small_splits(split)
    got = read_quoted_csv(spark, str(tmp_path / "c"))
    assert rows_of(got, "App", "Translated Review", "Sentiment") == sorted(expected, key=lambda r: r[0])
    splits = {(r["_file"], r["_split"]) for r in csv_records(spark, str(tmp_path / "c")).select("_file", "_split").collect()}
    assert len(splits) > 3 or split == 100000


def test_quoted_csv_edges(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text, newline="")
        return rows_of(read_quoted_csv(spark, str(path)), "a", "b")
    assert read("a,b\n") == []
    assert read("a,b\n\n1,2\n\n") == [("1", "2")]
    assert read("a,b\n1\n") == [("1", None)]
    assert [r[0] for r in read('a,b\n1,"open\n2,3\n')] == ["1"]
    assert read('a,b\n"1\n","2"') == [("1\n", "2")]


def test_anonymous_reviews_do_not_travel(spark, tmp_path):
    make_reviews(spark, [(5, "a"), (1, None), (2, None), (4, "z")]).write.parquet(str(tmp_path / "r"))
    make_users(spark, [("a", "iOS", "EU", 10), (None, "x", "y", 1)]).write.parquet(str(tmp_path / "u"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tagged = tag_with_users(read_reviews(spark, str(tmp_path / "r")), read_user_attributes(spark, str(tmp_path / "u")))
        plan = tagged._jdf.queryExecution().executedPlan().toString()
        assert rows_of(tagged, "rating", "user_id", "device_type") == [(1, None, None), (2, None, None), (4, "z", None), (5, "a", "iOS")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.index("IsNull(user_id)") > plan.rindex("Exchange")
    assert plan.count("Exchange hashpartitioning(user_id") == 2


def test_ids_behind_the_checks(spark):
    reviews = make_reviews(spark, [(5, "a"), (1, "b"), (2, "b"), (3, None)])
    reviews = reviews.unionByName(reviews.where("review_id = 1")).unionByName(reviews.limit(1).withColumn("review_id", F.lit(None).cast("long")))
    users = make_users(spark, [("a", "i", "e", 1), ("a", "i", "e", 1), ("c", "i", "e", 1), ("c", "i", "e", 1), (None, "i", "e", 1)])
    assert rows_of(input_check_ids(reviews, users), "check_name", "id", "n") == [
        ("duplicate_review_id", "1", 2), ("duplicate_user_id", "a", 2), ("duplicate_user_id", "c", 2),
        ("review_user_unknown", "b", 2), ("user_without_reviews", "c", 2)]
    assert input_check_ids(reviews.limit(0), users.limit(0)).collect() == []


def test_command_line(spark, tmp_path):
    make_reviews(spark, [(5, "a"), (1, "b")]).withColumn("review_date", F.lit("2022-01-05")).write.parquet(str(tmp_path / "r"))
    make_users(spark, [("a", "iOS", "EU", 10)]).write.parquet(str(tmp_path / "u"))
    main(["--reviews", str(tmp_path / "r"), "--users", str(tmp_path / "u"), "--out", str(tmp_path / "out"), "--text-dates"])
    assert spark.read.parquet(str(tmp_path / "out/overall_nps")).head().total_reviews == 2
    assert spark.read.parquet(str(tmp_path / "out/monthly_trend")).count() == 1
    (tmp_path / "s.csv").write_text('App,Review,Sentiment\nA,"two\nlines",Positive\nB,x,Negative\n')
    (tmp_path / "a.csv").write_text("App,Category\nA,Tools\n")
    main(["--reviews", str(tmp_path / "s.csv"), "--apps", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out2")])
    assert rows_of(spark.read.parquet(str(tmp_path / "out2/category_nps")), "category", "review_count") == [("Tools", 1), ("unknown", 1)]
