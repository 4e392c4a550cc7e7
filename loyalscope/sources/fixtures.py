"""Oracle fixtures: the review tables as views over the generated test tables.

The same SQL column expressions are evaluated by Spark (``selectExpr``) and by DuckDB (the ``WITH``
prefix of every oracle query), so both engines see identical rows. Nothing is written anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column expressions of the fixture views.
REVIEW_COLUMNS = (
    ("review_id", "o_orderkey"),
    ("app_name", "concat('app_', cast(o_orderkey % 20 as string))"),
    ("category", "o_orderpriority"),
    ("rating", "cast(nullif(cast(floor(o_totalprice) as bigint) % 7, 0) as int)"),
    ("review_date", "case when o_orderkey % 50 = 0 then null else cast(o_orderdate as date) end"),
    ("user_id", "o_custkey"),
)
USER_COLUMNS = (
    ("user_id", "c_custkey"),
    ("device_type", "c_mktsegment"),
    ("region", "r_name"),
    ("account_age_days", "case when c_acctbal < 0 then null else cast(floor(c_acctbal / 10) as int) end"),
    ("nation", "n_name"),
)
USER_FILTER = "c_custkey % 20 <> 0"

# Sentiment-file stand-in over ``events`` and an app file over ``nation``/``region`` (adapter S3).
SENTIMENT_COLUMNS = (
    ("review_id", "event_id"),
    ("App", "cast(user_id % 30 as string)"),
    ("Sentiment", "case event_type when 'error' then 'Negative' when 'view' then 'Neutral' else 'Positive' end"),
)
# The review text of a file row: a comma, quotes and line breaks inside one field.
SENTIMENT_TEXT = "concat('event ', review_id, ', \"', Sentiment, '\"\\nsecond line', repeat('\\n', cast(review_id % 3 as int)))"
APP_COLUMNS = (
    ("App", "cast(n_nationkey as string)"),
    ("Category", "r_name"),
)

# The columns of the generated tables that the views read. Nothing is inferred, so building
# a view runs no job.
TABLES = {
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id long, user_id long, event_type string",
    "documents": "doc_id long, text string",
    "labels": "doc_id long, toxic int",
}


# The review date as the text of a file: every 50th unknown date is written as an impossible one instead.
TEXT_DATE = ("case when review_date is null and review_id % 100 = 0 then '2022-02-30' "
             "when review_date is null then 'bad' else date_format(review_date, 'yyyy-MM-dd') end")


def _select_sql(columns) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {n}" for n, e in REVIEW_COLUMNS))


def user_attributes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").where(USER_FILTER)
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    joined = (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
              .join(region, nation.n_regionkey == region.r_regionkey, "left"))
    return joined.selectExpr(*(f"{e} AS {n}" for n, e in USER_COLUMNS))


def sentiment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in SENTIMENT_COLUMNS))


def apps_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return joined.selectExpr(*(f"{e} AS {n}" for n, e in APP_COLUMNS))


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def labels_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels")


# ---- the same views as SQL text, for the DuckDB oracles -------------------------------------

REVIEWS_SQL = f"SELECT {_select_sql(REVIEW_COLUMNS)} FROM orders"
USER_ATTRIBUTES_SQL = (
    f"SELECT {_select_sql(USER_COLUMNS)} FROM customer "
    "LEFT JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN region ON n_regionkey = r_regionkey "
    f"WHERE {USER_FILTER}"
)
SENTIMENT_SQL = f"SELECT {_select_sql(SENTIMENT_COLUMNS)} FROM events"
APPS_SQL = (
    f"SELECT {_select_sql(APP_COLUMNS)} FROM nation "
    "LEFT JOIN region ON n_regionkey = r_regionkey"
)
