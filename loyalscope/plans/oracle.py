"""DuckDB SQL for every registered query: the independent check the driver runs beside Spark.

The oracles are written the long way round - one aggregate per segment type stacked with UNION
ALL, correlated subqueries for peer means, ranks computed before the LIMIT - over the same fixture
views. Rounded values use integer arithmetic (``//``) for ``ROUND(num / den, k)``, half away from
zero, which is the exact decimal rule the Spark side evaluates with decimals.
"""

from __future__ import annotations

from loyalscope.functions.buckets import AGE_LABELS
from loyalscope.sources import fixtures as fx


def ratio(num: str, den: str, places: int) -> str:
    """Exact ``ROUND(num / den, places)`` of integers, as DOUBLE; NULL when den = 0."""
    s = 10 ** places
    n = f"CAST({num} AS HUGEINT)"
    return (f"(CAST(SIGN({n}) * ((2 * ABS({n}) * {s} + ({den})) // (2 * NULLIF({den}, 0)))"
            f" AS DOUBLE) / {s})")


def ratio_int(num: str, den: str) -> str:
    """Exact ``ROUND(num / den)`` of integers, as BIGINT."""
    n = f"CAST({num} AS HUGEINT)"
    return f"CAST(SIGN({n}) * ((2 * ABS({n}) + ({den})) // (2 * NULLIF({den}, 0))) AS BIGINT)"


PREFIX = f"WITH reviews AS ({fx.REVIEWS_SQL}), user_attributes AS ({fx.USER_ATTRIBUTES_SQL})"

LAX = "CASE WHEN rating >= 4 THEN 'promoter' WHEN rating = 3 THEN 'passive' ELSE 'detractor' END"
STRICT = ("CASE WHEN rating >= 4 THEN 'promoter' WHEN rating = 3 THEN 'passive' "
          "WHEN rating <= 2 THEN 'detractor' END")
TIER_CODE = "CASE WHEN rating >= 4 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END"

_LONG = AGE_LABELS["long"]
_SHORT = AGE_LABELS["short"]


def age_case(labels: str = "long", null: str = "veteran", col: str = "account_age_days") -> str:
    names = _LONG if labels == "long" else _SHORT
    head = f"WHEN {col} IS NULL THEN 'unknown' " if null == "unknown" else ""
    return (f"CASE {head}WHEN {col} <= 30 THEN '{names[0]}' WHEN {col} <= 90 THEN '{names[1]}' "
            f"WHEN {col} <= 365 THEN '{names[2]}' ELSE '{names[3]}' END")


COUNTS = ("COUNT(*) AS n, COUNT(*) FILTER (WHERE nps_tier = 'promoter') AS p, "
          "COUNT(*) FILTER (WHERE nps_tier = 'passive') AS q, "
          "COUNT(*) FILTER (WHERE nps_tier = 'detractor') AS d, "
          "CAST(SUM(rating) AS BIGINT) AS rs")
SCORE = ratio("100 * (p - d)", "n", 1)
S10 = ratio_int("1000 * (p - d)", "n")

TAGGED = (
    "tagged AS (SELECT r.review_id, r.user_id, r.category, r.rating, u.device_type, u.region, "
    f"u.account_age_days, {LAX.replace('rating', 'r.rating')} AS nps_tier "
    "FROM reviews r LEFT JOIN user_attributes u ON r.user_id = u.user_id "
    "WHERE r.rating IS NOT NULL)"
)


def stacked(source: str, branches: list[tuple[str, str, str]]) -> str:
    """UNION ALL of ``SELECT type, value, counts FROM source GROUP BY keys`` branches."""
    parts = []
    for seg_type, value, keys in branches:
        group = f" GROUP BY {keys}" if keys else ""
        parts.append(f"SELECT '{seg_type}' AS segment_type, {value} AS segment_value, {COUNTS} "
                     f"FROM {source}{group}")
    return " UNION ALL ".join(parts)


def _q2_segments(with_total: bool = False) -> str:
    branches = [
        ("device_type", "COALESCE(device_type, 'unknown')", "device_type"),
        ("region", "COALESCE(region, 'unknown')", "region"),
        ("account_age", "COALESCE(age_bucket, 'unknown')", "age_bucket"),
        ("category", "COALESCE(category, 'unknown')", "category"),
    ]
    if with_total:
        branches.append(("total", "'all'", ""))
    return (f"{PREFIX}, {TAGGED}, t2 AS (SELECT *, {age_case()} AS age_bucket FROM tagged), "
            f"segs AS ({stacked('t2', branches)})")


T5 = (f"t5 AS (SELECT COALESCE(device_type, 'unknown') AS dev, COALESCE(region, 'unknown') AS reg, "
      f"{age_case('short')} AS age, category, nps_tier, rating FROM tagged)")
T6 = (f"t6 AS (SELECT COALESCE(device_type, 'unknown') AS dev, COALESCE(region, 'unknown') AS reg, "
      f"{age_case('long', 'unknown')} AS age, category, nps_tier, rating FROM tagged)")


def _benchmark(min_n: int) -> str:
    segs = stacked("t5", [("device_type", "dev", "dev"), ("region", "reg", "reg"),
                          ("account_age", "age", "age"), ("category", "category", "category")])
    peer = (f"(SELECT {ratio_int('SUM(b.s10)', 'COUNT(*)')} FROM segs b "
            f"WHERE b.segment_type = a.segment_type AND b.n >= {min_n})")
    return f"""{PREFIX}, {TAGGED}, {T5},
segs0 AS ({segs}),
segs AS (SELECT *, {S10} AS s10 FROM segs0),
ov AS (SELECT {S10} AS o10 FROM (SELECT {COUNTS} FROM t5)),
a AS (SELECT a.*, {peer} AS pk, (SELECT o10 FROM ov) AS o10 FROM segs a WHERE a.n >= {min_n})
SELECT segment_type, segment_value, n AS review_count, {SCORE} AS nps_score,
  {ratio('100 * d', 'n', 1)} AS detractor_pct,
  {ratio('o10', '10', 1)} AS overall_nps,
  {ratio('pk', '10', 1)} AS avg_nps_for_segment_type,
  {ratio('s10 - pk', '10', 1)} AS vs_peer_group_avg,
  {ratio('s10 - o10', '10', 1)} AS vs_overall_nps
FROM a"""


def _drivers_ranked(min_n: int = 30) -> str:
    """CTEs up to ``ranked``: every scored Q6 segment with its keys, impact and dense rank."""
    branches = []
    for seg_type, label, keys, kd, ka, kr, kc in [
        ("device_type", "dev", "dev", "dev", "NULL", "NULL", "NULL"),
        ("region", "reg", "reg", "NULL", "NULL", "reg", "NULL"),
        ("account_age", "age", "age", "NULL", "age", "NULL", "NULL"),
        ("category", "category", "category", "NULL", "NULL", "NULL", "category"),
        ("device × age", "dev || ' · ' || age", "dev, age", "dev", "age", "NULL", "NULL"),
    ]:
        branches.append(
            f"SELECT '{seg_type}' AS segment_type, {label} AS segment_label, {kd} AS k_dev, "
            f"{ka} AS k_age, {kr} AS k_reg, {kc} AS k_cat, {COUNTS} FROM t6 GROUP BY {keys}")
    impact = ratio("ABS(LEAST(s10 - o10, 0)) * n", "10 * total", 2)
    return f"""{PREFIX}, {TAGGED}, {T6},
ov AS (SELECT n AS total, {S10} AS o10 FROM (SELECT {COUNTS} FROM t6)),
segs AS (SELECT *, {S10} AS s10 FROM ({" UNION ALL ".join(branches)})),
scored AS (SELECT s.*, ov.o10, ov.total FROM segs s, ov WHERE s.n >= {min_n} AND s.s10 < ov.o10),
ranked AS (SELECT *, {impact} AS impact,
  CAST(DENSE_RANK() OVER (ORDER BY {impact} DESC) AS INTEGER) AS impact_rank FROM scored)"""


ORDER_RANKED = "ORDER BY impact DESC, segment_type NULLS FIRST, segment_label NULLS FIRST"


def _monthly() -> str:
    return (f"{PREFIX}, m AS (SELECT strftime(review_date, '%Y-%m-01') AS review_month, {COUNTS} "
            f"FROM (SELECT review_date, rating, {LAX} AS nps_tier FROM reviews "
            f"WHERE rating IS NOT NULL AND review_date IS NOT NULL) GROUP BY 1), "
            f"ms AS (SELECT *, {S10} AS s10 FROM m)")


ORACLES: dict[str, str] = {}

ORACLES["overall_nps"] = f"""{PREFIX},
c AS (SELECT {COUNTS} FROM (SELECT rating, {STRICT} AS nps_tier FROM reviews WHERE rating BETWEEN 1 AND 5))
SELECT n AS total_reviews, p AS promoters, q AS passives, d AS detractors,
  {ratio('100 * p', 'n', 1)} AS promoter_pct, {ratio('100 * q', 'n', 1)} AS passive_pct,
  {ratio('100 * d', 'n', 1)} AS detractor_pct, {SCORE} AS nps_score FROM c"""

ORACLES["tagged_reviews"] = f"""{PREFIX}
SELECT review_id, rating, {STRICT} AS nps_tier,
  CASE WHEN rating >= 4 THEN 1 WHEN rating = 3 THEN 0 WHEN rating <= 2 THEN -1 END AS nps_value
FROM reviews WHERE rating BETWEEN 1 AND 5"""

ORACLES["tagged_with_users"] = f"""{PREFIX}, {TAGGED}
SELECT review_id, user_id, rating, nps_tier, device_type, region, account_age_days,
  {age_case('long')} AS age_bucket, {age_case('short')} AS age_bucket_short,
  {age_case('long', 'unknown')} AS age_bucket_or_unknown,
  COALESCE(device_type, 'unknown') AS device_or_unknown, COALESCE(region, 'unknown') AS region_or_unknown
FROM tagged"""

ORACLES["segment_nps"] = f"""{_q2_segments()}
SELECT segment_type, segment_value, n AS review_count, p AS promoters, q AS passives,
  d AS detractors, {SCORE} AS nps_score FROM segs"""

ORACLES["parquet_segment_nps"] = ORACLES["segment_nps"]

ORACLES["segment_nps_free_dims"] = f"""{PREFIX},
t AS (SELECT r.app_name, u.nation, r.rating, {LAX.replace('rating', 'r.rating')} AS nps_tier,
  {age_case(col='u.account_age_days')} AS age_bucket
  FROM reviews r LEFT JOIN user_attributes u ON r.user_id = u.user_id WHERE r.rating IS NOT NULL),
segs AS ({stacked("t", [("app_name", "COALESCE(app_name, 'unknown')", "app_name"),
                        ("nation", "COALESCE(nation, 'unknown')", "nation"),
                        ("account_age", "age_bucket", "age_bucket")])})
SELECT segment_type, segment_value, n AS review_count, p AS promoters, q AS passives,
  d AS detractors, {SCORE} AS nps_score FROM segs"""

ORACLES["monthly_trend"] = f"""{_monthly()},
w AS (SELECT *,
  LAG(s10) OVER (ORDER BY review_month) AS prev10,
  SUM(s10) OVER (ORDER BY review_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll_sum,
  COUNT(*) OVER (ORDER BY review_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll_n,
  SUM(s10) OVER (ORDER BY review_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_sum,
  COUNT(*) OVER (ORDER BY review_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_n,
  CAST(RANK() OVER (ORDER BY s10 DESC) AS INTEGER) AS nps_rank_best
  FROM ms)
SELECT review_month, n AS total_reviews, p AS promoters, q AS passives, d AS detractors,
  {SCORE} AS nps_score, {ratio('prev10', '10', 1)} AS prev_month_nps,
  {ratio('s10 - prev10', '10', 1)} AS mom_delta,
  {ratio('roll_sum', '10 * roll_n', 1)} AS rolling_3mo_avg,
  {ratio('cum_sum', '10 * cum_n', 1)} AS cumulative_avg_nps, nps_rank_best,
  CASE WHEN s10 * roll_n > roll_sum THEN 'above_trend' ELSE 'below_trend' END AS vs_rolling_avg,
  CASE WHEN prev10 IS NULL THEN 'first_month' WHEN s10 > prev10 + 20 THEN 'improving'
       WHEN s10 < prev10 - 20 THEN 'declining' ELSE 'stable' END AS trend_direction
FROM w"""

ORACLES["csv_monthly_trend"] = ORACLES["monthly_trend"]

ORACLES["device_age_nps"] = f"""{PREFIX}, {TAGGED},
g AS (SELECT device_type, age_bucket, {COUNTS}
      FROM (SELECT *, {age_case('short')} AS age_bucket FROM tagged) GROUP BY device_type, age_bucket)
SELECT device_type, age_bucket, n AS review_count, p AS promoters, d AS detractors,
  {SCORE} AS nps_score, {ratio('100 * d', 'n', 1)} AS detractor_pct,
  {ratio('rs', 'n', 2)} AS avg_star_rating
FROM g WHERE n >= 20"""

for _style, _label in (("case", "case_when"), ("filter", "filter")):
    if _style == "case":
        _cnt = ", ".join(
            f"CAST(SUM(CASE WHEN nps_tier = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {a}"
            for t, a in (("promoter", "p"), ("passive", "q"), ("detractor", "d")))
    else:
        _cnt = ", ".join(f"COUNT(*) FILTER (WHERE nps_tier = '{t}') AS {a}"
                         for t, a in (("promoter", "p"), ("passive", "q"), ("detractor", "d")))
    ORACLES[f"tier_counts_{_style}"] = f"""{PREFIX}, {TAGGED},
g AS (SELECT device_type, COUNT(*) AS n, {_cnt} FROM tagged GROUP BY device_type)
SELECT '{_label}' AS approach, device_type, n AS total, p AS promoters, q AS passives,
  d AS detractors, {SCORE} AS nps_score FROM g"""

ORACLES["segment_benchmark"] = _benchmark(20)

# The documented benchmark formula: a segment's score less the plain mean score of its type.
ORACLES["peer_gap_all"] = f"""{PREFIX}, {TAGGED}, {T5},
nps_by_segment AS (SELECT segment_type, segment_value, n AS review_count, {SCORE} AS nps_score FROM (
  {stacked("t5", [("device_type", "dev", "dev"), ("region", "reg", "reg"), ("account_age", "age", "age"),
                  ("category", "category", "category")])}))
SELECT segment_type, segment_value, review_count, nps_score, ROUND(nps_score - (
  SELECT AVG(nps_score) FROM nps_by_segment b WHERE b.segment_type = a.segment_type), 9) + 0.0 AS vs_segment_avg
FROM nps_by_segment a"""

ORACLES["negative_drivers"] = f"""{_drivers_ranked()}
SELECT impact_rank, segment_type, segment_label, n AS review_count, {SCORE} AS nps_score,
  {ratio('o10', '10', 1)} AS overall_nps, {ratio('s10 - o10', '10', 1)} AS gap_vs_overall,
  {ratio('100 * d', 'n', 1)} AS detractor_pct, impact AS negative_impact_score
FROM ranked {ORDER_RANKED} LIMIT 15"""

ORACLES["segment_rollup"] = f"""{_q2_segments(with_total=True)}
SELECT segment_type, segment_value, n AS review_count, p AS promoters, q AS passives,
  d AS detractors, {SCORE} AS nps_score, {ratio('100 * p', 'n', 1)} AS promoter_pct,
  {ratio('100 * d', 'n', 1)} AS detractor_pct FROM segs"""

ORACLES["nps_bands"] = f"""{_q2_segments(with_total=True)},
sc AS (SELECT segment_type, segment_value, n, {SCORE} AS nps_score FROM segs)
SELECT segment_type, segment_value, n AS review_count, nps_score,
  CASE WHEN nps_score < 0 THEN 'needs_attention' WHEN nps_score < 30 THEN 'acceptable'
       WHEN nps_score <= 70 THEN 'good' WHEN nps_score > 70 THEN 'excellent' END AS nps_band
FROM sc"""

ORACLES["device_region_nps"] = f"""{PREFIX}, {TAGGED},
g AS (SELECT device_type, region, {COUNTS} FROM tagged GROUP BY device_type, region)
SELECT COALESCE(device_type, 'unknown') AS device_type, COALESCE(region, 'unknown') AS region,
  n AS review_count, p AS promoters, q AS passives, d AS detractors, {SCORE} AS nps_score,
  {ratio('100 * d', 'n', 1)} AS detractor_pct FROM g"""

ORACLES["three_way_nps"] = f"""{PREFIX}, {TAGGED}, {T6},
ov AS (SELECT n AS total, {S10} AS o10 FROM (SELECT {COUNTS} FROM t6)),
g AS (SELECT dev, reg, age, {COUNTS} FROM t6 GROUP BY dev, reg, age),
s AS (SELECT g.*, {S10} AS s10, (SELECT o10 FROM ov) AS o10, (SELECT total FROM ov) AS total FROM g)
SELECT dev AS device_type, reg AS region, age AS age_bucket, n AS review_count, {SCORE} AS nps_score,
  {ratio('s10 - o10', '10', 1)} AS gap_vs_overall, {ratio('100 * d', 'n', 1)} AS detractor_pct,
  {ratio('ABS(LEAST(s10 - o10, 0)) * n', '10 * total', 2)} AS negative_impact_score
FROM s"""

ORACLES["driver_coverage"] = f"""{_drivers_ranked()},
top AS (SELECT * FROM ranked {ORDER_RANKED} LIMIT 3),
cov AS (SELECT t6.nps_tier, EXISTS (SELECT 1 FROM top WHERE
    (top.segment_type = 'device_type' AND top.k_dev = t6.dev)
    OR (top.segment_type = 'region' AND top.k_reg = t6.reg)
    OR (top.segment_type = 'account_age' AND top.k_age = t6.age)
    OR (top.segment_type = 'category' AND top.k_cat IS NOT DISTINCT FROM t6.category)
    OR (top.segment_type = 'device × age' AND top.k_dev = t6.dev AND top.k_age = t6.age)) AS hit
  FROM t6),
c AS (SELECT COUNT(*) FILTER (WHERE hit) AS rc, COUNT(*) AS rt,
             COUNT(*) FILTER (WHERE hit AND nps_tier = 'detractor') AS dc,
             COUNT(*) FILTER (WHERE nps_tier = 'detractor') AS dt FROM cov)
SELECT CAST(3 AS INTEGER) AS top_k, rc AS reviews_covered, rt AS total_reviews,
  {ratio('100 * rc', 'rt', 1)} AS review_share_pct, dc AS detractors_covered, dt AS total_detractors,
  {ratio('100 * dc', 'dt', 1)} AS detractor_share_pct FROM c"""

ORACLES["sentiment_adapter"] = f"""WITH sentiment AS ({fx.SENTIMENT_SQL}), apps AS ({fx.APPS_SQL}),
app_dim AS (SELECT App, MIN(Category) AS category FROM apps GROUP BY App)
SELECT CAST(s.review_id AS BIGINT) AS review_id, s.App AS app_name, a.category,
  CAST(CASE s.Sentiment WHEN 'Positive' THEN 5 WHEN 'Neutral' THEN 3 WHEN 'Negative' THEN 1 END AS INTEGER) AS rating,
  CAST(NULL AS DATE) AS review_date, CAST(NULL AS VARCHAR) AS user_id
FROM sentiment s LEFT JOIN app_dim a ON s.App = a.App"""

ORACLES["sentiment_category_nps"] = f"""WITH sentiment AS ({fx.SENTIMENT_SQL}), apps AS ({fx.APPS_SQL}),
app_dim AS (SELECT App, MIN(Category) AS category FROM apps GROUP BY App),
adapted AS (SELECT a.category,
  CASE s.Sentiment WHEN 'Positive' THEN 5 WHEN 'Neutral' THEN 3 WHEN 'Negative' THEN 1 END AS rating
  FROM sentiment s LEFT JOIN app_dim a ON s.App = a.App),
g AS (SELECT category, {COUNTS} FROM (SELECT category, rating, {LAX} AS nps_tier FROM adapted
      WHERE rating IS NOT NULL) GROUP BY category)
SELECT COALESCE(category, 'unknown') AS category, n AS review_count, p AS promoters, q AS passives,
  d AS detractors, {SCORE} AS nps_score FROM g"""

ORACLES["trend_endpoints"] = f"""{_monthly()}
SELECT MIN(review_month) AS first_month, MAX(review_month) AS last_month, COUNT(*) AS months,
  {ratio('arg_min(s10, review_month)', '10', 1)} AS first_nps,
  {ratio('arg_max(s10, review_month)', '10', 1)} AS last_nps,
  {ratio('arg_max(s10, review_month) - arg_min(s10, review_month)', '10', 1)} AS nps_change
FROM ms"""

ORACLES["monthly_nps_interval"] = f"""{_monthly()},
x AS (SELECT *, CAST(p - d AS DOUBLE) / n AS diff, CAST(p + d AS DOUBLE) / n AS share FROM ms),
y AS (SELECT *, diff * 100.0 AS center, CAST(196.0 AS DOUBLE) * SQRT((share - diff * diff) / n) AS margin FROM x)
SELECT review_month, n AS total_reviews, {SCORE} AS nps_score,
  ROUND(center - margin, 1) + 0.0 AS nps_ci_low, ROUND(center + margin, 1) + 0.0 AS nps_ci_high
FROM y"""

ORACLES["detractor_words"] = r"""WITH docs AS (
  SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS words
  FROM documents),
lab AS (SELECT d.words, l.toxic = 1 AS is_det FROM docs d JOIN labels l ON d.doc_id = l.doc_id),
tot AS (SELECT COUNT(*) AS docs, COUNT(*) FILTER (WHERE is_det) AS det FROM lab),
pw AS (SELECT word, COUNT(*) AS docs, COUNT(*) FILTER (WHERE is_det) AS det
       FROM (SELECT unnest(words) AS word, is_det FROM lab) GROUP BY word)
""" + f"""SELECT word, det AS detractor_docs, docs - det AS other_docs,
  {ratio('100 * det', 'docs', 1)} AS detractor_doc_pct,
  {ratio('det * (SELECT docs FROM tot)', 'docs * (SELECT det FROM tot)', 2)} AS lift
FROM pw"""

ORACLES["recovery_transitions"] = f"""{PREFIX},
seq AS (SELECT user_id, review_date, review_id, {TIER_CODE} AS tier FROM reviews
        WHERE rating IS NOT NULL AND review_date IS NOT NULL AND user_id IS NOT NULL),
nx AS (SELECT tier AS f, LEAD(tier) OVER (PARTITION BY user_id ORDER BY review_date, review_id, tier) AS t FROM seq),
g AS (SELECT f, t, COUNT(*) AS transitions FROM nx WHERE t IS NOT NULL GROUP BY f, t),
h AS (SELECT *, CAST(SUM(transitions) OVER (PARTITION BY f) AS BIGINT) AS from_total FROM g)
SELECT ['promoter', 'passive', 'detractor'][f + 1] AS from_tier, ['promoter', 'passive', 'detractor'][t + 1] AS to_tier,
  transitions, from_total, {ratio('100 * transitions', 'from_total', 1)} AS transition_pct FROM h"""

ORACLES["input_checks"] = f"""{PREFIX}
SELECT 'null_review_id' AS check_name, COUNT(*) FILTER (WHERE review_id IS NULL) AS violations, COUNT(*) AS rows_checked FROM reviews
UNION ALL SELECT 'duplicate_review_id', COUNT(review_id) - COUNT(DISTINCT review_id), COUNT(*) FROM reviews
UNION ALL SELECT 'null_rating', COUNT(*) FILTER (WHERE rating IS NULL), COUNT(*) FROM reviews
UNION ALL SELECT 'rating_out_of_range', COUNT(*) FILTER (WHERE rating NOT BETWEEN 1 AND 5), COUNT(*) FROM reviews
UNION ALL SELECT 'null_review_date', COUNT(*) FILTER (WHERE review_date IS NULL), COUNT(*) FROM reviews
UNION ALL SELECT 'null_user_id', COUNT(*) FILTER (WHERE user_id IS NULL), COUNT(*) FROM reviews
UNION ALL SELECT 'duplicate_user_id', COUNT(user_id) - COUNT(DISTINCT user_id), COUNT(*) FROM user_attributes
UNION ALL SELECT 'null_account_age', COUNT(*) FILTER (WHERE account_age_days IS NULL), COUNT(*) FROM user_attributes
UNION ALL SELECT 'null_device_type', COUNT(*) FILTER (WHERE device_type IS NULL), COUNT(*) FROM user_attributes
UNION ALL SELECT 'null_region', COUNT(*) FILTER (WHERE region IS NULL), COUNT(*) FROM user_attributes
UNION ALL SELECT 'review_user_unknown', COUNT(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM user_attributes u WHERE u.user_id = r.user_id)), COUNT(*)
  FROM reviews r WHERE r.user_id IS NOT NULL
UNION ALL SELECT 'user_without_reviews', COUNT(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM reviews r WHERE r.user_id = u.user_id)), COUNT(*)
  FROM (SELECT DISTINCT user_id FROM user_attributes WHERE user_id IS NOT NULL) u"""

ORACLES["sentiment_file_nps"] = ORACLES["sentiment_category_nps"]

ORACLES["input_check_ids"] = f"""{PREFIX}
SELECT 'duplicate_review_id' AS check_name, CAST(review_id AS VARCHAR) AS id, COUNT(*) AS n
  FROM reviews WHERE review_id IS NOT NULL GROUP BY review_id HAVING COUNT(*) > 1
UNION ALL SELECT 'duplicate_user_id', CAST(user_id AS VARCHAR), COUNT(*)
  FROM user_attributes WHERE user_id IS NOT NULL GROUP BY user_id HAVING COUNT(*) > 1
UNION ALL SELECT 'review_user_unknown', CAST(user_id AS VARCHAR), COUNT(*) FROM reviews r
  WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM user_attributes u WHERE u.user_id = r.user_id) GROUP BY user_id
UNION ALL SELECT 'user_without_reviews', CAST(user_id AS VARCHAR), COUNT(*) FROM user_attributes u
  WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = u.user_id) GROUP BY user_id"""
