"""Driver keys for the cleaning pipeline (C28, C29) and feature selection
(F1-F3) on ``dirty`` (target total_price, row order k)."""

from __future__ import annotations

from dsengine.operators import select as S
from dsengine.plans import cleaning
from dsengine.plans.fixtures import dirty, table, with_dirty
from dsengine.plans.q_categorical_clean import _CANON_CASE
from dsengine.plans.queries import LINEITEM_NUMERIC, register, rounded

TARGET, ORDER = "total_price", "k"
_NUM7 = ["k", "order_id", "customer_age", "total_price", "shipping_cost", "discount_rate",
         "item_count"]


def _canon(expr: str) -> str:
    return "(" + _CANON_CASE.replace("{c}", f"({expr})") + ")"


def _fence(c):
    return (f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi")


_HV = """(q.{c}_q3 - q.{c}_q1) <> 0 AND
   (SELECT count(*) FILTER (WHERE {c} < q.{c}_q1 - 1.5 * (q.{c}_q3 - q.{c}_q1) OR {c} > q.{c}_q3 + 1.5 * (q.{c}_q3 - q.{c}_q1)) FROM d4)
   / q.{c}_n > 0.1"""

_HEAD = """
WITH d0 AS (
  SELECT k, order_id, customer_age, gender, total_price, shipping_cost, discount_rate, priority,
    CASE lower(trim(coalesce(is_large, ''))) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS is_large,
    legacy_code, source_flag, start_date, end_date, item_count, status
  FROM dirty),
d1 AS (SELECT DISTINCT * FROM d0),
d2 AS (SELECT * FROM d1 WHERE order_id IS NOT NULL
       OR (SELECT count(DISTINCT order_id) / count(*) FROM d1) <= 0.8),
d3 AS (SELECT * FROM d2 WHERE legacy_code IS NOT NULL
       OR (SELECT count(DISTINCT legacy_code) / count(*) FROM d2) <= 0.8),
d4 AS (SELECT * EXCLUDE (legacy_code) FROM d3),
q AS (SELECT
   quantile_cont(total_price, 0.25) AS total_price_q1, quantile_cont(total_price, 0.75) AS total_price_q3,
   quantile_cont(total_price, 0.5) AS total_price_med, avg(total_price) AS total_price_mean, count(total_price) AS total_price_n,
   quantile_cont(shipping_cost, 0.25) AS shipping_cost_q1, quantile_cont(shipping_cost, 0.75) AS shipping_cost_q3,
   quantile_cont(shipping_cost, 0.5) AS shipping_cost_med, avg(shipping_cost) AS shipping_cost_mean, count(shipping_cost) AS shipping_cost_n,
   (SELECT v FROM (SELECT priority AS v, count(*) AS n FROM d4 WHERE priority IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS priority_mode,
   (SELECT v FROM (SELECT is_large AS v, count(*) AS n FROM d4 WHERE is_large IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS is_large_mode,
   (SELECT arg_min(end_date, k) FROM d4 WHERE end_date IS NOT NULL) AS end_date_first
  FROM d4),
hv AS (SELECT q.*, """ + _HV.format(c="total_price") + """ AS total_price_hv,
   """ + _HV.format(c="shipping_cost") + """ AS shipping_cost_hv FROM q),
"""

_PIPELINE_SQL = with_dirty(_HEAD + f"""
d5 AS (SELECT k, order_id, customer_age, gender,
   coalesce(total_price, CASE WHEN total_price_hv THEN total_price_med ELSE total_price_mean END) AS total_price,
   coalesce(shipping_cost, CASE WHEN shipping_cost_hv THEN shipping_cost_med ELSE shipping_cost_mean END) AS shipping_cost,
   discount_rate, coalesce(priority, priority_mode) AS priority, coalesce(is_large, is_large_mode) AS is_large,
   source_flag, start_date,
   coalesce(last_value(end_date IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            end_date_first) AS end_date,
   item_count, status FROM d4, hv),
d6 AS (SELECT CAST(k AS DOUBLE) AS k, CAST(order_id AS DOUBLE) AS order_id,
   CAST(customer_age AS DOUBLE) AS customer_age, {_canon('lower(trim(gender))')} AS gender,
   CAST(total_price AS DOUBLE) AS total_price, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
   CAST(discount_rate AS DOUBLE) AS discount_rate, {_canon('lower(trim(priority))')} AS priority,
   is_large, source_flag,
   {_canon("strftime(TRY_CAST(start_date AS DATE), '%Y-%m-%d')")} AS start_date,
   {_canon("strftime(TRY_CAST(end_date AS DATE), '%Y-%m-%d')")} AS end_date,
   CAST(item_count AS DOUBLE) AS item_count, {_canon('lower(trim(status))')} AS status FROM d5),
f AS (SELECT {', '.join(_fence(c) for c in _NUM7)} FROM d6),
d7 AS (SELECT {', '.join(f'least(greatest({c}, f.{c}_lo), f.{c}_hi) AS {c}' for c in _NUM7)},
   gender, priority, is_large, source_flag, start_date, end_date, status FROM d6, f),
d8 AS (SELECT * REPLACE (
   CASE WHEN customer_age < 0 OR customer_age > 120 THEN NULL ELSE customer_age END AS customer_age,
   CASE WHEN discount_rate < 0 OR discount_rate > 100 THEN NULL ELSE discount_rate END AS discount_rate)
   FROM d7),
d9 AS (SELECT * REPLACE (
   CASE WHEN gender IN (SELECT gender FROM d8 GROUP BY 1 HAVING count(*) / (SELECT count(gender) FROM d8) < 0.01) THEN 'Other' ELSE gender END AS gender,
   CASE WHEN priority IN (SELECT priority FROM d8 GROUP BY 1 HAVING count(*) / (SELECT count(priority) FROM d8) < 0.01) THEN 'Other' ELSE priority END AS priority,
   CASE WHEN status IN (SELECT status FROM d8 GROUP BY 1 HAVING count(*) / (SELECT count(status) FROM d8) < 0.01) THEN 'Other' ELSE status END AS status)
   FROM d8),
d10 AS (SELECT * EXCLUDE (source_flag, order_id) FROM d9)
SELECT round(k, 6) AS k, round(customer_age, 6) AS customer_age, gender,
  round(total_price, 6) AS total_price, round(shipping_cost, 6) AS shipping_cost,
  round(discount_rate, 6) AS discount_rate, priority, is_large, start_date, end_date,
  round(item_count, 6) AS item_count, status
FROM d10 WHERE k IS NOT NULL AND customer_age IS NOT NULL AND gender IS NOT NULL AND total_price IS NOT NULL
  AND shipping_cost IS NOT NULL AND discount_rate IS NOT NULL AND priority IS NOT NULL AND is_large IS NOT NULL
  AND start_date IS NOT NULL AND end_date IS NOT NULL AND item_count IS NOT NULL AND status IS NOT NULL""")


def _clean(spark, sf):
    return cleaning.clean(dirty(spark, sf), target=TARGET, order_by=ORDER)


@register("clean_table", _PIPELINE_SQL)
def q_clean_table(spark, sf):
    return rounded(_clean(spark, sf).df)


_D4_COLUMNS = ["k", "order_id", "customer_age", "gender", "total_price", "shipping_cost",
               "discount_rate", "priority", "is_large", "source_flag", "start_date", "end_date",
               "item_count", "status"]
_FINAL_COLUMNS = ["k", "customer_age", "gender", "total_price", "shipping_cost", "discount_rate",
                  "priority", "is_large", "start_date", "end_date", "item_count", "status"]
# removed columns in the order the rules fire: K6, C6, C21, C22
_REMOVED = [("customer_name", "fully_categorical"), ("legacy_code", "missing_values"),
            ("source_flag", "irrelevant/constant"), ("order_id", "irrelevant/constant")]


def _report_sql() -> str:
    body = _PIPELINE_SQL.split("\nSELECT round(k, 6) AS k,")[0]
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _D4_COLUMNS)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in _FINAL_COLUMNS)
    removed = "\n  UNION ALL ".join(
        f"SELECT 'removed_column' AS metric, CAST({i} AS DOUBLE) AS value, '{c}:{why}' AS detail"
        for i, (c, why) in enumerate(_REMOVED))
    return body + f""",
fin AS (SELECT * FROM d10 WHERE {complete})
SELECT metric, value, detail FROM (
  {removed}
  UNION ALL SELECT 'rows_before', CAST((SELECT count(*) FROM dirty) AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'columns_before', CAST(16 AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'duplicates_removed', CAST((SELECT count(*) FROM d0) - (SELECT count(*) FROM d1) AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'identifier_rows_removed', CAST((SELECT count(*) FROM d1) - (SELECT count(*) FROM d3) AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'imputed_cells', CAST((SELECT {nulls} FROM d4) AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'rows_after', CAST((SELECT count(*) FROM fin) AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'columns_after', CAST({len(_FINAL_COLUMNS)} AS DOUBLE), CAST(NULL AS STRING)
  UNION ALL SELECT 'final_rows_removed', CAST((SELECT count(*) FROM d10) - (SELECT count(*) FROM fin) AS DOUBLE), CAST(NULL AS STRING))"""


@register("cleaning_report", _report_sql())
def q_cleaning_report(spark, sf):
    return cleaning.cleaning_summary(_clean(spark, sf))


@register("imputed_by_method", with_dirty(_HEAD + """
cells AS (
  SELECT CASE WHEN total_price_hv THEN 'median (high variation detected)' ELSE 'mean' END AS method,
         (SELECT count(*) FILTER (WHERE total_price IS NULL) FROM d4) AS n FROM hv
  UNION ALL
  SELECT CASE WHEN shipping_cost_hv THEN 'median (high variation detected)' ELSE 'mean' END,
         (SELECT count(*) FILTER (WHERE shipping_cost IS NULL) FROM d4) FROM hv
  UNION ALL SELECT 'ffill/bfill', count(*) FILTER (WHERE end_date IS NULL) FROM d4
  UNION ALL SELECT 'mode', count(*) FILTER (WHERE priority IS NULL) + count(*) FILTER (WHERE is_large IS NULL) FROM d4)
SELECT method, CAST(sum(n) AS BIGINT) AS cells FROM cells WHERE n > 0 GROUP BY method"""))
def q_imputed_by_method(spark, sf):
    return cleaning.imputed_by_method(_clean(spark, sf))


# --------------------------------------------------------------------------- F
_CORR_L = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, abs(CASE WHEN isnan(corr({c}, l_extendedprice)) THEN NULL "
    f"ELSE corr({c}, l_extendedprice) END) AS r FROM lineitem"
    for c in LINEITEM_NUMERIC if c != "l_extendedprice")


@register("target_correlation", f"SELECT column_name, round(r, 6) AS abs_corr FROM ({_CORR_L})")
def q_target_correlation(spark, sf):
    return rounded(S.target_correlation(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("low_correlation", f"SELECT column_name, round(r, 6) AS abs_corr FROM ({_CORR_L}) WHERE r < 0.05")
def q_low_correlation(spark, sf):
    tc = S.target_correlation(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(S.low_correlation(tc))


@register("select_features", f"""
SELECT column_name FROM (
  SELECT column_name, ordinal FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(LINEITEM_NUMERIC + ['l_returnflag', 'l_linestatus', 'l_shipdate']))}) t(column_name, ordinal))
WHERE column_name NOT IN (SELECT column_name FROM ({_CORR_L}) WHERE r < 0.05)""")
def q_select_features(spark, sf):
    li = table(spark, sf, "lineitem")
    out, _ = S.select_features(li, "l_extendedprice")
    return spark.createDataFrame([(c,) for c in out.columns], "column_name string")
