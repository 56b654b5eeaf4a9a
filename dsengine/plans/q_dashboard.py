"""Driver keys for the dashboard data."""

from __future__ import annotations

from dsengine.operators import dashboard as D
from dsengine.plans.fixtures import DIRTY_COLUMNS, dirty, table, with_dirty
from dsengine.plans.oracles import per_column
from dsengine.plans.queries import LINEITEM_NUMERIC, register, rounded

_MISS_CELLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in DIRTY_COLUMNS)
_SUMMARY = f"""SELECT count(*) AS rows, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS columns,
  CAST({_MISS_CELLS} AS BIGINT) AS missing_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates FROM dirty"""


@register("dataset_summary", with_dirty(_SUMMARY))
def q_dataset_summary(spark, sf):
    return D.dataset_summary(dirty(spark, sf))


@register("quality_overview", with_dirty(f"""
SELECT round(missing_values / greatest(rows * columns, 1) * 100, 2) AS missing_pct,
  round(duplicates / greatest(rows, 1) * 100, 2) AS duplicate_pct FROM ({_SUMMARY})"""))
def q_quality_overview(spark, sf):
    return D.quality_overview(dirty(spark, sf))


@register("completeness", with_dirty(f"""
SELECT greatest(rows * columns - missing_values, 0) AS present, missing_values AS missing FROM ({_SUMMARY})"""))
def q_completeness(spark, sf):
    return D.completeness(dirty(spark, sf))


@register("distribution_series", """
SELECT 'l_orderkey' AS column_name, b AS bin, round(lo + b * (hi - lo) / 30, 6) AS bin_lo,
  CAST(NULL AS STRING) AS label, count(*) AS count
FROM (SELECT CAST(least(floor((x - r.lo) / (r.hi - r.lo) * 30), 29) AS INTEGER) AS b, r.lo, r.hi
      FROM (SELECT CAST(l_orderkey AS DOUBLE) AS x FROM lineitem) t,
           (SELECT min(CAST(l_orderkey AS DOUBLE)) AS lo, max(CAST(l_orderkey AS DOUBLE)) AS hi FROM lineitem) r)
GROUP BY b, lo, hi""")
def q_distribution_series(spark, sf):
    return rounded(D.distribution_series(table(spark, sf, "lineitem")))


_PART_TEXT = ["p_name", "p_brand", "p_type"]
_KW = ["country", "state", "city", "region", "category", "segment", "department", "group", "type"]


@register("category_share_column", f"""
SELECT column_name FROM ({per_column(_PART_TEXT, '''
  SELECT {name} AS column_name, {i} AS ordinal,
    count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_all FROM part''')})
WHERE n_all BETWEEN 2 AND 20
ORDER BY CASE WHEN {' OR '.join(f"lower(column_name) LIKE '%{k}%'" for k in _KW)} THEN 0 ELSE 1 END, ordinal
LIMIT 1""")
def q_category_share_column(spark, sf):
    c = D.category_share_column(table(spark, sf, "part"))
    return spark.createDataFrame([(c,)], "column_name string")


@register("category_share", """
SELECT 'pie' AS chart, label, CAST(count AS DOUBLE) AS value FROM (
  SELECT coalesce(CAST(p_type AS STRING), 'nan') AS label, count(*) AS count FROM part GROUP BY 1
  ORDER BY count DESC, label LIMIT 8)""")
def q_category_share(spark, sf):
    return D.category_share(table(spark, sf, "part"))


@register("correlation_top8", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(CASE WHEN isnan(corr({a}, {b})) THEN NULL "
    f"ELSE corr({a}, {b}) END, 0.0), 6) AS corr FROM lineitem"
    for a in LINEITEM_NUMERIC for b in LINEITEM_NUMERIC))
def q_correlation_top8(spark, sf):
    return rounded(D.correlation_top8(table(spark, sf, "lineitem")))


@register("variance_proxy", f"""
SELECT column_name, round(variance, 2) AS variance FROM ({per_column(LINEITEM_NUMERIC,
  "SELECT {name} AS column_name, var_samp(CAST({c} AS DOUBLE)) AS variance FROM lineitem")})
ORDER BY variance DESC, column_name LIMIT 10""")
def q_variance_proxy(spark, sf):
    return rounded(D.variance_proxy(table(spark, sf, "lineitem")), {"variance": 2})


@register("cardinality_proxy", with_dirty(f"""
SELECT column_name, distinct_values FROM ({per_column(DIRTY_COLUMNS, '''
  SELECT {name} AS column_name,
    count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS distinct_values FROM dirty''')})
ORDER BY distinct_values DESC, column_name LIMIT 10"""))
def q_cardinality_proxy(spark, sf):
    return D.cardinality_proxy(dirty(spark, sf))


@register("relation_sample", """
SELECT CAST(l_orderkey AS DOUBLE) AS x, round(CAST(l_extendedprice AS DOUBLE), 6) AS y FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))) LIMIT 800""")
def q_relation_sample(spark, sf):
    return rounded(D.relation_sample(table(spark, sf, "lineitem"), "l_extendedprice",
                                     ["l_orderkey", "l_linenumber"]))


@register("relation_fallback", """
SELECT index, value FROM (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS INTEGER) AS index,
    CAST(l_orderkey AS DOUBLE) AS value FROM lineitem WHERE l_orderkey IS NOT NULL)
WHERE index < 800""")
def q_relation_fallback(spark, sf):
    return D.relation_fallback(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("numeric_summary_card", with_dirty("""
SELECT 'k' AS column_name, CAST(9 AS BIGINT) AS numeric_columns, count(k) AS count,
  round(avg(k), 6) AS mean, round(quantile_cont(CAST(k AS DOUBLE), 0.5), 6) AS median,
  round(stddev_samp(k), 6) AS std, round(CAST(min(k) AS DOUBLE), 6) AS min, round(CAST(max(k) AS DOUBLE), 6) AS max,
  round(quantile_cont(CAST(k AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(k AS DOUBLE), 0.75), 6) AS q3
FROM dirty"""))
def q_numeric_summary_card(spark, sf):
    return D.numeric_summary_card(dirty(spark, sf))
