"""Driver keys for categorical handling (K1-K6) and single cleaning steps
(C1-C27) on the ``dirty`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col
from dsengine.operators import categorical as K
from dsengine.operators import clean as C
from dsengine.operators.profile import value_counts
from dsengine.plans.fixtures import (DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, dirty, table,
                                     with_dirty)
from dsengine.plans.oracles import per_column
from dsengine.plans.queries import register, rounded

DIRTY_DOUBLES = ["total_price", "shipping_cost", "discount_rate"]
DIRTY_CATEGORICAL = ["customer_name", "gender", "priority", "status"]


def _dirty_select(exclude=(), src="dirty") -> str:
    """SELECT list of the dirty columns with doubles rounded to 6 places."""
    parts = []
    for c in DIRTY_COLUMNS:
        if c in exclude:
            continue
        parts.append(f"round({c}, 6) AS {c}" if c in DIRTY_DOUBLES else c)
    return ", ".join(parts)


# --------------------------------------------------------------------------- K
_PAIRS_VALUES = ", ".join(f"('{k}', '{p}', '{n}')" for k, (p, n) in rules.BINARY_PAIRS.items())

_CLASSIFY_SQL = with_dirty(f"""
WITH pairs AS (SELECT * FROM (VALUES {_PAIRS_VALUES}) t(k, pos, neg)),
v AS ({per_column(DIRTY_TEXT, '''
  SELECT {name} AS column_name, {i} AS ordinal, count(DISTINCT {c}) AS n_distinct,
    CASE WHEN count(DISTINCT {c}) <= 10 THEN list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)) END AS vals
  FROM dirty''')}),
m AS (
  SELECT v.*, CASE WHEN p1.k IS NOT NULL THEN p1.pos ELSE p2.pos END AS pos,
    list_position(list_transform(vals, lambda x: lower(trim(x))),
                  CASE WHEN p1.k IS NOT NULL THEN p1.pos ELSE p2.pos END) AS pidx
  FROM v LEFT JOIN pairs p1 ON p1.k = lower(trim(vals[1]))
         LEFT JOIN pairs p2 ON p2.k = lower(trim(vals[2])))
SELECT column_name, ordinal, n_distinct,
  CASE WHEN n_distinct = 2 AND pos IS NOT NULL THEN 'binary'
       WHEN n_distinct = 2 THEN 'clustered'
       WHEN n_distinct BETWEEN 3 AND 10 THEN 'clustered'
       WHEN n_distinct > 5 THEN 'fully' ELSE 'none' END AS category_class,
  CASE WHEN n_distinct = 2 AND pos IS NOT NULL THEN
    CASE WHEN pidx > 0 THEN vals[pidx] ELSE vals[1] END END AS positive,
  CASE WHEN n_distinct = 2 AND pos IS NOT NULL THEN
    CASE WHEN pidx > 0 THEN vals[3 - pidx] ELSE vals[2] END END AS negative,
  array_to_string(vals, '|') AS "values"
FROM m""")


@register("classify_categoricals", _CLASSIFY_SQL)
def q_classify(spark, sf):
    return K.classify_categoricals(dirty(spark, sf))


@register("binary_pairs", _CLASSIFY_SQL.replace(
    "SELECT column_name, ordinal, n_distinct,\n  CASE WHEN n_distinct = 2 AND pos IS NOT NULL THEN 'binary'",
    "SELECT * FROM (SELECT column_name, ordinal, n_distinct,\n  CASE WHEN n_distinct = 2 AND pos IS NOT NULL THEN 'binary'")
    .rstrip() + ") WHERE category_class = 'binary'")
def q_binary_pairs(spark, sf):
    return K.classify_categoricals(dirty(spark, sf)).where(F.col("category_class") == "binary")


@register("binary_encode", with_dirty("""
SELECT k, CASE lower(trim(coalesce(is_large, ''))) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS is_large
FROM dirty"""))
def q_binary_encode(spark, sf):
    d = dirty(spark, sf)
    pairs = K.binary_pairs(K.classify_categoricals(d.select("is_large")))
    return K.binary_encode(d.select("k", "is_large"), pairs)


@register("binary_decode", """
SELECT o_orderkey, CASE WHEN o_totalprice / 500000.0 >= 0.5 THEN 'Yes' ELSE 'No' END AS decoded
FROM orders""")
def q_binary_decode(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", K.binary_decode(F.col("o_totalprice") / 500000.0, "Yes", "No")
                    .alias("decoded"))


@register("categorical_info", f"""
SELECT column_name, category_class, CASE WHEN category_class = 'clustered' THEN "values" END AS "values",
  CASE WHEN category_class = 'binary' THEN '1=' || positive || ',0=' || negative END AS encoding
FROM ({_CLASSIFY_SQL}) c WHERE category_class IN ('binary', 'clustered', 'fully')""")
def q_categorical_info(spark, sf):
    return K.categorical_info(K.classify_categoricals(dirty(spark, sf)))


_DATE_LIKE = ("(regexp_matches(trim({c}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR "
              "regexp_matches(trim({c}), '^\\d{{2}}/\\d{{2}}/\\d{{4}}') OR "
              "regexp_matches(trim({c}), '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}'))")


@register("drop_fully_categorical", with_dirty(per_column(DIRTY_TEXT, f"""
SELECT {{name}} AS column_name FROM dirty
HAVING count(DISTINCT {{c}}) > 10
   AND NOT (count(*) FILTER (WHERE {_DATE_LIKE}) / count({{c}}) > 0.8)
   AND count(*) FILTER (WHERE TRY_CAST({{c}} AS DOUBLE) IS NOT NULL) < count({{c}})""")))
def q_drop_fully(spark, sf):
    from dsengine.operators.profile import semantic_type_map
    d = dirty(spark, sf)
    _, dropped = K.drop_fully_categorical(d, semantic=semantic_type_map(d))
    return spark.createDataFrame([(c,) for c in dropped], "column_name string")


# --------------------------------------------------------------------------- C1-C7
@register("dedup_exact", with_dirty(f"SELECT DISTINCT {_dirty_select()} FROM dirty"))
def q_dedup(spark, sf):
    return rounded(C.dedup_exact(dirty(spark, sf))[0])


@register("drop_null_identifiers", with_dirty(f"""
WITH s1 AS (SELECT * FROM dirty WHERE order_id IS NOT NULL
            OR (SELECT count(DISTINCT order_id) / count(*) FROM dirty) <= 0.8),
s2 AS (SELECT * FROM s1 WHERE legacy_code IS NOT NULL
            OR (SELECT count(DISTINCT legacy_code) / count(*) FROM s1) <= 0.8)
SELECT {_dirty_select()} FROM s2"""))
def q_drop_null_identifiers(spark, sf):
    return rounded(C.drop_null_identifiers(dirty(spark, sf))[0])


@register("high_missing_columns", with_dirty(per_column(DIRTY_COLUMNS, """
SELECT {name} AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing,
  round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS ratio
FROM dirty HAVING count(*) FILTER (WHERE {c} IS NULL) / count(*) >= 0.4""")))
def q_high_missing_columns(spark, sf):
    rows = C.high_missing_columns(dirty(spark, sf))
    return rounded(spark.createDataFrame(rows, "column_name string, missing bigint, ratio double"))


_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in DIRTY_COLUMNS)


@register("row_missing_ratio", with_dirty(f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE {_ANY_NULL}) AS rows_with_missing,
  round(count(*) FILTER (WHERE {_ANY_NULL}) / count(*), 6) AS ratio FROM dirty"""))
def q_row_missing_ratio(spark, sf):
    n, m, r = C.row_missing_ratio(dirty(spark, sf))
    return rounded(spark.createDataFrame([(n, m, r)], "rows bigint, rows_with_missing bigint, ratio double"))


@register("rows_first_rule", with_dirty(f"""
SELECT {_dirty_select()} FROM dirty WHERE NOT ({_ANY_NULL})"""))
def q_rows_first_rule(spark, sf):
    # thresholds set so the rule fires on this table (the defaults never can)
    out, _ = C.rows_first_rule(dirty(spark, sf), high_missing=0.4, rows_limit=1.0)
    return rounded(out)


@register("drop_high_missing", with_dirty(f"SELECT {_dirty_select(exclude=('legacy_code',))} FROM dirty"))
def q_drop_high_missing(spark, sf):
    return rounded(C.drop_high_missing(dirty(spark, sf))[0])


@register("drop_low_missing_rows", with_dirty(f"""
SELECT {_dirty_select()} FROM dirty
WHERE NOT ({_ANY_NULL}) OR (SELECT count(*) FILTER (WHERE {_ANY_NULL}) / count(*) FROM dirty) >= 0.05"""))
def q_drop_low_missing_rows(spark, sf):
    return rounded(C.drop_low_missing_rows(dirty(spark, sf))[0])


@register("drop_incomplete", with_dirty(f"SELECT {_dirty_select()} FROM dirty WHERE NOT ({_ANY_NULL})"))
def q_drop_incomplete(spark, sf):
    return rounded(C.drop_incomplete(dirty(spark, sf)))


# --------------------------------------------------------------------------- C8/C9
_Q = """(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
          quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, avg(CAST({c} AS DOUBLE)) AS mean,
          count({c}) AS n FROM dirty)"""


@register("high_variation", with_dirty(per_column(DIRTY_NUMERIC, f"""
SELECT {{name}} AS column_name, round(q.q1, 6) AS q1, round(q.q3, 6) AS q3,
  round(count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) / q.n, 6) AS outlier_share,
  (q.q3 - q.q1) <> 0 AND count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) / q.n > 0.1 AS high_variation
FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM dirty) t, {_Q} q GROUP BY q.q1, q.q3, q.n""")))
def q_high_variation(spark, sf):
    d = dirty(spark, sf)
    hv = C.high_variation(d, DIRTY_NUMERIC)
    rows = [(c, hv[c]["q1"], hv[c]["q3"], hv[c]["outlier_share"], hv[c]["high_variation"])
            for c in DIRTY_NUMERIC]
    return rounded(spark.createDataFrame(
        rows, "column_name string, q1 double, q3 double, outlier_share double, high_variation boolean"))


@register("impute_numeric", with_dirty(per_column(DIRTY_NUMERIC, f"""
SELECT {{name}} AS column_name,
  CASE WHEN count(*) FILTER (WHERE x IS NULL) = 0 THEN 'none'
       WHEN (q.q3 - q.q1) <> 0 AND count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) / q.n > 0.1
         THEN 'median (high variation detected)' ELSE 'mean' END AS method,
  round(CASE WHEN (q.q3 - q.q1) <> 0 AND count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) / q.n > 0.1
         THEN q.med ELSE q.mean END, 6) AS fill_value,
  count(*) FILTER (WHERE x IS NULL) AS missing
FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM dirty) t, {_Q} q GROUP BY q.q1, q.q3, q.n, q.med, q.mean""")))
def q_impute_numeric(spark, sf):
    fills = C.numeric_fill_values(dirty(spark, sf), DIRTY_NUMERIC)
    rows = [(c, m, v, int(n)) for c, (m, v, n) in fills.items()]
    return rounded(spark.createDataFrame(
        rows, "column_name string, method string, fill_value double, missing bigint"))


# --------------------------------------------------------------------------- C10-C12
@register("ffill_bfill", with_dirty("""
SELECT k, coalesce(last_value(end_date IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   (SELECT arg_min(end_date, k) FROM dirty WHERE end_date IS NOT NULL)) AS end_date
FROM dirty"""))
def q_ffill_bfill(spark, sf):
    d = dirty(spark, sf).select("k", "end_date")
    return C.ffill_bfill(d, ["end_date"], order_by="k")


def _mode_sql(cols):
    return with_dirty(per_column(cols, """
SELECT {name} AS column_name,
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1)
   ORDER BY n DESC, v ASC LIMIT 1) AS mode_value,
  count(*) FILTER (WHERE {c} IS NULL) AS missing FROM dirty"""))


@register("impute_mode", _mode_sql(DIRTY_CATEGORICAL))
def q_impute_mode(spark, sf):
    modes = C.mode_values(dirty(spark, sf), DIRTY_CATEGORICAL)
    return spark.createDataFrame([(c, m, n) for c, (m, n) in modes.items()],
                                 "column_name string, mode_value string, missing bigint")


@register("impute_boolean", _mode_sql(["is_large"]))
def q_impute_boolean(spark, sf):
    d = dirty(spark, sf)
    filled, info = C.impute_mode(d.select("is_large"), ["is_large"], boolean=True)
    m = info["is_large"]
    return spark.createDataFrame([("is_large", m[1], m[2])],
                                 "column_name string, mode_value string, missing bigint")


# --------------------------------------------------------------------------- C13-C17
@register("coerce_numeric", with_dirty(per_column(DIRTY_TEXT, """
SELECT {name} AS column_name, count(TRY_CAST({c} AS DOUBLE)) AS n_numeric,
  count({c}) - count(TRY_CAST({c} AS DOUBLE)) AS n_nulled FROM dirty""")))
def q_coerce_numeric(spark, sf):
    from dsengine.operators.profile import _stack_row
    d = dirty(spark, sf)
    one = d.agg(*[F.count(C.coerce_numeric(col(c))).alias(f"n_numeric__{i}")
                  for i, c in enumerate(DIRTY_TEXT)],
                *[(F.count(col(c)) - F.count(C.coerce_numeric(col(c)))).alias(f"n_nulled__{i}")
                  for i, c in enumerate(DIRTY_TEXT)])
    return _stack_row(one, DIRTY_TEXT, ["n_numeric", "n_nulled"]).drop("ordinal")


@register("coerce_datetime", with_dirty("""
SELECT k, CAST(TRY_CAST(start_date AS DATE) AS STRING) AS start_date,
  CAST(TRY_CAST(end_date AS DATE) AS STRING) AS end_date FROM dirty"""))
def q_coerce_datetime(spark, sf):
    d = dirty(spark, sf)
    return d.select("k", C.coerce_datetime(F.col("start_date")).cast("date").cast("string").alias("start_date"),
                    C.coerce_datetime(F.col("end_date")).cast("date").cast("string").alias("end_date"))


def _vc_sql(cols, expr):
    return with_dirty(per_column(cols, f"""
SELECT {{name}} AS column_name, {expr} AS value, count(*) AS count FROM dirty GROUP BY 2"""))


def _vc_frame(d, cols, fn):
    return value_counts(d.select(*[fn(col(c)).alias(c) for c in cols]), cols)


@register("standardize_text", _vc_sql(DIRTY_CATEGORICAL, "lower(trim({c}))"))
def q_standardize_text(spark, sf):
    return _vc_frame(dirty(spark, sf), DIRTY_CATEGORICAL, C.standardize_text)


@register("standardize_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def q_standardize_dates(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.standardize_date(F.col("o_orderdate")).alias("o_orderdate"))


_CANON_CASE = "CASE " + " ".join(
    f"WHEN {{c}} IN ({', '.join(repr(v) for v in vs)}) THEN '{k}'"
    for k, vs in rules.CANONICAL_VALUES.items()) + " ELSE {c} END"


@register("canonical_values", with_dirty(
    per_column(DIRTY_TEXT, f"""
SELECT {{name}} AS column_name, {_CANON_CASE} AS value, count(*) AS count
FROM dirty GROUP BY 2""")))
def q_canonical_values(spark, sf):
    return _vc_frame(dirty(spark, sf), DIRTY_TEXT, C.canonical_values)


# --------------------------------------------------------------------------- C18-C20
@register("winsorize_iqr", with_dirty(per_column(DIRTY_NUMERIC, f"""
SELECT {{name}} AS column_name,
  count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers,
  round(q.q1 - 1.5 * (q.q3 - q.q1), 6) AS lower, round(q.q3 + 1.5 * (q.q3 - q.q1), 6) AS upper,
  round(sum(CASE WHEN x IS NOT NULL THEN greatest(q.q1 - 1.5 * (q.q3 - q.q1), least(q.q3 + 1.5 * (q.q3 - q.q1), x)) END), 2) AS clipped_sum
FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM dirty) t, {_Q} q GROUP BY q.q1, q.q3, q.n
HAVING count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) > 0""")))
def q_winsorize(spark, sf):
    d = dirty(spark, sf)
    out, info = C.winsorize(d, DIRTY_NUMERIC)
    sums = out.agg(*[F.sum(col(c).cast("double")).alias(c) for c in info]).first() if info else {}
    rows = [(c, v["outliers"], v["lower"], v["upper"], sums[c]) for c, v in info.items()]
    return rounded(spark.createDataFrame(
        rows, "column_name string, outliers bigint, lower double, upper double, clipped_sum double"),
        {"clipped_sum": 2})


@register("domain_rules", with_dirty("""
SELECT 'customer_age' AS column_name, 'age' AS rule, count(*) FILTER (WHERE customer_age < 0 OR customer_age > 120) AS invalid_removed FROM dirty
UNION ALL
SELECT 'discount_rate', 'percent', count(*) FILTER (WHERE discount_rate < 0 OR discount_rate > 100) FROM dirty"""))
def q_domain_rules(spark, sf):
    _, info = C.domain_rules(dirty(spark, sf), DIRTY_NUMERIC)
    return spark.createDataFrame([(c, v["rule"], v["invalid_removed"]) for c, v in info.items()],
                                 "column_name string, rule string, invalid_removed bigint")


@register("group_rare", with_dirty(per_column(DIRTY_TEXT, """
SELECT {name} AS column_name,
  CASE WHEN {c} IN (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1
                    HAVING count(*) / (SELECT count({c}) FROM dirty) < 0.01) THEN 'Other' ELSE {c} END AS value,
  count(*) AS count FROM dirty GROUP BY 2""")))
def q_group_rare(spark, sf):
    out, _ = C.group_rare(dirty(spark, sf).select(*DIRTY_TEXT), DIRTY_TEXT)
    return value_counts(out, DIRTY_TEXT)


# --------------------------------------------------------------------------- C21-C25
@register("drop_constants", with_dirty(per_column(DIRTY_COLUMNS, """
SELECT {name} AS column_name FROM dirty HAVING count(DISTINCT {c}) <= 1""")))
def q_drop_constants(spark, sf):
    return spark.createDataFrame([(c,) for c in C.constant_columns_minmax(dirty(spark, sf))],
                                 "column_name string")


@register("drop_identifiers", with_dirty("""
WITH d AS (SELECT DISTINCT * FROM dirty WHERE order_id IS NOT NULL)
SELECT 'order_id' AS column_name FROM d HAVING count(DISTINCT order_id) / count(*) > 0.95"""))
def q_drop_identifiers(spark, sf):
    d = dirty(spark, sf).dropDuplicates().where(F.col("order_id").isNotNull())
    return spark.createDataFrame([(c,) for c in C.identifier_columns(d)], "column_name string")


@register("drop_low_impact", "SELECT * EXCLUDE (c_name) FROM customer")
def q_drop_low_impact(spark, sf):
    return C.drop_low_impact(table(spark, sf, "customer"))[0]


@register("check_date_order", with_dirty("""
SELECT 'start_date' AS first_column, 'end_date' AS second_column,
  count(*) FILTER (WHERE TRY_CAST(start_date AS DATE) > TRY_CAST(end_date AS DATE)) AS violations
FROM dirty"""))
def q_check_date_order(spark, sf):
    return spark.createDataFrame(C.check_date_order(dirty(spark, sf)),
                                 "first_column string, second_column string, violations bigint")


@register("check_non_negative", with_dirty("""
SELECT 'discount_rate' AS column_name, count(*) FILTER (WHERE discount_rate < 0) AS negatives FROM dirty
UNION ALL SELECT 'item_count', count(*) FILTER (WHERE item_count < 0) FROM dirty"""))
def q_check_non_negative(spark, sf):
    return spark.createDataFrame(C.check_non_negative(dirty(spark, sf)),
                                 "column_name string, negatives bigint")


# --------------------------------------------------------------------------- C26
_SCALED = ", ".join(f"round(coalesce(({c} - (SELECT avg({c}) FROM dirty)) / nullif((SELECT stddev_pop({c}) FROM dirty), 0), CASE WHEN {c} IS NOT NULL THEN 0.0 END), 6) AS {c}"
                    for c in DIRTY_NUMERIC)


@register("standard_scale", with_dirty(f"SELECT {_SCALED} FROM dirty"))
def q_standard_scale(spark, sf):
    return rounded(C.standard_scale(dirty(spark, sf).select(*DIRTY_NUMERIC), DIRTY_NUMERIC))
