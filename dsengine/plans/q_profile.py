"""Driver keys for profiling (P1-P10) and the statistical summary."""

from __future__ import annotations

from dsengine.operators import eda, profile
from dsengine.plans.fixtures import DIRTY_COLUMNS, dirty, table, with_dirty
from dsengine.plans.oracles import per_column
from dsengine.plans.queries import LINEITEM_COLUMNS, LINEITEM_NUMERIC, register, rounded

ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority"]
DIGITS_SUMMARY = {"std_dev": 4, "variance": 2}


def _summary_sql(tbl: str, cols: list[str], mean_digits: int = 6) -> str:
    return per_column(cols, f"""
SELECT {{name}} AS column_name, {{i}} AS ordinal,
  round(avg(x), {mean_digits}) AS mean, round(quantile_cont(x, 0.5), 6) AS median,
  round(stddev_samp(x), 4) AS std_dev, round(var_samp(x), 2) AS variance,
  round(min(x), 6) AS min, round(max(x), 6) AS max,
  round(CASE WHEN var_pop(x) > 0 THEN skewness(x) END, 6) AS skewness,
  round(CASE WHEN var_pop(x) > 0 THEN kurtosis(x) END, 6) AS kurtosis,
  count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS outlier_count,
  round(100.0 * count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) / count(*), 6) AS outlier_percentage,
  count(DISTINCT x) AS n_distinct,
  round(count(DISTINCT x) / count(*), 6) AS unique_ratio,
  count(DISTINCT x) / count(*) < 0.01 AS is_constant
FROM (SELECT CAST({{c}} AS DOUBLE) AS x FROM {tbl}) t,
     (SELECT quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {tbl}) q
GROUP BY q.q1, q.q3""")


# lineitem means are exact ties at the 6th decimal for l_discount / l_tax at
# sf0.01 (k / 6,000,000), so the comparison rounds means to 5 decimals
@register("statistical_summary", _summary_sql("lineitem", LINEITEM_NUMERIC, mean_digits=5))
def q_statistical_summary(spark, sf):
    return rounded(eda.statistical_summary(table(spark, sf, "lineitem")),
                   {**DIGITS_SUMMARY, "mean": 5})


@register("statistical_summary_dirty", with_dirty(_summary_sql(
    "dirty", ["k", "order_id", "customer_age", "total_price", "shipping_cost",
              "discount_rate", "legacy_code", "source_flag", "item_count"])))
def q_statistical_summary_dirty(spark, sf):
    return rounded(eda.statistical_summary(dirty(spark, sf)), DIGITS_SUMMARY)


@register("profile_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def q_profile_shape(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


@register("profile_columns", per_column(LINEITEM_COLUMNS, """
SELECT {name} AS column_name, {i} AS ordinal,
  CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'DOUBLE') THEN 'numeric'
       WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS role,
  count({c}) AS present FROM lineitem"""))
def q_profile_columns(spark, sf):
    return profile.column_roles(table(spark, sf, "lineitem"))


@register("column_cardinality", with_dirty(per_column(DIRTY_COLUMNS, """
SELECT {name} AS column_name, {i} AS ordinal, count(DISTINCT {c}) AS n_distinct,
  count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct_with_null
FROM dirty""")))
def q_column_cardinality(spark, sf):
    return profile.column_cardinality(dirty(spark, sf))


def _infer_sql(tbl: str, cols: list[str], target: str | None) -> str:
    card = per_column(cols, f"SELECT {{name}} AS column_name, {{i}} AS ordinal, "
                            f"count(DISTINCT {{c}}) AS n FROM {tbl}")
    chosen = f"'{target}'" if target else "inferred_target"
    conf = "true" if target else "false"
    return f"""
WITH card AS ({card}),
inf AS (SELECT arg_min(column_name, ordinal) AS inferred_target FROM card WHERE n <= 10),
ch AS (SELECT inferred_target, {chosen} AS target_column, {conf} AS target_confirmed FROM inf)
SELECT ch.inferred_target, ch.target_column, ch.target_confirmed,
  CASE WHEN ch.target_column IS NULL THEN 'Unknown'
       WHEN card.n = 2 THEN 'Binary Classification'
       WHEN card.n > 2 THEN 'Multi-class Classification'
       ELSE 'Regression' END AS problem_type
FROM ch LEFT JOIN card ON card.column_name = ch.target_column"""


@register("infer_target", _infer_sql("lineitem", LINEITEM_COLUMNS, None))
def q_infer_target(spark, sf):
    return profile.infer_target(table(spark, sf, "lineitem"))


@register("problem_type", with_dirty(_infer_sql("dirty", DIRTY_COLUMNS, "is_large")))
def q_problem_type(spark, sf):
    return profile.infer_target(dirty(spark, sf), target="is_large")


@register("missing_counts", with_dirty(per_column(DIRTY_COLUMNS, """
SELECT {name} AS column_name, {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL) AS missing
FROM dirty""")))
def q_missing_counts(spark, sf):
    return profile.missing_counts(dirty(spark, sf))


@register("duplicate_count", with_dirty("""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS duplicates
FROM dirty"""))
def q_duplicate_count(spark, sf):
    return profile.duplicate_count(dirty(spark, sf))


_BOOL_TEXT = "('True','False','true','false','yes','no','Yes','No','YES','NO')"
_DATE_RX = r"(regexp_matches(trim({c}), '^\d{{4}}-\d{{2}}-\d{{2}}') OR regexp_matches(trim({c}), '^\d{{2}}/\d{{2}}/\d{{4}}') OR regexp_matches(trim({c}), '^\d{{1,2}}-\d{{1,2}}-\d{{4}}'))"


def _semantic_sql(tbl: str, cols: list[str], kinds: dict[str, str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        qc = '"' + c + '"'
        kind = kinds[c]
        if kind == "numeric":
            in_bool = f"CAST({qc} AS DOUBLE) IN (0.0, 1.0)"
            rest = "'numeric'"
        else:
            in_bool = f"{qc} IN {_BOOL_TEXT}"
            date = _DATE_RX.replace("{c}", qc).replace("{{", "{").replace("}}", "}")
            rest = (f"CASE WHEN count(*) FILTER (WHERE {date}) / count({qc}) > 0.8 THEN 'datetime' "
                    f"WHEN count(*) FILTER (WHERE TRY_CAST({qc} AS DOUBLE) IS NOT NULL) = count({qc}) "
                    f"THEN 'numeric' ELSE 'categorical' END")
        parts.append(f"""SELECT '{c}' AS column_name, {i} AS ordinal,
  CASE WHEN count({qc}) = 0 THEN 'unknown'
       WHEN count(*) FILTER (WHERE {in_bool}) = count({qc}) AND count(DISTINCT {qc}) <= 2 THEN 'boolean'
       ELSE {rest} END AS semantic_type FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


_DIRTY_KINDS = {c: ("numeric" if c in ("k", "order_id", "customer_age", "total_price",
                                       "shipping_cost", "discount_rate", "legacy_code",
                                       "source_flag", "item_count") else "text")
                for c in DIRTY_COLUMNS}


@register("semantic_types", with_dirty(_semantic_sql("dirty", DIRTY_COLUMNS, _DIRTY_KINDS)))
def q_semantic_types(spark, sf):
    return profile.semantic_types(dirty(spark, sf))


@register("target_suitability", with_dirty(per_column(DIRTY_COLUMNS, """
SELECT {name} AS column_name, {i} AS ordinal, count(DISTINCT {c}) AS n_distinct,
  CASE WHEN count(DISTINCT {c}) = 1 THEN 'invalid'
       WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND (TRY_CAST(CAST({c} AS STRING) AS DOUBLE) IS NULL OR trim(CAST({c} AS STRING)) = '')) = 0
         THEN CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END
       WHEN count(DISTINCT {c}) BETWEEN 2 AND 10 THEN 'classification'
       ELSE 'too_many_categories' END AS suitability
FROM dirty""")))
def q_target_suitability(spark, sf):
    return profile.target_suitability(dirty(spark, sf))


def _input_sql(cols_kinds):
    parts = []
    for i, (c, kind) in enumerate(cols_kinds):
        if kind == "numeric":
            parts.append(f"""SELECT '{c}' AS column_name, {i} AS ordinal,
  CASE WHEN count({c}) = 0 THEN 'text' ELSE 'number' END AS input_type FROM dirty""")
            continue
        s = f"trim(CAST({c} AS STRING))"
        present = f"({s} IS NOT NULL AND {s} <> '')"
        num = f"TRY_CAST({s} AS DOUBLE) IS NOT NULL"
        parsed = (f"coalesce(TRY_CAST({s} AS TIMESTAMP), try_strptime({s}, '%m/%d/%Y'), "
                  f"try_strptime({s}, '%Y/%m/%d')) IS NOT NULL")
        date = f"{present} AND NOT ({num} AND length({s}) < 6) AND {parsed}"
        has_time = f"{date} AND regexp_matches({s}, '\\d{{1,2}}:\\d{{2}}|T\\d{{1,2}}:\\d{{2}}')"
        named = "true" if any(w in c.lower() for w in ["date", "dob", "timestamp", "created", "updated", "time"]) else "false"
        n = f"count(*) FILTER (WHERE {present})"
        d = f"count(*) FILTER (WHERE {date})"
        parts.append(f"""SELECT '{c}' AS column_name, {i} AS ordinal,
  CASE WHEN {n} = 0 THEN 'text'
       WHEN ({d} / {n} >= 0.7 OR ({named} AND {d} / {n} >= 0.3)) AND count(*) FILTER (WHERE {has_time}) > 0 THEN 'datetime-local'
       WHEN {d} / {n} >= 0.7 OR ({named} AND {d} / {n} >= 0.3) THEN 'date'
       WHEN count(*) FILTER (WHERE {present} AND {num}) / {n} >= 0.9 THEN 'number'
       ELSE 'text' END AS input_type FROM dirty""")
    return with_dirty("\nUNION ALL\n".join(parts))


@register("input_types", _input_sql([(c, _DIRTY_KINDS[c]) for c in DIRTY_COLUMNS]))
def q_input_types(spark, sf):
    return profile.input_types(dirty(spark, sf))
