"""Driver keys for model preparation (M1-M8) and metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dsengine.operators import metrics as MT
from dsengine.operators import prepare as P
from dsengine.operators.onehot import VECTOR, fit_sparse
from dsengine.plans.fixtures import dirty, table, with_dirty
from dsengine.plans.queries import register, rounded

_TASK_TARGETS = [("orders", "o_orderstatus", False), ("lineitem", "l_linenumber", True),
                 ("lineitem", "l_extendedprice", True), ("part", "p_size", True),
                 ("orders", "o_totalprice", True)]


def _task_sql(tbl, c, numeric):
    if not numeric:
        return (f"SELECT '{tbl}' AS table_name, '{c}' AS target, 'classification' AS task_type, "
                f"count(DISTINCT {c}) AS n_distinct, CAST(NULL AS DOUBLE) AS integer_share, "
                f"round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio FROM {tbl}")
    ints = "avg(CASE WHEN abs(x - round_even(x, 0)) <= 1e-8 + 1e-5 * abs(round_even(x, 0)) THEN 1.0 ELSE 0.0 END)"
    d, ratio = "count(DISTINCT x)", "count(DISTINCT x) / count(x)"
    return (f"SELECT '{tbl}' AS table_name, '{c}' AS target, CASE "
            f"WHEN {d} <= 20 AND ({ints} >= 0.98 OR {ratio} <= 0.05) THEN 'classification' "
            f"WHEN {d} <= 50 AND {ratio} <= 0.02 THEN 'classification' ELSE 'regression' END AS task_type, "
            f"{d} AS n_distinct, round({ints}, 6) AS integer_share, round({ratio}, 6) AS unique_ratio "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl})")


@register("detect_task", " UNION ALL ".join(_task_sql(*t) for t in _TASK_TARGETS))
def q_detect_task(spark, sf):
    rows = []
    for tbl, c, _ in _TASK_TARGETS:
        r = P.detect_task(table(spark, sf, tbl), c)
        rows.append((tbl, c, r["task_type"], r["n_distinct"], r["integer_share"], r["unique_ratio"]))
    return rounded(spark.createDataFrame(
        rows, "table_name string, target string, task_type string, n_distinct bigint, "
              "integer_share double, unique_ratio double"))


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot", "SELECT o_orderkey, " + ", ".join(
    [f"CAST(CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"o_orderstatus_{v}\"" for v in ["O", "P"]]
    + [f"CAST(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"o_orderpriority_{v}\"" for v in _PRIO[1:]])
    + " FROM orders")
def q_one_hot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    model = P.fit_one_hot(o.select("o_orderstatus", "o_orderpriority"))
    return model.transform(o)


_SPARSE = ["p_name", "p_brand", "p_type"]


@register("one_hot_sparse", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS c, {c} AS v FROM part WHERE {c} IS NOT NULL" for i, c in enumerate(_SPARSE))
    + """), ranked AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - c - 2 AS slot, row_number() OVER (PARTITION BY c ORDER BY v) AS place FROM v),
slots AS (SELECT c, v, slot FROM ranked WHERE place > 1),
got AS (SELECT p_partkey, slot FROM part JOIN slots ON c = 0 AND v = p_name UNION ALL
        SELECT p_partkey, slot FROM part JOIN slots ON c = 1 AND v = p_brand UNION ALL
        SELECT p_partkey, slot FROM part JOIN slots ON c = 2 AND v = p_type)
SELECT p_partkey, coalesce((SELECT string_agg(CAST(slot AS STRING), ',' ORDER BY slot) FROM got WHERE got.p_partkey = part.p_partkey), '') AS slots FROM part""")
def q_one_hot_sparse(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", *_SPARSE)
    out = fit_sparse(p, _SPARSE).transform(p)
    at = F.transform(vector_to_array(VECTOR), lambda x, i: F.when(x == 1, i))
    return out.select("p_partkey", F.array_join(F.filter(at, lambda i: i.isNotNull()), ",").alias("slots"))


_VALID_COLS = ["k", "order_id", "customer_age", "gender", "total_price", "shipping_cost",
               "discount_rate", "priority", "is_large", "legacy_code", "item_count", "status"]


@register("valid_rows", with_dirty("""
SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE total_price IS NOT NULL AND k IS NOT NULL AND order_id IS NOT NULL AND customer_age IS NOT NULL
    AND shipping_cost IS NOT NULL AND discount_rate IS NOT NULL AND legacy_code IS NOT NULL AND item_count IS NOT NULL) AS valid_rows,
  CAST(7 + count(DISTINCT gender) - 1 + count(DISTINCT priority) - 1 + count(DISTINCT is_large) - 1
       + count(DISTINCT status) - 1 AS BIGINT) AS n_features
FROM dirty"""))
def q_valid_rows(spark, sf):
    d = dirty(spark, sf).select(*_VALID_COLS)
    out, names, _ = P.assemble_numeric(d, "total_price")
    return spark.createDataFrame([(d.count(), out.count(), len(names))],
                                 "total_rows bigint, valid_rows bigint, n_features bigint")


@register("normalize_labels", """
SELECT CAST(round_even(CAST(l_linenumber AS DOUBLE), 0) AS BIGINT) AS label, count(*) AS count
FROM lineitem GROUP BY 1""")
def q_normalize_labels(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber")
    out, kind = P.normalize_labels(li, "l_linenumber")
    return out.groupBy(F.col("l_linenumber").alias("label")).agg(F.count(F.lit(1)).alias("count"))


_H = ("('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS STRING), "
      "CAST(l_linenumber AS STRING))), 1, 15))::BIGINT")
_LIMIT = int(0.2 * (1 << 60))


@register("stratified_split", f"""
WITH t AS (SELECT l_returnflag AS y, {_H} AS h,
             concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS k FROM lineitem),
r AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY h, k) AS rn,
             floor(count(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS quota FROM t)
SELECT rn <= quota AS is_test, y AS label, count(*) AS count FROM r GROUP BY 1, 2""")
def q_stratified_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = P.stratified_split(li, "l_returnflag", ["l_orderkey", "l_linenumber"])
    return out.groupBy("is_test", F.col("l_returnflag").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))


@register("random_split", f"""
SELECT {_H} < {_LIMIT} AS is_test, count(*) AS count FROM lineitem GROUP BY 1""")
def q_random_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    out = P.random_split(li, ["l_orderkey", "l_linenumber"])
    return out.groupBy("is_test").agg(F.count(F.lit(1)).alias("count"))


_SCALE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("scale_train_test", f"""
WITH t AS (SELECT *, {_H} < {_LIMIT} AS is_test FROM lineitem),
s AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in _SCALE_COLS)} FROM t WHERE NOT is_test)
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, round(s.{c}_m, 6) AS train_mean, round(s.{c}_s, 6) AS train_std, round(avg(({c} - s.{c}_m) / s.{c}_s), 6) AS test_scaled_mean FROM t, s WHERE is_test GROUP BY s.{c}_m, s.{c}_s" for c in _SCALE_COLS)}""")
def q_scale_train_test(spark, sf):
    li = P.random_split(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    stats = P.fit_scaler(li.where(~F.col("is_test")), _SCALE_COLS)
    test = P.apply_scaler(li.where(F.col("is_test")).select(*_SCALE_COLS), stats)
    r = test.agg(*[F.avg(c).alias(c) for c in _SCALE_COLS]).first()
    rows = [(c, stats[c][0], stats[c][1], r[c]) for c in _SCALE_COLS]
    return rounded(spark.createDataFrame(
        rows, "column_name string, train_mean double, train_std double, test_scaled_mean double"))


@register("prep_stats", f"""
WITH t AS (SELECT *, {_H} < {_LIMIT} AS is_test FROM lineitem)
SELECT count(*) AS total_samples, count(*) FILTER (WHERE NOT is_test) AS train_samples,
  count(*) FILTER (WHERE is_test) AS test_samples, CAST(7 AS BIGINT) AS n_features, 'regression' AS task_type,
  round(min(l_extendedprice), 6) AS target_min, round(max(l_extendedprice), 6) AS target_max,
  round(avg(l_extendedprice), 6) AS target_mean, round(stddev_samp(l_extendedprice), 4) AS target_std,
  count(DISTINCT l_extendedprice) AS target_unique FROM t""")
def q_prep_stats(spark, sf):
    li = table(spark, sf, "lineitem")
    feats = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    sp = P.random_split(li.select(*feats, "l_extendedprice"), ["l_orderkey", "l_linenumber"])
    return rounded(P.prep_stats(sp, "l_extendedprice", feats, "regression"), {"target_std": 4})


# --------------------------------------------------------------------------- metrics
_PRED = "CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END"


def _clf_sql(pred_expr: str, group_sql: str = "", group_cols: str = "") -> str:
    g = f"{group_cols}, " if group_cols else ""
    return f"""
WITH cm AS (SELECT {g}l_linestatus AS y, {pred_expr} AS p, count(*) AS n FROM lineitem {group_sql} GROUP BY ALL),
sup AS (SELECT {g}y AS c, sum(n) AS support FROM cm GROUP BY ALL),
prd AS (SELECT {g}p AS c, sum(n) AS pred FROM cm GROUP BY ALL),
tp AS (SELECT {g}y AS c, n AS tp FROM cm WHERE y = p),
per AS (SELECT sup.*, coalesce(prd.pred, 0) AS pred, coalesce(tp.tp, 0) AS tp FROM sup
        LEFT JOIN prd USING ({g}c) LEFT JOIN tp USING ({g}c)),
pr AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
SELECT {g}round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1_score
FROM f {"GROUP BY ALL" if g else ""}"""


@register("classification_metrics", _clf_sql(_PRED))
def q_classification_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(F.col("l_linestatus").alias("label"),
                   F.when(F.col("l_quantity") > 25, "O").otherwise("F").alias("prediction"))
    return rounded(MT.classification_metrics(df))


@register("roc_auc", """
WITH s AS (SELECT l_quantity / 50.0 AS s, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS neg FROM lineitem GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
def q_roc_auc(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select((F.col("l_linestatus") == "O").cast("int").alias("label"),
                   (F.col("l_quantity") / 50.0).alias("score"))
    return rounded(MT.roc_auc(df))


@register("regression_metrics", """
SELECT round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2_score,
  round(avg(abs(y - p)), 4) AS mae, round(sqrt(sum(pow(y - p, 2)) / count(*)), 4) AS rmse,
  round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape
FROM (SELECT l_extendedprice AS y, l_quantity * 1000.0 + 1000.0 AS p FROM lineitem)""")
def q_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    df = li.select(F.col("l_extendedprice").alias("label"),
                   (F.col("l_quantity") * 1000.0 + 1000.0).alias("prediction"))
    return rounded(MT.regression_metrics(df), {"mae": 4, "rmse": 4})


_THRESHOLDS = [10, 20, 25, 30, 40]
_MODELS_SQL = " UNION ALL ".join(
    f"SELECT 'rule_{t}' AS model, {i} AS ordinal, l_linestatus, CASE WHEN l_quantity > {t} THEN 'O' ELSE 'F' END AS p FROM lineitem"
    for i, t in enumerate(_THRESHOLDS))


def _rule_models(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_linestatus")
    frames = [li.select(F.lit(f"rule_{t}").alias("model"), F.lit(i).alias("ordinal"),
                        F.col("l_linestatus").alias("label"),
                        F.when(F.col("l_quantity") > t, "O").otherwise("F").alias("prediction"))
              for i, t in enumerate(_THRESHOLDS)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return MT.classification_metrics(out, group=["model", "ordinal"])


_LB_SQL = _clf_sql("p", "", "model, ordinal").replace(
    "FROM lineitem  GROUP BY ALL", f"FROM ({_MODELS_SQL}) m GROUP BY ALL")


@register("leaderboard", f"""
SELECT model, ordinal, accuracy, precision, recall, f1_score,
  CAST(row_number() OVER (ORDER BY coalesce(f1_raw, 0.0) DESC, ordinal) AS INTEGER) AS rank
FROM (SELECT *, f1_score AS f1_raw FROM ({_LB_SQL}))""")
def q_leaderboard(spark, sf):
    return rounded(MT.leaderboard(_rule_models(spark, sf), "classification"))


@register("best_model", f"""
SELECT model, ordinal, accuracy, precision, recall, f1_score, 1 AS rank FROM ({_LB_SQL})
ORDER BY f1_score DESC, ordinal LIMIT 1""")
def q_best_model(spark, sf):
    return rounded(MT.best_model(_rule_models(spark, sf), "classification"))
