"""Driver keys for the models (M9-M24, M30-M32), scoring (X1-X5) and the
persisted bundle (S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dsengine.operators import models as MD
from dsengine.plans import train as TR
from dsengine.plans.fixtures import table, with_dirty
from dsengine.plans.queries import register, rounded


def documents_labelled(spark, sf):
    """documents joined with their quality labels (classification fixture)."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


def parts(spark, sf):
    """part with its retail price as the regression target."""
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


def _prepared(spark, sf, kind):
    if kind == "clf":
        return TR.prepare(documents_labelled(spark, sf), "quality", ["doc_id"])
    return TR.prepare(parts(spark, sf), "p_retailprice", ["p_partkey"])


def _one_model(spark, sf, kind, name):
    train, test, features, classes, task, *_ = _prepared(spark, sf, kind)  # noqa: F841
    kw = {"id_col": TR.ROW_ID} if name.startswith("K-Nearest") else {}
    m = MD.fit(name, task, train, features, len(classes), **kw)
    out = m.transform(test)
    return out.select(F.col(TR.ROW_ID).alias("row_id"), F.col("label"),
                      F.col("prediction").cast("double").alias("prediction"))


def _reg(key, kind, name):
    @register(key)
    def q(spark, sf):
        return _one_model(spark, sf, kind, name)
    q.__name__ = f"q_{key}"
    return q


for _key, _name in zip(["clf_logistic", "clf_forest", "clf_gbt", "clf_svm", "clf_tree", "clf_knn_documents", "clf_mlp", "clf_adaboost"], MD.CLASSIFIERS):
    _reg(_key, "clf", _name)
for _key, _name in zip(["reg_linear_part", "reg_forest", "reg_gbt", "reg_svr", "reg_tree", "reg_knn_part", "reg_mlp", "reg_adaboost"], MD.REGRESSORS):
    _reg(_key, "reg", _name)


# --------------------------------------------------------------------------- exact kNN vs SQL
_EH = "('0x' || substr(md5(concat_ws('|', '42', CAST(vec_id AS STRING))), 1, 15))::BIGINT"
_LIMIT = int(0.2 * (1 << 60))


def _embedding_split(spark, sf):
    from dsengine.operators import prepare as P
    e = table(spark, sf, "embeddings")
    flat = e.select("vec_id", F.col("label").cast("double").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    flat = P.random_split(flat, ["vec_id"])
    return flat, [f"e{i}" for i in range(64)]


def _knn_sql(agg: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_EH} < {_LIMIT} AS is_test FROM embeddings),
tr AS (SELECT * FROM e WHERE NOT is_test), te AS (SELECT * FROM e WHERE is_test),
d AS (SELECT te.vec_id AS qid, tr.vec_id AS nid, tr.label AS ny, list_distance(te.v, tr.v) AS dist FROM te, tr),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rk FROM d)
{agg}"""


@register("clf_knn", _knn_sql("""
, v AS (SELECT qid, ny, count(*) AS votes FROM r WHERE rk <= 5 GROUP BY 1, 2),
p AS (SELECT qid, ny, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, ny) AS pr FROM v)
SELECT qid AS vec_id, CAST(ny AS DOUBLE) AS prediction FROM p WHERE pr = 1"""))
def q_clf_knn(spark, sf):
    flat, feats = _embedding_split(spark, sf)
    m = MD.fit_knn(flat.where(~F.col("is_test")), feats, "classification", id_col="vec_id")
    return m.transform(flat.where(F.col("is_test"))).select("vec_id", "prediction")


@register("reg_knn", _knn_sql("""
SELECT qid AS vec_id, round(avg(ny), 6) AS prediction FROM r WHERE rk <= 5 GROUP BY 1"""))
def q_reg_knn(spark, sf):
    flat, feats = _embedding_split(spark, sf)
    m = MD.fit_knn(flat.where(~F.col("is_test")), feats, "regression", id_col="vec_id")
    return rounded(m.transform(flat.where(F.col("is_test"))).select("vec_id", "prediction"))


@register("reg_linear", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_reg_linear(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity"), F.col("l_extendedprice").alias("label"))
    m = MD.fit_linear(li, ["l_quantity"])
    row = [(float(m.model.coefficients[0]), float(m.model.intercept))]
    return rounded(spark.createDataFrame(row, "slope double, intercept double"), {"intercept": 4})


# --------------------------------------------------------------------------- M30-M32
@register("train_all")
def q_train_all(spark, sf):
    res = TR.train_all(documents_labelled(spark, sf), "quality", ["doc_id"])
    return res.leaderboard


@register("train_all_regression")
def q_train_all_regression(spark, sf):
    res = TR.train_all(parts(spark, sf), "p_retailprice", ["p_partkey"])
    return res.leaderboard


@register("feature_importance")
def q_feature_importance(spark, sf):
    res = TR.train_all(parts(spark, sf), "p_retailprice", ["p_partkey"],
                       models=["Random Forest Regressor", "Linear Regression"])
    return TR.feature_importance(res)


@register("model_report")
def q_model_report(spark, sf):
    res = TR.train_all(documents_labelled(spark, sf), "quality", ["doc_id"],
                       models=["Logistic Regression", "Decision Tree Classifier", "Random Forest Classifier"])
    return TR.model_report(res)


# --------------------------------------------------------------------------- X
_LI_FEATURES = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                "l_linestatus"]


def _lineitem_bundle(spark, sf):
    li = table(spark, sf, "lineitem").select(*_LI_FEATURES)
    res = TR.train_all(li, "l_linestatus", ["l_orderkey", "l_linenumber"], models=["Decision Tree Classifier"])
    return TR.ScoringBundle.from_result(res)


def _score_input(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_discount", "l_tax", "l_returnflag")


@register("score_batch")
def q_score_batch(spark, sf):
    b = _lineitem_bundle(spark, sf)
    out = TR.score(b, _score_input(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "prediction", "error")


@register("score_stream")
def q_score_stream(spark, sf):
    from dsengine.streaming.scoring import score_stream
    b = _lineitem_bundle(spark, sf)
    out = score_stream(b, _score_input(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "prediction", "error")


@register("class_probabilities")
def q_class_probabilities(spark, sf):
    b = _lineitem_bundle(spark, sf)
    out = TR.score(b, _score_input(spark, sf))
    return out.select("l_orderkey", "l_linenumber",
                      *[F.col("probability")[i].alias(f"p_{c}") for i, c in enumerate(b.classes)])


@register("align_features", """
SELECT o_orderkey, CAST(coalesce(o_totalprice, 0.0) AS DOUBLE) AS o_totalprice,
  CAST(coalesce(o_custkey, 0) AS DOUBLE) AS o_custkey, CAST(0.0 AS DOUBLE) AS o_discount FROM orders""")
def q_align_features(spark, sf):
    return TR.align_features(table(spark, sf, "orders"), ["o_totalprice", "o_custkey", "o_discount"], keep=["o_orderkey"])


@register("score_errors", with_dirty("""
WITH d AS (SELECT * FROM dirty)
SELECT count(*) FILTER (WHERE total_price IS NOT NULL AND shipping_cost IS NOT NULL AND customer_age IS NOT NULL) AS predicted_rows,
  count(*) FILTER (WHERE total_price IS NULL OR shipping_cost IS NULL OR customer_age IS NULL) AS error_rows,
  count(*) FILTER (WHERE total_price IS NULL) AS first_error_total_price
FROM d"""))
def q_score_errors(spark, sf):
    from dsengine.plans.fixtures import dirty
    d = dirty(spark, sf)
    err = TR.validity(d, ["total_price", "shipping_cost", "customer_age"])
    e = d.select(err.alias("error"))
    return e.agg(F.count_if(F.col("error").isNull()).alias("predicted_rows"),
                 F.count_if(F.col("error").isNotNull()).alias("error_rows"),
                 F.count_if(F.col("error") == "invalid value for total_price").alias("first_error_total_price"))


@register("persist_bundle")
def q_persist_bundle(spark, sf):
    from dsengine.sources.io import load_bundle, save_bundle
    b = _lineitem_bundle(spark, sf)
    path = save_bundle(b, spark)
    b2 = load_bundle(spark, path)
    out = TR.score(b2, _score_input(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "prediction")


def _dashboard(spark, sf):
    from dsengine.operators import dashboard as D
    df = parts(spark, sf)
    res = TR.train_all(df, "p_retailprice", ["p_partkey"],
                       models=["Linear Regression", "Decision Tree Regressor"])
    return D.dashboard(df, "p_retailprice", ["p_partkey"], res.leaderboard, res.task_type)


@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf):
    return _dashboard(spark, sf)["kpis"]


_DASH_SQL = """
WITH p AS (SELECT p_partkey, p_size, p_brand, p_type, p_retailprice FROM part),
r AS (SELECT min(CAST(p_partkey AS DOUBLE)) AS lo, max(CAST(p_partkey AS DOUBLE)) AS hi FROM p)
SELECT 'dataset_summary' AS section, CAST(1 AS BIGINT) AS rows
UNION ALL SELECT 'numeric_summary', CAST(1 AS BIGINT)
UNION ALL SELECT 'distribution', CAST(count(DISTINCT least(floor((CAST(p_partkey AS DOUBLE) - r.lo) / (r.hi - r.lo) * 30), 29)) AS BIGINT)
  FROM p, r WHERE p_partkey IS NOT NULL
UNION ALL SELECT 'category_share', CAST(least(8, count(DISTINCT coalesce(p_type, 'nan'))) AS BIGINT) FROM p
UNION ALL SELECT 'completeness', CAST(1 AS BIGINT)
UNION ALL SELECT 'kpis', CAST(6 AS BIGINT)
UNION ALL SELECT 'correlation', CAST(9 AS BIGINT)
UNION ALL SELECT 'relation', CAST(least(800, count(*)) AS BIGINT) FROM p
  WHERE p_partkey IS NOT NULL AND p_retailprice IS NOT NULL
UNION ALL SELECT 'feature_importance_fallback', CAST(3 AS BIGINT)"""


@register("dashboard_bundle", _DASH_SQL)
def q_dashboard_bundle(spark, sf):
    parts_ = _dashboard(spark, sf)
    return spark.createDataFrame([(k, v.count()) for k, v in parts_.items()],
                                 "section string, rows bigint")


@register("score_stream_json")
def q_score_stream_json(spark, sf):
    from dsengine.streaming.scoring import score_json_stream
    b = _lineitem_bundle(spark, sf)
    out = score_json_stream(b, _score_input(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "prediction", "error")
