"""Driver keys that return the changed rows of an operator, and scoring keys
with an answer in closed form: a neighbours' vote written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dsengine.operators import categorical as K
from dsengine.operators import clean as C
from dsengine.operators import prepare as P
from dsengine.operators import select as S
from dsengine.plans import train as TR
from dsengine.plans.fixtures import DIRTY_NUMERIC, dirty, table, with_dirty
from dsengine.plans.queries import register, rounded

_H = ("('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))), 1, 15))::BIGINT")
_LIMIT = int(0.2 * (1 << 60))


@register("random_split_rows", f"SELECT l_orderkey, l_linenumber, {_H} < {_LIMIT} AS is_test FROM lineitem")
def q_random_split_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return P.random_split(li, ["l_orderkey", "l_linenumber"])


@register("stratified_split_rows", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, md5(concat_ws('|', '42', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))) AS h,
             concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS k FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY h, k) AS rn,
             floor(count(*) OVER (PARTITION BY l_returnflag) * 0.2 + 0.5) AS quota FROM t)
SELECT l_orderkey, l_linenumber, l_returnflag, rn <= quota AS is_test FROM r""")
def q_stratified_split_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return P.stratified_split(li, "l_returnflag", ["l_orderkey", "l_linenumber"])


def _filled(c: str) -> str:
    q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.5) AS med, avg({c}) AS mean, count(*) AS n FROM dirty)"
    return (f"round(coalesce(CAST({c} AS DOUBLE), (SELECT CASE WHEN q3 <> q1 AND (SELECT count(*) FROM dirty, {q} z WHERE {c} < z.q1 - 1.5 * (z.q3 - z.q1) "
            f"OR {c} > z.q3 + 1.5 * (z.q3 - z.q1)) / n > 0.1 THEN med ELSE mean END FROM {q} y)), 6) AS {c}")


_HOLES = ["order_id", "total_price", "shipping_cost", "legacy_code"]


@register("impute_numeric_rows", with_dirty(f"SELECT k, {', '.join(_filled(c) for c in _HOLES)} FROM dirty"))
def q_impute_numeric_rows(spark, sf):
    out, _ = C.impute_numeric(dirty(spark, sf), DIRTY_NUMERIC)
    return rounded(out.select("k", *_HOLES))


def _mode(c: str) -> str:
    return f"coalesce({c}, (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}"


@register("impute_mode_rows", with_dirty(f"SELECT k, {_mode('priority')}, {_mode('is_large')}, {_mode('end_date')} FROM dirty"))
def q_impute_mode_rows(spark, sf):
    return C.impute_mode(dirty(spark, sf).select("k", "priority", "is_large", "end_date"), ["priority", "is_large", "end_date"])[0]


@register("domain_rules_rows", with_dirty("""
SELECT k, CASE WHEN customer_age BETWEEN 0 AND 120 THEN customer_age END AS customer_age,
  CASE WHEN discount_rate BETWEEN 0 AND 100 THEN discount_rate END AS discount_rate FROM dirty"""))
def q_domain_rules_rows(spark, sf):
    out, _ = C.domain_rules(dirty(spark, sf), DIRTY_NUMERIC)
    return out.select("k", "customer_age", "discount_rate")


@register("select_features_dirty", with_dirty("""
WITH r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN min(CASE WHEN total_price IS NOT NULL THEN {c} END) < max(CASE WHEN total_price IS NOT NULL THEN {c} END) "
    f"THEN round(abs(corr({c}, total_price)), 6) END AS abs_corr FROM dirty" for c in DIRTY_NUMERIC if c != "total_price") + """)
SELECT column_name, abs_corr, coalesce(abs_corr < 0.1, false) AS dropped FROM r"""))
def q_select_features_dirty(spark, sf):
    d = dirty(spark, sf)
    low = S.select_features(d, "total_price", threshold=0.1)[1]
    return rounded(S.target_correlation(d, "total_price").withColumn("dropped", F.col("column_name").isin(low)))


# --------------------------------------------------------------------------- scoring in closed form
#: customers with a positive balance, learnt by five neighbours and answered in words
_TARGET, _PAIR = "in_credit", ("Yes", "No")


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal")


def _bundle(spark, sf):
    df = _customers(spark, sf).withColumn(_TARGET, F.when(F.col("c_acctbal") > 0, "Yes").otherwise("No"))
    pairs = {_TARGET: _PAIR}
    res = TR.train_all(K.binary_encode(df, pairs), _TARGET, ["c_custkey"], models=["K-Nearest Neighbors Classifier"])
    return TR.ScoringBundle.from_result(res, pairs=pairs)


_VOTES = """
WITH c AS (SELECT c_custkey, c_acctbal AS x, c_acctbal > 0 AS y,
    ('0x' || substr(md5(concat_ws('|', '42', CAST(c_custkey AS STRING))), 1, 15))::BIGINT AS id FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', CAST(id AS STRING))), CAST(id AS STRING)) AS rn,
    floor(count(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS quota FROM c),
tr AS (SELECT * FROM s WHERE rn > quota),
n AS (SELECT c.c_custkey, tr.y, row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.x - tr.x), tr.id) AS r FROM c, tr),
v AS (SELECT c_custkey, count(*) FILTER (WHERE y) / 5.0 AS p_yes FROM n WHERE r <= 5 GROUP BY 1)
"""
_WORDS = _VOTES + "SELECT c_custkey, CASE WHEN p_yes > 0.5 THEN 'Yes' ELSE 'No' END AS prediction, CAST(NULL AS STRING) AS error FROM v"


def _told(out):
    return out.select("c_custkey", "prediction", "error")


@register("score_batch_words", _WORDS)
def q_score_batch_words(spark, sf):
    return _told(TR.score(_bundle(spark, sf), _customers(spark, sf), id_col="c_custkey"))


@register("score_stream_words", _WORDS)
def q_score_stream_words(spark, sf):
    from dsengine.streaming.scoring import score_stream
    return _told(score_stream(_bundle(spark, sf), _customers(spark, sf), id_col="c_custkey"))


@register("score_json_words", _WORDS)
def q_score_json_words(spark, sf):
    from dsengine.streaming.scoring import score_json_stream
    return _told(score_json_stream(_bundle(spark, sf), _customers(spark, sf), id_col="c_custkey"))


@register("persist_bundle_words", _WORDS)
def q_persist_bundle_words(spark, sf):
    from dsengine.sources.io import load_bundle, save_bundle
    back = load_bundle(spark, save_bundle(_bundle(spark, sf), spark))
    return _told(TR.score(back, _customers(spark, sf), id_col="c_custkey"))


@register("vote_shares", _VOTES + "SELECT c_custkey, round(1 - p_yes, 6) AS p_no, round(p_yes, 6) AS p_yes FROM v")
def q_vote_shares(spark, sf):
    out = TR.score(_bundle(spark, sf), _customers(spark, sf), id_col="c_custkey")
    return rounded(out.select("c_custkey", F.col("probability")[0].alias("p_no"), F.col("probability")[1].alias("p_yes")))


@register("csv_round_trip_texts", """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents""")
def q_csv_round_trip_texts(spark, sf):
    from dsengine.session import work_path
    from dsengine.sources import io
    path = work_path(spark, "documents-csv") + ".csv"
    io.export_csv(table(spark, sf, "documents"), path)
    return io.read_table(spark, path).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# --------------------------------------------------------------------------- training in closed form
_LINE = """
WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
    ('0x' || substr(md5(concat_ws('|', '42', CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(p_partkey AS STRING))), 1, 15))::BIGINT AS STRING))), 1, 15))::BIGINT AS h FROM part),
tr AS (SELECT * FROM p WHERE h >= """ + str(_LIMIT) + """), te AS (SELECT * FROM p WHERE h < """ + str(_LIMIT) + """),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, covar_pop(x, y) / stddev_pop(x) AS w FROM tr)
"""


def _line(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return TR.train_all(part, "p_retailprice", ["p_partkey"], models=["Linear Regression"])


@register("feature_importance_line", _LINE + "SELECT 'Linear Regression' AS model, 'p_size' AS feature, round(abs(w), 4) AS importance FROM f")
def q_feature_importance_line(spark, sf):
    return rounded(TR.feature_importance(_line(spark, sf)), {"importance": 4})


@register("model_report_line", _LINE + """
SELECT 'Linear Regression' AS model, round(1 - sum(pow(y - a - b * x, 2)) / (var_pop(y) * count(*)), 6) AS r2_score,
  round(avg(abs(y - a - b * x)), 4) AS mae, round(sqrt(avg(pow(y - a - b * x, 2))), 4) AS rmse,
  round(avg(abs(y - a - b * x) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
  CAST(1 AS INTEGER) AS rank, true AS is_best, 'regression' AS task_type, CAST(1 AS INTEGER) AS models_trained, CAST(0 AS INTEGER) AS models_failed
FROM te, f""")
def q_model_report_line(spark, sf):
    report = TR.model_report(_line(spark, sf)).select("model", "r2_score", "mae", "rmse", "mape", "rank", "is_best", "task_type", "models_trained", "models_failed")
    return rounded(report, {"mae": 4, "rmse": 4})
