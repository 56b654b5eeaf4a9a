"""No size breaks an operator, constants stay constants, and scoring answers
in the words of the target whatever the model."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from dsengine.functions.quantiles import exact_quantiles
from dsengine.operators import clean as C
from dsengine.operators import eda, select
from dsengine.operators import models as MD
from dsengine.operators import prepare as P
from dsengine.operators import profile as PF
from dsengine.plans import train as TR
from dsengine.sources import io
from dsengine.streaming.scoring import score_stream


def test_stratified_split_of_20000_classes(spark):
    df = spark.range(100000).select("id", (F.col("id") % 20000).cast("string").alias("y"))
    out = P.stratified_split(df, "y", ["id"])
    per = out.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert out.count() == 100000
    assert [tuple(r) for r in per.groupBy("n", "t").count().collect()] == [(5, 1, 20000)]


def test_stratified_split_ranks_inside_long_prefixes(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "a").otherwise("b").alias("y"))
    whole = {r["id"] for r in P.stratified_split(df, "y", ["id"]).where("is_test").collect()}
    fine = {r["id"] for r in P.stratified_split(df.repartition(9), "y", ["id"], rank_limit=1).where("is_test").collect()}
    assert whole == fine and len(whole) == 600


@pytest.mark.parametrize("few", [10_000, 0])
def test_stratified_split_never_joins_by_class_alone(spark, monkeypatch, few):
    monkeypatch.setattr(P, "BROADCAST_CLASSES", few, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _split_without_skew(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _split_without_skew(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 2500, "a").when(F.col("id") < 3500, "b").alias("y"))
    out = P.stratified_split(df, "y", ["id"])
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert all("__p#" in line for line in joins if "SortMergeJoin [coalesce(__y#" in line)
    got = {tuple(r) for r in out.groupBy("y").agg(F.count("*"), F.count_if("is_test")).collect()}
    assert got == {("a", 2500, 500), ("b", 1000, 200), (None, 500, 100)}
    order = out.select("y", "is_test", F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))).alias("h"))
    edge = order.groupBy("y").agg(F.max(F.when(F.col("is_test"), F.col("h"))).alias("a"), F.min(F.when(~F.col("is_test"), F.col("h"))).alias("b"))
    assert edge.where("a < b").count() == 3


def test_one_hot_of_5000_values(spark):
    df = spark.range(5000).select(F.format_string("v%05d", "id").alias("c"))
    model = P.fit_one_hot(df)
    assert len(model.feature_names()) == 4999


def test_contingency_wide_of_1200_classes(spark):
    df = spark.range(2400).select((F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 1200).cast("string").alias("t"))
    assert len(eda.contingency_wide(df, "c", "t").columns) == 1201


def test_quantiles_of_very_wide_values(spark):
    r = random.Random(4)
    vals = [r.choice((-1, 1)) * 10.0 ** r.uniform(-300, 300) for _ in range(3000)] + [0.0] * 50 + [5e-324, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.75, 1.0], collect_limit=5, bins=16, bracket=False)
    s = sorted(vals)
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        k = p * (len(s) - 1)
        lo, hi = s[math.floor(k)], s[math.ceil(k)]
        want = lo if k == math.floor(k) else lo + (hi - lo) * (k - math.floor(k))
        assert got[("v", p)] == pytest.approx(want, rel=1e-12)


def test_means_of_tiny_and_huge_values(spark):
    tiny = spark.createDataFrame([(3e-13,), (5e-13,)], "v double")
    assert eda.moments(tiny, ["v"])["v"]["mean"] == pytest.approx(4e-13)
    huge = spark.range(200000).select(F.lit(9e19).alias("v"))
    assert eda.moments(huge, ["v"])["v"]["mean"] == 9e19


@pytest.mark.parametrize("n", [1, 4, 7, 8, 64])
def test_constants_for_any_partitioning(spark, n):
    df = spark.range(15750).select(F.lit(0.1).alias("k"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") * 3.5).alias("y")).repartition(n)
    s = {r["column_name"]: r for r in eda.statistical_summary(df).collect()}
    assert s["k"]["skewness"] is None and s["k"]["kurtosis"] is None and s["k"]["variance"] == 0.0
    assert {r["column_name"]: r["abs_corr"] for r in select.target_correlation(df, "y").collect()}["k"] is None
    assert "k" in select.select_features(df, "y")[0].columns
    assert all(r["corr"] is None for r in eda.correlation_matrix(df).where("column_a = 'k' or column_b = 'k'").collect())
    assert {r["k"] for r in C.standard_scale(df, ["k"]).select("k").distinct().collect()} == {0.0}
    assert P.fit_scaler(df, ["k"])["k"] == (0.1, 0.0)


def test_zero_has_one_spelling(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-0.0, 2.0), (1.0, 3.0)], "a double, b double")
    card = {r["column_name"]: r["n_distinct"] for r in PF.column_cardinality(df).collect()}
    assert card == {"a": 2, "b": 3}


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(30)] + [(float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    bins = eda.histogram(df, ["v"]).collect()
    assert len(bins) == 30 and all(r["count"] == 1 and math.isfinite(r["bin_lo"]) for r in bins)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", ok', 1.5, None), (2, "two\nlines", None, "-"), (3, "plain", 2.5, "x")]
    df = spark.createDataFrame(rows, "id long, text string, v double, dash string")
    path = str(tmp_path / "t.csv")
    io.export_csv(df, path)
    back = io.read_table(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "text": "string", "v": "double", "dash": "string"}
    assert sorted(tuple(r) for r in back.collect()) == rows
    (tmp_path / "na.csv").write_text("a,b\n1.5,2021-01-02\nNA,n/a\n2.5,2021-01-03\n")
    na = io.read_table(spark, str(tmp_path / "na.csv"))
    assert [r["a"] for r in na.collect()] == [1.5, None, 2.5] and dict(na.dtypes)["b"] == "timestamp_ntz"


@pytest.mark.parametrize("kind", ["number", "text", "date", "timestamp"])
def test_fill_by_any_key(spark, kind):
    key = {"number": float, "text": lambda i: f"{i:04d}", "date": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i),
           "timestamp": lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i)}[kind]
    name = {"number": "double", "text": "string", "date": "date", "timestamp": "timestamp_ntz"}[kind]
    vals = [None, None] + [i if i % 7 == 0 else None for i in range(2, 400)]
    df = spark.createDataFrame([(key(i), v) for i, v in enumerate(vals)], f"k {name}, v int").repartition(7)
    got = [r["v"] for r in C.ffill_bfill(df, ["v"], "k").orderBy("k").collect()]
    want, last = [], next(v for v in vals if v is not None)
    for v in vals:
        last = v if v is not None else last
        want.append(last)
    assert got == want


def yes_no(spark):
    rows = [(i, float(i % 50), "Yes" if i % 50 >= 25 else "No") for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, y string")


def test_scoring_answers_in_the_words_of_a_binary_target(spark):
    from dsengine.operators import categorical as K
    df = yes_no(spark)
    pairs = {"y": ("Yes", "No")}
    res = TR.train_all(K.binary_encode(df, pairs), "y", ["id"], models=["Decision Tree Classifier"])
    out = TR.score(TR.ScoringBundle.from_result(res, pairs=pairs), df.select("id", "x"), id_col="id")
    assert out.join(df, "id").where("prediction = y").count() == 400


def test_equal_queries_have_equal_neighbours(spark):
    train = spark.createDataFrame([(i, float(i), float(i % 3 == 0)) for i in range(40)], "id long, x double, label double")
    m = MD.fit("K-Nearest Neighbors Classifier", "classification", train, ["x"], 2, id_col="id")
    once = spark.createDataFrame([(1000 + i, i + 0.4) for i in range(30)], "id long, x double")
    single = {r["id"]: (r["prediction"], list(r["probability"])) for r in m.transform(once).collect()}
    double = m.transform(once.union(once)).collect()
    assert len(double) == 60 and all(single[r["id"]] == (r["prediction"], list(r["probability"])) for r in double)


def test_knn_tiles_agree_with_one_block(spark, monkeypatch):
    r = random.Random(9)
    train = spark.createDataFrame([(i, r.random(), r.random(), r.random()) for i in range(300)], "id long, a double, b double, label double")
    test = spark.createDataFrame([(i, r.random(), r.random()) for i in range(80)], "id long, a double, b double")
    whole = sorted(tuple(x) for x in MD.knn_neighbours(train, test, ["a", "b"], 5, "id").collect())
    monkeypatch.setattr(MD, "KNN_TILE", (7, 11))
    assert sorted(tuple(x) for x in MD.knn_neighbours(train, test, ["a", "b"], 5, "id").collect()) == whole


CHEAP = {"Gradient Boosting Classifier": {"rounds": 3}, "AdaBoost Classifier": {"rounds": 3}, "Neural Network Classifier": {"max_iter": 20}, "Random Forest Classifier": {"trees": 3},
         "Gradient Boosting Regressor": {"rounds": 3}, "AdaBoost Regressor": {"rounds": 3}, "Neural Network Regressor": {"max_iter": 20, "bins": 4}, "Random Forest Regressor": {"trees": 3}}


@pytest.mark.parametrize("name", MD.CLASSIFIERS + MD.REGRESSORS)
def test_every_model_is_saved_and_streamed(spark, name):
    df = spark.createDataFrame([(i, float(i % 40), float((i * 7) % 13), "b" if i % 40 >= 20 else "a", 3.0 * (i % 40) + (i * 7) % 13) for i in range(160)], "id long, x double, z double, c string, r double")
    classify = name in MD.CLASSIFIERS
    target = "c" if classify else "r"
    data = df.drop("r" if classify else "c")
    res = TR.train_all(data, target, ["id"], models=[name], model_params=CHEAP)
    assert not res.errors
    bundle = TR.ScoringBundle.from_result(res)
    batch = sorted((r["id"], r["prediction"]) for r in TR.score(bundle, data.drop(target), id_col="id").collect())
    again = io.load_bundle(spark, io.save_bundle(bundle, spark))
    assert sorted((r["id"], r["prediction"]) for r in TR.score(again, data.drop(target), id_col="id").collect()) == batch
    if name in ("Decision Tree Classifier", "K-Nearest Neighbors Classifier", "Support Vector Regressor", "K-Nearest Neighbors Regressor"):
        assert sorted((r["id"], r["prediction"]) for r in score_stream(again, data.drop(target), id_col="id").collect()) == batch
    if name in ("Decision Tree Classifier", "Random Forest Classifier", "Support Vector Machine", "K-Nearest Neighbors Classifier"):
        assert res.leaderboard.first()["accuracy"] > 0.8


def test_scoring_rows_are_cleaned_like_training_rows(spark):
    from dsengine import api
    rows = [(i, (" Male", "FEMALE ", "male", "Female")[i % 4], float(i % 10), 10.0 * (i % 2) + i % 10 + i * 0.01) for i in range(200)]
    df = spark.createDataFrame(rows, "row long, gender string, x double, y double")
    cleaned = api.clean(df, target="y", order_by="row", select_features=False)
    result = api.train(cleaned.df, "y", models=["Linear Regression"])
    got = {r["gender"]: r["prediction"] for r in api.score(result, spark.createDataFrame([(1, " Male", 3.0), (1, "male", 3.0), (1, "MALE ", 3.0), (1, "Female", 3.0)], "row long, gender string, x double"), cleaned).collect()}
    assert got[" Male"] == got["male"] == got["MALE "] != got["Female"]


def test_a_fit_is_dealt_by_what_it_keeps_of_its_rows(spark, monkeypatch):
    """A small file of many rows does not become one task's cache."""
    from dsengine.functions import staging
    df = spark.range(4000).coalesce(1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    assert staging.spread_rows(df, 4000, 1000) is df
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 15)
    out = MD.dealt(df, ["x"])
    assert out.rdd.getNumPartitions() >= 4000 * (MD.ROW_BYTES + 8) / (1 << 15)
    assert sorted(out.columns) == ["label", "x"] and out.count() == 4000
    seen = []
    for fit in (MD.fit_forest_regressor, MD.fit_gbt_regressor, MD.fit_svr, MD.fit_adaboost_regressor):
        monkeypatch.setattr(MD, "spread_rows", lambda d, rows, size: seen.append((rows, size)) or d)
        fit(df, ["x"], **({"rounds": 2} if fit in (MD.fit_gbt_regressor, MD.fit_adaboost_regressor) else {"trees": 2, "depth": 2} if fit is MD.fit_forest_regressor else {}))
    assert [rows for rows, _ in seen] == [4000] * 4 and seen[2][1] == MD.ROW_BYTES + 8 * 7


def test_texts_that_cannot_be_numbers_or_other_dates_are_not_tried(spark):
    """The short ways give what the tries give, on odd texts too."""
    odd = ["1", " 1 ", "-1.5e3", "+.5", "1.", "1d", "2F", "0x1p3", "NaN", "nan", "Nope", "inf", "-inf", "Infinity", "iso", "In", "1-URGENT", "12:30", "1/2",
           "e5", "F", "", " ", "\t7", "7\n", "1996-01-02", " 1996-01-02 ", "1996-02-30", "1996-1-2", "1996-01-02 03:04:05", "1996-01-02T03:04:05", "01/02/1996",
           "1-2-1996", "13-02-1996", "1996/01/02", "1996-01-02\n", "0000-00-00", "\u0661\u0662"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    wrong = df.where(F.trim("t").rlike(PF.NO_NUMBER) & F.col("t").try_cast("double").isNotNull())
    assert wrong.count() == 0
    assert df.where(F.trim("t").rlike(PF.NO_NUMBER)).count() >= 15
    short, tried = C.coerce_datetime(F.col("t")), C.coerce_datetime(F.col("t"), C.DATETIME_FORMATS)
    assert df.where(~short.eqNullSafe(tried)).count() == 0
    assert "RLIKE" in df.select(short).schema.fields[0].name.upper()
