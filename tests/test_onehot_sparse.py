"""Sparse one-hot vectors over a vocabulary table."""

import pytest
from pyspark.sql import functions as F

from dsengine.operators import onehot
from dsengine.operators import prepare as P
from dsengine.operators.onehot import VECTOR, fit_sparse
from dsengine.plans import train as TR
from dsengine.sources.io import load_bundle, save_bundle


def slots(df, key):
    return {r[key]: (r["v"].size, sorted(int(i) for i in r["v"].indices)) if hasattr(r["v"], "indices") else (len(r["v"]), [i for i, x in enumerate(r["v"]) if x])
            for r in df.select(key, F.col(VECTOR).alias("v")).collect()}


@pytest.mark.parametrize("frequent", [1000, 3, 1])
def test_slots_follow_the_sorted_values(spark, monkeypatch, frequent):
    """Values that come by broadcast and by shuffle agree."""
    monkeypatch.setattr(onehot, "FREQUENT", frequent)
    rows = [(i, v, w) for i, (v, w) in enumerate([("b", "x"), ("a", None), (None, "x"), ("c", "y"), ("b", "z"), ("d", "x"), ("b", "x"), ("é", "x"), ("", "y")])]
    df = spark.createDataFrame(rows, "id int, c string, w string").repartition(3)
    model = fit_sparse(df, ["c", "w"])
    c, w = ["", "a", "b", "c", "d", "é"], ["x", "y", "z"]
    assert model.sizes == [5, 2] and model.n_slots == 7
    want = {i: (7, sorted(([c.index(v) - 1] if v and c.index(v) else []) + ([5 + w.index(u) - 1] if u and w.index(u) else []))) for i, v, u in rows}
    assert slots(model.transform(df), "id") == want
    new = spark.createDataFrame([(1, "unseen", 5), (2, "d", 6)], "id int, c string, extra int")
    out = model.transform(new)
    assert out.columns == ["id", "extra", VECTOR] and slots(out, "id") == {1: (7, []), 2: (7, [3])}


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, None, "k")], "id int, a string, b string")
    model = fit_sparse(df, ["a", "b"])
    assert model.sizes == [0, 0] and slots(model.transform(df), "id") == {1: (0, []), 2: (0, [])}
    assert fit_sparse(df.where("false"), ["a"]).sizes == [0]


def test_a_million_values(spark):
    """The driver gets one count a column; a value that a third of the rows hold comes
    by broadcast."""
    df = spark.range(1_500_000).select("id", F.when(F.col("id") < 1_000_000, F.concat(F.lit("v"), F.col("id").cast("string"))).otherwise(F.lit("zhot")).alias("c"))
    model = fit_sparse(df, ["c"])
    assert model.sizes == [1_000_000] and model.table.where("frequent").collect()[0]["value"] == "zhot"
    out = model.slots(df)
    r = out.agg(F.count("__slot0").alias("n"), F.count_distinct("__slot0").alias("d"), F.max("__slot0").alias("m"), F.count("*").alias("rows")).first()
    assert (r["n"], r["d"], r["m"], r["rows"]) == (1_499_999, 1_000_000, 999_999, 1_500_000)
    vector = model.transform(df.where("id IN (7, 1200000)")).select(VECTOR).first()[0]
    assert vector.size == 1_000_000 and len(vector.indices) == 1


def test_models_read_the_vector(spark, monkeypatch):
    """With few columns allowed, the text becomes one vector and decides the label."""
    monkeypatch.setattr("dsengine.rules.ONE_HOT_COLUMNS", 10)
    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("w"), (F.col("id") % 40).cast("string")).alias("word"),
                                 F.when(F.col("id") % 40 < 20, "yes").otherwise("no").alias("y"))
    names = ["Logistic Regression", "Random Forest Classifier", "Decision Tree Classifier", "K-Nearest Neighbors Classifier"]
    res = TR.train_all(df, "y", ["id"], models=names)
    assert res.features == ["x", VECTOR] and res.prep.first()["n_features"] == 40
    best = {r["model"]: r["accuracy"] for r in res.metrics.collect()}
    assert best["Logistic Regression"] > 0.95 and best["Random Forest Classifier"] > 0.9 and "plain columns" in res.errors["K-Nearest Neighbors Classifier"]
    assert [n for n, _ in res.fitted["Logistic Regression"].importances()][0] == VECTOR
    bundle = TR.ScoringBundle.from_result(res, model="Logistic Regression")
    want = {r["id"]: r["prediction"] for r in TR.score(bundle, df, "id").collect()}
    again = load_bundle(spark, save_bundle(bundle, spark))
    assert {r["id"]: r["prediction"] for r in TR.score(again, df, "id").collect()} == want
    assert sum(want[i] == ("yes" if i % 40 < 20 else "no") for i in want) > 570


def test_few_values_stay_columns(spark):
    df = spark.createDataFrame([("a", 1.0, "p"), ("b", 2.0, "q"), ("c", 3.0, "r")], "c string, x double, d string")
    model = P.fit_one_hot(df, ["c", "d"], columns_at_most=10)
    assert model.wide is None and model.transform(df).columns == ["x", "c_b", "c_c", "d_q", "d_r"]
