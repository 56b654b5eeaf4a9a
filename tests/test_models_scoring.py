"""Models and scoring: kNN equals brute force, stream scoring equals batch
scoring row for row, a saved bundle scores like the original, metrics beat
a trivial baseline on a separable fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dsengine.operators import models as MD
from dsengine.plans import train as TR
from dsengine.plans.fixtures import table
from dsengine.sources.io import load_bundle, save_bundle
from dsengine.streaming.scoring import score_stream


def test_knn_matches_numpy_bruteforce(spark):
    rng = np.random.default_rng(1)
    tr = rng.normal(size=(60, 3))
    te = rng.normal(size=(15, 3))
    ytr = rng.integers(0, 3, size=60)
    train = spark.createDataFrame([(i, float(ytr[i]), *map(float, tr[i])) for i in range(60)],
                                  "rid long, label double, a double, b double, c double")
    test = spark.createDataFrame([(1000 + i, *map(float, te[i])) for i in range(15)],
                                 "rid long, a double, b double, c double")
    nb = MD.knn_neighbours(train, test, ["a", "b", "c"], 5, "rid", chunk_cells=40)
    got = {}
    for r in nb.collect():
        got.setdefault(r["__qid"], []).append((r["__rank"], r["__nid"]))
    for i in range(15):
        d = ((tr - te[i]) ** 2).sum(axis=1)
        want = sorted(range(60), key=lambda j: (d[j], j))[:5]
        assert [n for _, n in sorted(got[1000 + i])] == want


@pytest.fixture(scope="module")
def bundle(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    res = TR.train_all(li, "l_linestatus", ["l_orderkey", "l_linenumber"], models=["Decision Tree Classifier"])
    return TR.ScoringBundle.from_result(res)


def _inputs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                "l_discount", "l_tax", "l_returnflag")


def test_stream_equals_batch(spark, sf, bundle):
    batch = TR.score(bundle, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    stream = score_stream(bundle, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    assert batch.count() == stream.count() > 0
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_saved_bundle_scores_the_same(spark, sf, bundle):
    path = save_bundle(bundle, spark)
    again = load_bundle(spark, path)
    a = TR.score(bundle, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    b = TR.score(again, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    assert a.exceptAll(b).count() == 0


def test_scoring_aligns_and_flags(spark, bundle):
    rows = [(1, 1, "12.0", 0.05, 0.02, "R", "extra"), (2, 1, "x", 0.01, 0.0, "N", "extra")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity string, "
                                     "l_discount double, l_tax double, l_returnflag string, other string")
    out = {r["l_orderkey"]: r for r in TR.score(bundle, df).collect()}
    assert out[1]["error"] is None and out[1]["prediction"] in ("F", "O")
    assert out[2]["error"] == "invalid value for l_quantity" and out[2]["prediction"] is None
    assert "other" in TR.score(bundle, df).columns


def test_models_beat_baseline_on_separable_data(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1.0 if (i % 10) > 4 else 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    res = TR.train_all(df, "y", ["id"], models=["Logistic Regression", "Decision Tree Classifier", "AdaBoost Classifier"])
    for r in res.metrics.collect():
        assert r["accuracy"] is not None and r["accuracy"] > 0.9, r


def test_json_stream_equals_batch(spark, sf, bundle):
    from dsengine.streaming.scoring import score_json_stream
    batch = TR.score(bundle, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    js = score_json_stream(bundle, _inputs(spark, sf)).select("l_orderkey", "l_linenumber", "prediction")
    assert batch.count() == js.count()
    assert batch.exceptAll(js).count() == 0


def test_text_dates_modelled_as_days(spark):
    rows = [(i, f"2020-01-{(i % 28) + 1:02d}", float(i % 28) * 2.0 + 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, when_day string, y double")
    out, dated = TR.dates_as_days(df, exclude=["y"])
    assert dated == ["when_day"]
    first = {r["id"]: r["when_day"] for r in out.where("id < 2").collect()}
    assert first == {0: 18262.0, 1: 18263.0}          # days since 1970-01-01
    res = TR.train_all(df, "y", ["id"], models=["Linear Regression"])
    assert res.date_columns == ["when_day"] and "when_day" in res.features
    assert res.metrics.first()["r2_score"] > 0.99
    scored = TR.score(TR.ScoringBundle.from_result(res), df.drop("y").limit(5)).collect()
    assert all(r["error"] is None and r["prediction"] is not None for r in scored)


def test_streamed_records_are_dropped_in_files_of_bounded_size(spark, monkeypatch, tmp_path):
    """Many records make more files than asked for, so that no task's share grows with the table."""
    import dsengine.streaming.scoring as SC
    monkeypatch.setattr(SC, "FILE_ROWS", 100, raising=False)
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 < 5, "a").otherwise("b").alias("y"))
    res = TR.train_all(df, "y", ["id"], models=["Decision Tree Classifier"])
    bundle = TR.ScoringBundle.from_result(res)
    for name, run in (("stream-src", SC.score_stream), ("json-src", SC.score_json_stream)):
        monkeypatch.setattr(SC, "work_path", lambda _, kind, run=run: f"{tmp_path}/{run.__name__}/{kind}")
        out = run(bundle, df.drop("y"))
        src = f"{tmp_path}/{run.__name__}/{name}"
        held = (spark.read.parquet(src) if name == "stream-src" else spark.read.text(src)).groupBy(F.input_file_name()).count()
        assert held.agg(F.max("count")).first()[0] <= 110 and held.count() == 20
        assert {(r["id"], r["prediction"]) for r in out.collect()} == {(i, "a" if i % 10 < 5 else "b") for i in range(2000)}
