"""The regression line-up on large tables: what its longest fits keep, and their order."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions import staging
from dsengine.operators import models as MD
from dsengine.plans import train as TR


@pytest.fixture(scope="module")
def rows(spark):
    x = (F.col("id") * 7919 % 101).cast("double")
    z = (F.col("id") * 104729 % 13).cast("double")
    return spark.range(600).coalesce(1).select("id", x.alias("x"), z.alias("z"), (3 * x + F.pow(z, F.lit(2.0)) + F.col("id") % 5).alias("label"))


def test_rows_keep_their_nodes_and_the_trees_stay(rows):
    forest, tree = MD.fit_forest_regressor(rows, ["x", "z"], trees=4, depth=12).model, MD.fit_tree_regressor(rows, ["x", "z"], depth=12).model
    assert forest.getOrDefault("cacheNodeIds") and tree.getOrDefault("cacheNodeIds")
    plain = MD.assemble(rows.select("x", "z", "label"), ["x", "z"])
    from_the_root = RandomForestRegressor(numTrees=4, maxDepth=12, seed=rules.SEED).fit(plain)
    assert [t.toDebugString.split("\n")[1:] for t in forest.trees] == [t.toDebugString.split("\n")[1:] for t in from_the_root.trees]
    from_the_root = DecisionTreeRegressor(maxDepth=12, seed=rules.SEED).fit(plain)
    assert tree.toDebugString.split("\n")[1:] == from_the_root.toDebugString.split("\n")[1:]


def test_rows_of_a_large_forest_come_by_their_features(rows, monkeypatch):
    def tasks(df):
        parts = df.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect()
        return [p for p in parts if p]

    small = tasks(MD.dealt(rows, ["x", "z"], alike=True))
    assert small == tasks(rows.select("x", "z", "label"))  # one task's rows stay as they come
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 14)
    large = tasks(MD.dealt(rows, ["x", "z"], alike=True))
    assert len(large) >= 4 and all(p == sorted(p) for p in large)
    assert sorted(r for p in large for r in p) == sorted(small[0])


def test_a_boosting_round_weighs_by_the_mean_loss(rows):
    f = MD.fit_adaboost_regressor(rows, ["x", "z"], rounds=4)
    data = MD.assemble(rows.select("x", "z", "label"), ["x", "z"])
    w, betas = np.full(600, 1 / 600), []
    for m in f.extra["models"]:
        e = np.array([abs(r[0] - r[1]) for r in m.transform(data).select("prediction", "label").collect()])
        mean = (w * e / e.max()).sum() / w.sum()
        betas.append(mean / (1 - mean))
        w = w * betas[-1] ** (1 - e / e.max())
    assert len(betas) == 4 and f.extra["betas"] == pytest.approx(betas, rel=1e-9)


def test_models_of_many_rounds_begin_first(rows, monkeypatch):
    begun = []

    def fit(name, *args, **kw):
        begun.append(name)
        return MD.fit_linear(*args[1:3])

    monkeypatch.setattr(rules, "FITS_AT_ONCE", 1)
    monkeypatch.setattr(MD, "fit", fit)
    res = TR.train_all(rows, "label", ["id"])
    assert set(begun[:4]) == set(rules.FIT_FIRST) and sorted(begun) == sorted(MD.REGRESSORS)
    assert [r["model"] for r in res.metrics.orderBy("ordinal").collect()] == MD.REGRESSORS and list(res.fitted) == MD.REGRESSORS
