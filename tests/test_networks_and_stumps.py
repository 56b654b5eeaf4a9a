"""Networks against a single machine, stumps against a search over all cuts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dsengine.operators import models as MD
from dsengine.operators import network as NW
from dsengine.plans import q_models
from dsengine.plans import train as TR


@pytest.mark.parametrize("classes", [0, 3])
def test_gradient_equals_differences(classes):
    r = np.random.Generator(np.random.PCG64(1))
    net = NW.Net([4, 6, 5, max(1, classes)], bool(classes))
    x, w = r.standard_normal((9, 4)), net.start(3)
    y = r.integers(0, 3, 9).astype(float) if classes else r.standard_normal(9)

    def total(v):
        at, penalty = 0, 0.0
        for a, b in net.shapes:
            penalty += (v[at:at + a * b] ** 2).sum()
            at += a * b + b
        return net.loss(v, x, y) / 9 + NW.PENALTY / 18 * penalty
    g = net.gradient(w, x, y)
    for i in range(0, net.size, 3):
        step = np.zeros(net.size)
        step[i] = 1e-6
        assert g[i] == pytest.approx((total(w + step) - total(w - step)) / 2e-6, abs=1e-6)


def frame(spark, x, y):
    return spark.createDataFrame([(float(v), *[float(u) for u in row]) for row, v in zip(x, y)], "label double, " + ", ".join(f"f{i} double" for i in range(x.shape[1])))


def test_one_shard_is_plain_adam(spark):
    """The same start, order and rows: the same losses as on one machine."""
    r = np.random.Generator(np.random.PCG64(2))
    x = r.standard_normal((500, 3))
    y = 3 + x[:, 0] * x[:, 1] + np.abs(x[:, 2])
    got = NW.fit_network(frame(spark, x, y).repartition(6), ["f0", "f1", "f2"], 0, max_epochs=200, hidden=[20, 10])
    row = F.array("f0", "f1", "f2")
    scaled = (F.col("label") - F.lit(got["centre"])) / F.lit(got["scale"])
    dealt = frame(spark, x, y).select(row.alias("x"), scaled.alias("y")).withColumn("h", F.xxhash64("x", "y"))
    rows = dealt.withColumn("held", F.pmod(F.xxhash64("h"), F.lit(10)) == 0).orderBy("h").collect()
    held, kept = [q for q in rows if q["held"]], [q for q in rows if not q["held"]]
    a, b = (np.array([q["x"] for q in some]) for some in (held, kept))
    c, d = (np.array([q["y"] for q in some]) for some in (held, kept))
    net = NW.Net([3, 20, 10, 1], False)
    adam = NW.Adam(net.start(42), np.zeros(net.size), np.zeros(net.size), 0)
    epochs, losses = NW.epochs_of(500), []
    for i in range(len(got["losses"])):
        losses.append(net.loss(adam.w, a, c) / len(c))
        order = np.random.Generator(np.random.PCG64(42 + i * epochs))
        for _ in range(epochs):
            adam.epoch(net, b, d, order)
    assert np.allclose(got["losses"], losses, rtol=1e-9) and losses[-1] < 0.2 * losses[0]


def test_many_shards_learn_and_stop(spark):
    r = np.random.Generator(np.random.PCG64(3))
    x = r.uniform(-2, 2, (3000, 2))
    y = np.sin(2 * x[:, 0]) * 10 + x[:, 1] ** 2 + 1000
    df = frame(spark, x, y).repartition(5)
    got = NW.fit_network(df, ["f0", "f1"], 0, shard=500)
    assert len(got["losses"]) < 1000 / NW.epochs_of(500) + 2
    out = NW.apply_network(got, ["f0", "f1"], df).select("label", F.col("__net")[0].alias("p"))
    r2 = out.agg(1 - F.sum((F.col("label") - F.col("p")) ** 2) / F.sum((F.col("label") - F.lit(float(y.mean()))) ** 2)).first()[0]
    assert r2 > 0.95


def test_classes_and_degenerate_tables(spark):
    r = np.random.Generator(np.random.PCG64(4))
    x = r.standard_normal((600, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 > 1.2).astype(float) + (x[:, 0] > 1.2)
    df = frame(spark, x, y)
    m = MD.fit("Neural Network Classifier", "classification", df, ["f0", "f1"], 3)
    out = m.transform(df)
    assert out.where("prediction = label").count() > 550
    assert out.where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    one = frame(spark, np.zeros((3, 2)), np.full(3, 7.0))
    assert all(abs(q["prediction"] - 7) < 1e-3 for q in MD.fit("Neural Network Regressor", "regression", one, ["f0", "f1"]).transform(one).collect())
    with pytest.raises(ValueError):
        MD.fit("Neural Network Regressor", "regression", one.where("false"), ["f0", "f1"])


def test_regressor_on_part(spark):
    """A value, not bins: more different predictions than classes, and a floor of R2."""
    train, test, features, *_ = q_models._prepared(spark, "/root/testdata/sf0.01", "reg")
    m = MD.fit("Neural Network Regressor", "regression", train, features)
    lin = MD.fit("Linear Regression", "regression", train, features)
    seen = m.transform(test).select("label", "prediction").toPandas()
    base = lin.transform(test).select("label", "prediction").toPandas()

    def r2(t):
        return 1 - ((t.label - t.prediction) ** 2).sum() / ((t.label - t.label.mean()) ** 2).sum()
    assert seen.prediction.nunique() > 100 and math.isfinite(r2(seen))
    assert r2(seen) > r2(base) - 0.15


def brute_stump(bins, y, w, cuts):
    best = None
    for f, n in enumerate(cuts):
        for cut in range(n):
            err, said = 0.0, []
            for side in (bins[:, f] <= cut, bins[:, f] > cut):
                heavy = {c: w[side & (y == c)].sum() for c in np.unique(y)}
                top = min(heavy, key=lambda c: (-round(heavy[c], 12), c))
                err += w[side].sum() - heavy[top]
                said.append(top)
            if best is None or round(err, 12) < best[2]:
                best = (f, cut, round(err, 12), said)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stump_equals_search_over_all_cuts(spark, seed):
    r = np.random.Generator(np.random.PCG64(seed))
    cuts = [3, 5, 0, 1]
    bins = np.column_stack([r.integers(0, n + 1, 120) for n in cuts])
    y = ((bins[:, 1] > 2) + (r.random(120) < 0.3)).astype(float)
    w = r.random(120)
    df = spark.createDataFrame([([int(b) for b in row], float(c), float(v)) for row, c, v in zip(bins, y, w)], "__bins array<int>, label double, __w double").repartition(4)
    got = MD.best_stump(df, cuts, 2).collect()
    want = brute_stump(bins, y, w, cuts)
    assert len(got) == 1
    assert (got[0]["f"], got[0]["cut"], round(got[0]["err"], 9)) == (want[0], want[1], round(want[2], 9))
    assert got[0]["total"] == pytest.approx(w.sum())
    left = bins[:, want[0]] <= want[1]
    if left.any() and (~left).any():
        assert [got[0]["left"], got[0]["right"]] == want[3]


def test_boosting_improves_and_reads_back(spark):
    r = np.random.Generator(np.random.PCG64(6))
    x = r.uniform(-1, 1, (800, 2))
    y = (np.abs(x[:, 0]) + np.abs(x[:, 1]) > 0.9).astype(float)
    df = frame(spark, x, y)
    few, many = (MD.fit("AdaBoost Classifier", "classification", df, ["f0", "f1"], 2, rounds=n) for n in (1, 25))
    right = [m.transform(df).where("prediction = label").count() for m in (few, many)]
    assert right[1] > right[0] + 80 and len(many.extra["stumps"]) == 25
    vote = {}
    for c, t, a, b, alpha in many.extra["stumps"]:
        for i, row in enumerate(x):
            s = a if row[["f0", "f1"].index(c)] <= t else b
            vote.setdefault(i, {}).setdefault(s, 0.0)
            vote[i][s] += alpha
    want = sorted((float(row[0]), min(vote[i], key=lambda c: (-vote[i][c], c))) for i, row in enumerate(x))
    assert sorted((q["f0"], q["prediction"]) for q in many.transform(df).collect()) == want


def test_row_key_is_no_feature(spark):
    assert TR.ROW_ID not in q_models._prepared(spark, "/root/testdata/sf0.001", "clf")[2]
