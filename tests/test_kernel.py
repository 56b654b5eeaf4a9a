"""Landmark features against the exact kernel, and the SVM against an exact solver."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dsengine.operators import kernel
from dsengine.operators import models as MD


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(v), *[float(u) for u in row]) for i, (row, v) in enumerate(zip(x, y))], "id int, label double, " + ", ".join(f"f{i} double" for i in range(x.shape[1])))


def features(df, extra, d):
    out = df.select("id", vector_to_array(kernel.kernel_features(extra, [f"f{i}" for i in range(d)])).alias("p")).orderBy("id").collect()
    return np.array([r["p"] for r in out])


def test_all_rows_as_landmarks_give_the_exact_kernel(spark):
    r = np.random.Generator(np.random.PCG64(1))
    x = r.standard_normal((90, 3))
    df = frame(spark, np.vstack([x, x[:10]]), np.zeros(100)).repartition(4)
    extra = kernel.fit_landmarks(df, ["f0", "f1", "f2"], 256)
    assert len(extra["landmarks"]) == 90 and extra["kernel_error_max"] == 0.0
    assert extra["gamma"] == pytest.approx(1 / (3 * np.vstack([x, x[:10]]).var()))
    phi = features(df, extra, 3)
    assert np.allclose(phi @ phi.T, kernel.rbf(np.vstack([x, x[:10]]), np.vstack([x, x[:10]]), extra["gamma"]), atol=1e-6)


def test_stated_error_falls_with_landmarks(spark):
    r = np.random.Generator(np.random.PCG64(2))
    df = frame(spark, r.standard_normal((1500, 4)), np.zeros(1500))
    found = [kernel.fit_landmarks(df, [f"f{i}" for i in range(4)], n) for n in (16, 64, 256)]
    errors = [e["kernel_error"] for e in found]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.005 and found[2]["kernel_error_max"] < 0.6


def exact_svm(k, y, steps=20000):
    """Dual of the SVM with unit cost, by projected gradient ascent."""
    q, a = (y[:, None] * y[None]) * k, np.zeros(len(y))
    rate = 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(steps):
        a = a + rate * (1 - q @ a)
        lo, hi = -1e3, 1e3  # shift along y that keeps the sum of labels at zero
        for _ in range(60):
            mid = (lo + hi) / 2
            if y @ np.clip(a - mid * y, 0, 1) > 0:
                lo = mid
            else:
                hi = mid
        a = np.clip(a - mid * y, 0, 1)
    free = (a > 1e-4) & (a < 1 - 1e-4)
    bias = np.mean(y[free] - k[free] @ (a * y)) if free.any() else 0.0
    return k @ (a * y) + bias


def test_svm_agrees_with_an_exact_solver(spark):
    r = np.random.Generator(np.random.PCG64(3))
    x = r.standard_normal((160, 2))
    y = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 + 0.3 * r.standard_normal(160) > 1.3, 1.0, -1.0)
    df = frame(spark, x, (y + 1) / 2)
    m = MD.fit("Support Vector Machine", "classification", df, ["f0", "f1"], 2)
    want = exact_svm(kernel.rbf(x, x, m.extra["gamma"]), y)
    out = m.model.transform(MD._kernel_frame(df, m.features, m.extra)).select("id", vector_to_array("rawPrediction")[1].alias("m")).orderBy("id").collect()
    got = np.array([q["m"] for q in out])
    assert (np.sign(got) == np.sign(want)).mean() > 0.97 and np.corrcoef(got, want)[0, 1] > 0.99
    assert m.transform(df).where("prediction = label").count() > 140


def test_one_value_everywhere(spark):
    df = frame(spark, np.ones((20, 2)), np.arange(20) % 2)
    extra = kernel.fit_landmarks(df, ["f0", "f1"], 8)
    assert len(extra["landmarks"]) == 1 and np.allclose(features(df, extra, 2) ** 2, 1)
    assert MD.fit("Support Vector Regressor", "regression", df, ["f0", "f1"]).transform(df).agg(F.count("prediction")).first()[0] == 20


def test_features_hold_few_rows_beside_the_result():
    """A batch's kernel values and exponents are not held whole, whatever its rows."""
    import tracemalloc

    from dsengine.operators import kernel
    r = np.random.default_rng(6)
    marks, x = r.standard_normal((256, 20)), r.standard_normal((10_000, 20))
    half = kernel.root(marks, 0.05)
    tracemalloc.start()
    got = kernel._features(x, marks, half, 0.05)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < got.nbytes + (8 << 20)
    assert np.allclose(got, kernel.rbf(x, marks, 0.05) @ half, rtol=1e-12, atol=1e-12)
