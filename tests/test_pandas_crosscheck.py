
import math

import numpy as np
import pandas as pd

from dsengine.operators import eda
from dsengine.operators import prepare as P


def _close(a, b, tol=1e-7):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_summary_matches_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.exponential(3.0, 500), "b": rng.normal(10, 2, 500).round(1),
                        "c": rng.integers(0, 5, 500).astype(float)})
    pdf.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r["column_name"]: r for r in eda.statistical_summary(df).collect()}
    for c in pdf.columns:
        s = pdf[c]
        g = got[c]
        assert _close(g["mean"], s.mean())
        assert _close(g["median"], s.median())
        assert _close(g["variance"], s.var())
        assert _close(g["std_dev"], s.std())
        assert _close(g["skewness"], s.skew(), 1e-6)
        assert _close(g["kurtosis"], s.kurtosis(), 1e-6)
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        out = int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
        assert g["outlier_count"] == out
        assert g["n_distinct"] == s.nunique()


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=300), "z": rng.normal(size=300)})
    pdf.loc[::11, "y"] = np.nan
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in
           eda.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            assert _close(got[(a, b)], float(want.loc[a, b]), 1e-9)


def test_one_hot_matches_get_dummies(spark):
    pdf = pd.DataFrame({"id": range(12), "color": list("rgbrgbrrgbbx"), "size": list("SMLSMLSMLSML")})
    df = spark.createDataFrame(pdf)
    model = P.fit_one_hot(df.select("color", "size"))
    got = model.transform(df).toPandas().sort_values("id").reset_index(drop=True)
    want = pd.get_dummies(pdf, columns=["color", "size"], drop_first=True, dtype=float)
    assert list(got.columns) == list(want.columns)
    assert np.allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float))
