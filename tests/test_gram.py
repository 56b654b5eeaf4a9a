"""Pair moments against pandas, whatever the partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dsengine.functions import gram
from dsengine.operators import eda
from dsengine.operators.select import target_correlation


def frame(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{n} double" for n in names))


@pytest.mark.parametrize("parts,stripe", [(1, 1024), (7, 5), (64, 3)])
def test_matrix_equals_pandas(spark, monkeypatch, parts, stripe):
    monkeypatch.setattr(gram, "STRIPE", stripe)
    r = np.random.Generator(np.random.PCG64(8))
    x = r.standard_normal((400, 7)) @ r.standard_normal((7, 7))
    x[:, 1] = x[:, 1] + 1.7e9       # little spread far from zero
    x[:, 2] = 0.1                      # constant
    x[r.random((400, 7)) < 0.2] = np.nan
    x[:, 4] = x[:, 4] * 1e-13
    x[:, 5] = np.where(np.arange(400) < 390, np.nan, x[:, 5])
    x[:, 6] = np.where(np.isnan(x[:, 6]), np.nan, np.where(np.isnan(x[:, 0]), x[:, 6], 3.3))  # constant where c0 is present
    want = pd.DataFrame(x).corr(min_periods=2).to_numpy()
    got = {(q["column_a"], q["column_b"]): q["corr"] for q in eda.correlation_matrix(frame(spark, x).repartition(parts)).collect()}
    assert len(got) == 49
    for i in range(7):
        for j in range(7):
            v = got[(f"c{i}", f"c{j}")]
            if 2 in (i, j) or {i, j} == {0, 6}:
                assert v is None
            elif i == 1 or j == 1:
                assert v == pytest.approx(want[i, j], abs=1e-5)
            else:
                assert v == pytest.approx(want[i, j], abs=1e-9)


def test_far_from_zero(spark):
    r = np.random.Generator(np.random.PCG64(9))
    x = r.standard_normal((300, 2)) @ np.array([[1.0, 0.7], [0.0, 0.3]])
    want = np.corrcoef((x + 1e8).T)[0, 1]
    got = [q["abs_corr"] for q in target_correlation(frame(spark, x + 1e8).repartition(9), "c1").collect()]
    assert got == [pytest.approx(want, abs=1e-7)]


def test_nothing_to_correlate(spark):
    x = np.array([[1.0, np.nan, 2.0], [np.nan, 1.0, 2.0], [np.nan, np.nan, 2.0]])
    assert {q["corr"] for q in eda.correlation_matrix(frame(spark, x)).collect()} == {None}
    assert {q["corr"] for q in eda.correlation_matrix(frame(spark, x).where("false")).collect()} == {None}


def test_a_thousand_columns_in_one_job(spark):
    """Half a million pairs: the plan has a thousand expressions, not a million."""
    d = 1000
    df = spark.range(600).select(*[(F.sin(F.col("id") * (i + 1)) + (F.col("id") % 7 if i % 2 else F.lit(0))).alias(f"c{i}") for i in range(d)]).repartition(4)
    values = [F.col(f"c{i}") for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    r = gram.correlations(df, values, pairs)
    at = {p: v for p, v in zip(pairs, r)}
    ids = np.arange(600)
    x = np.column_stack([np.sin(ids * (i + 1)) + (ids % 7 if i % 2 else 0) for i in (0, 1, 3, 999)])
    want = np.corrcoef(x.T)
    for i, a in enumerate((0, 1, 3, 999)):
        for j, b in enumerate((0, 1, 3, 999)):
            if a <= b:
                assert at[(a, b)] == pytest.approx(want[i, j], abs=1e-9)
