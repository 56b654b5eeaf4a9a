"""Landmark (Nystrom) features of the RBF kernel.

Landmarks are different train rows, the first in hash order, at most ``n`` of them.
A row's features are its kernel values with the landmarks times the inverse square root
of the landmarks' own kernel matrix, so that inner products of features equal the kernel
wherever a side lies in the landmarks' span; with all rows as landmarks they are exact.
The error is measured against the exact kernel on other rows and kept with the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the error is measured on, rows whose kernel values are held at once.
MEASURED, STEP = 256, 512


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = np.sum(x * x, axis=1)[:, None] - 2 * (x @ y.T) + np.sum(y * y, axis=1)[None, :]
    return np.exp(-gamma * np.maximum(square, 0.0))


def root(marks: np.ndarray, gamma: float) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix, without its null space."""
    value, vector = np.linalg.eigh(rbf(marks, marks, gamma))
    some = value > 1e-10 * value[-1]
    return vector[:, some] / np.sqrt(value[some])


def _array(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def fit_landmarks(train: DataFrame, features: list[str], n: int) -> dict:
    """Landmarks, gamma (one over features times variance), and the mean and largest
    error of the kernel between pairs of measured rows."""
    d = max(1, len(features))
    rows = train.select(_array(features).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    r = rows.agg(F.avg(total / d).alias("m"), F.avg(square / d).alias("q")).first()
    variance = (r["q"] or 0.0) - (r["m"] or 0.0) ** 2
    gamma = 1.0 / (d * variance) if variance > 1e-12 else 1.0 / d
    first = [x["x"] for x in rows.groupBy("x").agg(F.lit(1)).select("x").orderBy(F.xxhash64("x"), "x").limit(n + MEASURED).collect()]
    marks, other = np.array(first[:n], np.float64), np.array(first[n:], np.float64)
    mean = most = 0.0
    if len(other):
        phi = rbf(other, marks, gamma) @ root(marks, gamma)
        error = np.abs(phi @ phi.T - rbf(other, other, gamma))
        mean, most = float(error.mean()), float(error.max())
    return {"landmarks": marks.tolist(), "gamma": float(gamma), "kernel_error": mean, "kernel_error_max": most}


def _features(x: np.ndarray, marks: np.ndarray, half: np.ndarray, gamma: float) -> np.ndarray:
    """Features of the rows ``x``: beside them no more than ``STEP`` rows are in work."""
    out = np.empty((len(x), half.shape[1]))
    for lo in range(0, len(x), STEP):
        out[lo:lo + STEP] = rbf(x[lo:lo + STEP], marks, gamma) @ half
    return out


def kernel_features(extra: dict, features: list[str]) -> Column:
    """The feature vector of a row, as an Arrow-batched matrix product: the matrix is
    handed on as it is, no row becomes an object."""
    marks, gamma = np.array(extra["landmarks"], np.float64).reshape(len(extra["landmarks"]), -1), extra["gamma"]
    half = root(marks, gamma)

    @F.arrow_udf("array<double>")
    def phi(x: pa.Array) -> pa.Array:
        rows = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), marks.shape[1])
        out = _features(rows, marks, half, gamma)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * half.shape[1], pa.int32()), pa.array(out.ravel()))

    return array_to_vector(phi(_array(features)))
